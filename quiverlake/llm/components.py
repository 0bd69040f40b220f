"""Connected components by alternating large-star and small-star contraction.

Each round is several shuffles; so what is left of a graph, or all of it, is finished by one task as soon as it has no
more than FINISH_EDGES edges, which bounds what the task holds at any size of the data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import discard, materialise, skew_join


#: Edges (16 bytes each) that one task may finish.
FINISH_EDGES = 200_000


def _finish(batches):
    """(u, v) of all edges: each node that is not the smallest of its component, with that one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            root[max(a, c)] = root.setdefault(min(a, c), min(a, c))
    low = [(u, find(u)) for u in list(root)]
    low = [x for x in low if x[0] != x[1]]
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in low], pa.int64()), pa.array([v for _, v in low], pa.int64())], ["u", "v"])


def _star(pairs: DataFrame, edges: int) -> DataFrame:
    """pairs (u, v), each node u with its neighbours, of at most 2 x edges rows: (u, v, m) for all v, m being u's smallest neighbour or u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return skew_join(pairs, least, ["u"], "n", 2 * edges).select("u", "v", "m")


def connected(edges: DataFrame, rounds: int = 60, finish: int = FINISH_EDGES) -> DataFrame:
    """edges (a, b), any order: (node, component), the component being its smallest node. Nodes without edges don't occur."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    mark, n = None, now.count()
    for _ in range(rounds):
        if n <= finish:
            last, now = now, materialise(now.coalesce(1).mapInArrow(_finish, "u bigint, v bigint"), "components")
            discard(last)
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large, n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, materialise(small, "components")
        discard(last)
        new = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
        if new == mark:
            break
        mark, n = new, new[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components (node, component) with further edges (a, b) taken in, among their nodes and others. Only the components that the edges touch are worked on."""
    label = components.select("node", "component")
    ends = edges.join(label.withColumnsRenamed({"node": "a", "component": "x"}), "a", "left").join(label.withColumnsRenamed({"node": "b", "component": "y"}), "b", "left")
    moved = connected(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    fresh = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(label, "node", "left_anti")
    nodes = materialise(label.union(fresh.select("node", F.col("node").alias("component"))), "components")
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    target = moved.select(F.col("node").alias("component"), F.col("component").alias("to")).join(sizes, "component")
    out = skew_join(nodes, target, ["component"], "n", nodes.count(), "left").select("node", F.coalesce("to", "component").alias("component"))
    out = materialise(out, "components")
    discard(nodes, components)
    return out
