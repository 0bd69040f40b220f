"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies). Among all rates between 0 and the most copies allowed that meet the token
constraints (one a source: rates x sizes add up to its target), the entropy-balanced ones stay closest to 1 in relative
entropy, every document counting alike. They are exponential tilts, rate = min(most, exp(multiplier of the source x size /
mean size of the source)): where a source is to shrink, long documents yield more of it than short ones, and where it is
to grow, they give more. The multipliers solve the convex dual by Newton's method. Its gradient and Hessian are sums over
documents, taken by Spark on (source, size) counts, which are sufficient; with one constraint a source the Hessian is
diagonal, so a step is a column expression and no number of sources reaches the driver. A bracket around each multiplier
holds steps from far away.

Rates become copies by error diffusion: a source's documents are dealt by hash into groups of bounded size, and in
each group, from long to short, the words owed so far decide between the whole numbers below and above the rate. What is
left over then goes to the longest documents that can take some of it. What a group still owes at the end is less than its
shortest documents hold.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiverlake.llm.common import discard, materialise, word_count


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with position (from 0) in the order of key, nulls last; keys are distinct. A sort by ranges, then counts of the ranges before."""
    parts = materialise(df.orderBy(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mixing-order")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # as many rows as partitions
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return parts.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Sources in order of code points, null last, have the weights in turn. Together the targets are all words; a target
    stops at `most` times its source's size and what is over goes to the others by weight until none is above. So a
    target is min(most x size, weight x level); each pass takes the level of those that the one before did not stop.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    s = ranked(sizes, "source").withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = materialise(s.select("source", "source_size", "weight", "cap"), "mixing-weights")
    total, level, stopped = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while total:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        taken, left, n = s.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if n == stopped or left == 0:
            break
        level, stopped = (total - taken) / left, n
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def rate(lam, size, unit, most: float) -> F.Column:
    """min(most, exp(lam x size / unit)), without overflow."""
    return F.exp(F.least(F.lit(math.log(most)), lam * size / unit))


def newton(counts: DataFrame, goals: DataFrame, most: float = 3.0, steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """Per source: lam, unit (mean size of its documents that have words) and g, the words that its rates take; target is met by g.

    counts: source, size, n; goals: source, source_size, target. A source that may give no more than its target (most x
    size) has an infinite multiplier, one without words 0. Each pass reads the counts once; it ends when every source is
    within the tolerance.
    """
    facts = counts.where("size > 0").groupBy(F.col("source").alias("c")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    now = goals.join(facts, F.col("source").eqNullSafe(F.col("c")), "left").select(F.col("source").alias("s"), "target", F.col("source_size").cast("double").alias("own"), F.coalesce("unit", F.lit(1.0)).alias("unit"))
    full = F.col("target") >= F.col("own") * most * (1 - 1e-12)
    # no document has less than one word, so these bounds hold: beyond them all are at the most, or too few words are left
    top, bottom = F.col("unit") * math.log(most), F.col("unit") * F.log(F.col("target") / F.when(F.col("own") > 0, F.col("own")))
    grows = F.col("target") > F.col("own")
    now = now.select(
        "s", "target", "own", "unit",
        F.when(F.col("own") <= 0, 0.0).when(full, float("inf")).otherwise(0.0).alias("lam"),
        F.when(grows, 0.0).otherwise(bottom).alias("lo"), F.when(grows, top).otherwise(0.0).alias("hi"),
        ((F.col("own") <= 0) | full).alias("done"), F.when(full, F.col("own") * most).otherwise(0.0).alias("g"),
    )
    last = None
    for _ in range(steps):
        now = materialise(now, "mixing-dual")
        if last is not None:
            discard(last)
        last = now
        if now.where("NOT done").limit(1).count() == 0:
            break
        q = rate(F.col("lam"), F.col("size"), F.col("unit"), most)
        words = F.col("n") * F.col("size") * q
        slope = F.when(q < most * (1 - 1e-12), words * F.col("size") / F.col("unit")).otherwise(0.0)
        sums = counts.join(now.where("NOT done"), F.col("source").eqNullSafe(F.col("s"))).groupBy(F.col("s").alias("z")).agg(F.sum(words).alias("sum"), F.sum(slope).alias("slope"), F.count(F.lit(1)).alias("rows"))
        nxt = now.join(sums, F.col("s").eqNullSafe(F.col("z")) & F.col("rows").isNotNull(), "left")
        low = F.when(F.col("sum") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("sum") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + (F.col("target") - F.col("sum")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        met = F.abs(F.col("sum") - F.col("target")) <= F.col("target") * tolerance
        nxt = nxt.withColumns({"low": low, "high": high}).withColumn("step", F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        now = nxt.select(
            "s", "target", "own", "unit", F.when(F.col("done") | met, F.col("lam")).otherwise(F.col("step")).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(F.col("low")).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(F.col("high")).alias("hi"),
            (F.col("done") | met).alias("done"), F.coalesce("sum", "g").alias("g"),
        )
    return now.select(F.col("s").alias("source"), "lam", "unit", "g")


def _diffuse(group: pa.Table, most: int) -> pa.Table:
    """Adds total, the copies of all rows of a kind together."""
    group = group.take(pc.sort_indices(group, [("size", "descending"), ("doc_key", "ascending"), ("copy_key", "ascending")]))
    kinds = list(zip(group["size"].to_pylist(), group["rate"].to_pylist(), group["rows"].to_pylist(), strict=True))
    owed, totals = 0.0, []
    for size, r, rows in kinds:
        owed += size * r * rows
        low, high = math.floor(r + 1e-9), min(most, math.ceil(r - 1e-9))
        n = min(high * rows, max(low * rows, math.floor(owed / size + 0.5)))
        totals.append(n)
        owed -= n * size
    # what those bounds left over goes to few documents, the longest that take some of it
    for k, (size, _, rows) in enumerate(kinds):
        n = min(most * rows, max(0, totals[k] + math.floor(owed / size + 0.5)))
        owed -= (n - totals[k]) * size
        totals[k] = n
    return group.append_column("total", pa.array(totals, pa.int64()))


def mix(df: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, group_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size (words), source_size, target (its source's), rate, copies, taken (copies x size).

    Null and empty texts have size 0, rate 1 and no copies; a null source is a source, the last. Rows that repeat id,
    source and text share the copies that they have together as evenly as may be; an id with several texts is several
    documents. An empty table gives an empty result. Other columns are not read. Reruns agree: groups and order depend on
    the rows alone; ties in size go by hashes of id and text.
    """
    text = F.col(f"`{text_col}`").cast("string")
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("copy_key"))
    docs = materialise(docs.groupBy("doc_id", "source", "size", "copy_key").agg(F.count(F.lit(1)).alias("rows")), "mixing-sizes")
    counts = materialise(docs.groupBy("source", "size").agg(F.sum("rows").alias("n")), "mixing-counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = targets(totals.select("source", "source_size"), weights, most)
    lam = newton(counts, goals, most)
    facts = totals.alias("t").join(goals.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")))
    facts = materialise(facts.select("t.source", "t.source_size", "g.target", "l.lam", "l.unit", F.ceil(F.col("n_docs") / group_rows).cast("long").alias("groups")), "mixing-facts")
    rated = docs.alias("d").join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
    share = F.when(F.col("d.size") > 0, rate(F.col("f.lam"), F.col("d.size"), F.col("f.unit"), most)).otherwise(1.0)
    rated = rated.select("d.doc_id", "d.source", "d.size", "d.copy_key", "d.rows", "f.source_size", "f.target", share.alias("rate"), F.pmod(F.xxhash64("d.doc_id", "d.copy_key"), F.col("f.groups")).alias("grp"))
    rated = rated.withColumn("doc_key", F.xxhash64("doc_id"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rated.schema) + ", total bigint"
    dealt = rated.where("size > 0").groupBy("source", "grp").applyInArrow(lambda g: _diffuse(g, most), schema)
    dealt = dealt.union(rated.where("size = 0").withColumn("total", F.lit(0).cast("long")))
    rows = dealt.withColumn("k", F.explode(F.expr("sequence(1L, rows)")))
    copies = F.expr("total div rows") + F.when(F.col("k") <= F.expr("total % rows"), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
