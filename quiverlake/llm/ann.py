"""Approximate nearest neighbours by collision counting.

Every hash is one projection on a random direction. The rows are dealt once into blocks of bounded size; a block keeps one
sorted array of (projection, row) per hash. A query is the centre of a window in each array. Virtual rehashing widens
all windows together. A row collides once per window that it lies in, and rows with enough
collisions are verified with their exact distance. A block has done its part when, by the collisions to be expected at
this radius of a row as near as the k-th best so far, nearer rows have been verified with the confidence asked for (or
when its windows hold everything). So the radius, and with it the rows that are verified, follow from the data. The k best
of all blocks are the answer.

Queries go to the blocks in broadcasts of bounded size; a block is indexed once for each of these, and no row is copied.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiverlake.llm.common import materialise

#: Bytes of query vectors that are broadcast at a time; more queries take further passes over the blocks.
QUERY_BYTES = 32 << 20


def directions(dim: int, hashes: int, seed: int = 11) -> np.ndarray:
    """Random directions of unit length; orthogonal within each run of `dim`, which spreads the windows evenly."""
    rng = np.random.default_rng(seed)
    parts = []
    while sum(len(p) for p in parts) < hashes:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q.T)
    return np.concatenate(parts)[:hashes]


def needed(hashes: int, least: float, sure: float) -> float:
    """Radius, as a multiple of a row's distance, at which a row has `least` of the collisions with confidence `sure` (in standard deviations).

    A projection of a difference of length d on a random direction is about normal with deviation d / sqrt(dimensions);
    radius and distance are taken in these units, so it lies within r with probability erf(r / d / sqrt 2). Collisions are binomial.
    """
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = math.erf(mid / math.sqrt(2))
        if hashes * p - sure * math.sqrt(hashes * p * (1 - p)) >= least * hashes:
            hi = mid
        else:
            lo = mid
    return hi


class Block:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dirs: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.dirs = ids[order], x[order], dirs
        self.verified = 0
        n, m = len(ids), len(dirs)
        proj = self.x @ dirs.T
        # all arrays one after another, set apart so that one binary search serves them all
        self.gap = 4 * float(np.abs(proj).max(initial=1.0)) + 1
        self.sorted, self.rows = np.empty(m * n), np.empty(m * n, np.intp)
        for j in range(m):
            rows = np.argsort(proj[:, j], kind="stable")
            self.rows[j * n : (j + 1) * n] = rows
            self.sorted[j * n : (j + 1) * n] = proj[rows, j] + self.gap * j

    def search(self, qid: int, q: np.ndarray, k: int, least: float, sure: float, step: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to k rows, nearest first, ties to the smaller id.

        Until k rows are verified, those with the most collisions so far are, which gives the radius to widen to.
        """
        n, m = len(self.ids), len(self.dirs)
        edge = self.gap / 2 - 1e-9
        first = np.arange(m) * n
        at = np.clip(self.dirs @ q, -edge / 2, edge / 2) + self.gap * np.arange(m)
        need, reach_of = int(np.ceil(least * m)), needed(m, least, sure) / math.sqrt(len(q))
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        low = np.searchsorted(self.sorted, at)
        high = low.copy()
        ids, dist = np.zeros(0, self.ids.dtype), np.zeros(0)
        # the first windows hold about a twentieth of the rows
        half, first_rows = max(k, n // 40), min(n, 4 * k)
        r = float(np.median(np.minimum(at - self.sorted[np.maximum(low - half, first)], self.sorted[np.minimum(low + half, first + n - 1)] - at)))
        r = max(r, 1e-12)
        while True:
            whole = r > edge / 2
            if whole:
                lo, hi = first, first + n
            else:
                lo = np.minimum(low, np.searchsorted(self.sorted, at - r, "left"))
                hi = np.maximum(high, np.searchsorted(self.sorted, at + r, "right"))
            new = [self.rows[a:b] for a, b in zip([*lo.tolist(), *high.tolist()], [*low.tolist(), *hi.tolist()], strict=True) if a < b]
            low, high = lo, hi
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n)
            enough = need if len(dist) == k else min(need, int(np.partition(counts, n - first_rows)[n - first_rows]))
            fresh = np.flatnonzero((counts >= enough) & ~seen)
            if len(fresh):
                seen[fresh] = True
                self.verified += len(fresh)
                fresh = fresh[self.ids[fresh] != qid]
                d = self.x[fresh] - q
                ids = np.r_[ids, self.ids[fresh]]
                dist = np.r_[dist, np.sqrt(np.einsum("ij,ij->i", d, d))]
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            goal = reach_of * (dist[-1] if len(dist) == k else np.inf)
            if whole or r >= goal:
                return ids, dist
            r = min(max(r * 1.05, goal * step), goal) if np.isfinite(goal) else 2 * r


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", hashes: int = 128, least: float = 0.5, sure: float = 1.0, step: float = 0.8, block_rows: int = 50_000, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest rows of df for each row of queries (same columns): query_id, rank, vec_id, score.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id; a row is
    not its own neighbour. Rows without an id, and vectors that are null, zero, empty or hold null or non-finite components
    take no part; vectors of several lengths are searched each among those of its length. Rows that repeat an id count once
    (the smallest vector). With k candidates or fewer all are returned; empty tables give an empty result. Other columns
    are not read. hashes: projections; least: share of them in which a row must collide; sure: confidence, in standard
    deviations, that a nearer row has been met; step: share of the radius that follows from the k-th best so far to which the windows widen at first. Blocks are dealt by hash and of bounded size, so equal vectors, however
    many, spread over all blocks; the driver passes on the queries, `query_bytes` at a time.
    """
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0)

    def clean(t: DataFrame) -> DataFrame:
        return t.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(usable).groupBy("id").agg(F.min("v").alias("v"))

    spark, schema = df.sparkSession, "query_id bigint, vec_id bigint, score double"
    rows, asked = materialise(clean(df), "ann-rows"), materialise(clean(queries), "ann-queries")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))  # no more rows than the longest vector has components
    blocks = materialise(rows.join(F.broadcast(sizes), F.size("v") == F.col("d")).select("d", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("b"), "id", "v"), "ann-blocks")

    def matrix(t: pa.Table, dim: int) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def chunks():
        """Queries by dimension, as (ids, vectors), `query_bytes` or less together."""
        got, size = {}, 0
        for qid, q in asked.toLocalIterator():
            ids, vectors = got.setdefault(len(q), ([], []))
            ids.append(qid)
            vectors.append(np.array(q))
            size += 8 * len(q) + 200
            if size >= query_bytes:
                yield {d: (i, np.array(x)) for d, (i, x) in got.items()}
                got, size = {}, 0
        if got:
            yield {d: (i, np.array(x)) for d, (i, x) in got.items()}

    def searcher(shared):
        def run(key, t):
            dim = key[0].as_py()
            qids, found_ids, dists = [], [], []
            if dim in shared.value:
                index = Block(t["id"].to_numpy(), matrix(t, dim), directions(dim, hashes))
                for qid, q in zip(*shared.value[dim], strict=True):
                    ids, d = index.search(qid, q, k, least, sure, step)
                    qids.append(np.full(len(ids), qid))
                    found_ids.append(ids)
                    dists.append(d)
            none = [np.zeros(0)]
            return pa.table({"query_id": pa.array(np.concatenate(qids or none).astype(np.int64)), "vec_id": pa.array(np.concatenate(found_ids or none).astype(np.int64)), "score": pa.array(np.concatenate(dists or none))})

        return run

    out = None
    for chunk in chunks():
        part = blocks.groupBy("d", "b").applyInArrow(searcher(spark.sparkContext.broadcast(chunk)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
