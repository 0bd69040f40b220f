"""Per-coordinate calibration of rotated unit vectors, and data-driven levels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiverlake.functions import constants as C
from quiverlake.operators.model import matrix, normalise


def tails(dim: int, bits: int) -> tuple[float, float, float]:
    """(outer centroid, lower and upper probability of it)."""
    outer = float(C.codebook(bits, dim)[1][-1])
    hi = C.beta_cdf((dim - 1) / 2, (outer + 1) / 2)
    return outer, 1 - hi, hi


def coordinates(df: DataFrame, dim: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """d, x: every coordinate of the rotated unit vectors."""

    def run(batches):
        for b in batches:
            y = C.rotate(normalise(matrix(b.column(1), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(dim, dtype=np.int32), len(y))), pa.array(y.ravel())], ["d", "x"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vec_col).cast("array<float>")).mapInArrow(run, "d int, x double")


def _histograms(df: DataFrame, dim: int, reach: float, bins: int) -> DataFrame:
    """d, bin, c: how many coordinates fall on each bin; every task counts for itself."""

    def run(batches):
        counts = np.zeros(dim * bins, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                y = C.rotate(normalise(matrix(b.column(1).slice(lo, 1024), dim)))
                counts += np.bincount((_bin(y, reach, bins) + np.arange(dim) * bins).ravel(), minlength=dim * bins)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)), pa.array(counts[at])], ["d", "bin", "c"])

    return df.mapInArrow(run, "d int, bin int, c bigint").groupBy("d", "bin").agg(F.sum("c").alias("c"))


def _bin(y: np.ndarray, reach: float, bins: int) -> np.ndarray:
    return np.clip(np.floor((y + reach) / (2 * reach) * bins), 0, bins - 1).astype(np.int64)


def fit(df: DataFrame, dim: int, bits: int = 4, id_col: str = "id", vec_col: str = "vec", bins: int = 1024) -> DataFrame:
    """d, shift, scale from exact order statistics; the identity where their span is too small. Fewer than two rows are an error.

    A first pass counts coordinates on a grid, which brackets each order statistic by one bin; a second pass gives out
    the values of these bins alone, equal ones counted, and the statistic is selected among them. So next to nothing
    of the data is shuffled.
    """
    n = df.count()
    if n < 2:
        raise ValueError("calibration needs two rows or more")
    outer, p_lo, p_hi = tails(dim, bits)
    lo = math.floor(n * p_lo)
    hi = max(min(math.floor(n * p_hi), n - 1), lo + 1)
    reach = min(1.0, 8 / math.sqrt(dim))
    rows = df.select(F.col(id_col).cast("bigint"), F.col(vec_col).cast("array<float>"))
    upto = F.sum("c").over(W.partitionBy("d").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    bracket = _histograms(rows, dim, reach, bins).withColumn("upto", upto)
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit(lo).alias("at")), F.struct(F.lit(1).alias("side"), F.lit(hi).alias("at")))).alias("s")
    bracket = bracket.select("*", side).where((F.col("upto") > F.col("s.at")) & (F.col("upto") - F.col("c") <= F.col("s.at")))
    at, before = np.zeros((2, dim), np.int64), np.zeros((2, dim), np.int64)
    for d, s, k, below in bracket.select("d", "s.side", "bin", F.col("upto") - F.col("c")).collect():  # two rows a dimension
        at[s, d], before[s, d] = k, below

    def inside(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                y = C.rotate(normalise(matrix(b.column(1).slice(start, 1024), dim)))
                k = _bin(y, reach, bins)
                for s in (0, 1):
                    row, d = np.nonzero(k == at[s])
                    yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(np.full(len(d), s, np.int32)), pa.array(before[s, d]), pa.array(y[row, d])], ["d", "side", "below", "x"])

    counted = rows.mapInArrow(inside, "d int, side int, below bigint, x double").groupBy("d", "side", "below", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = counted.withColumn("upto", F.col("below") + F.sum("c").over(W.partitionBy("d", "side").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    q = ranked.groupBy("d").agg(F.min(F.when((F.col("side") == 0) & (F.col("upto") > lo), F.col("x"))).alias("q_lo"), F.min(F.when((F.col("side") == 1) & (F.col("upto") > hi), F.col("x"))).alias("q_hi"))
    flat = F.col("q_hi") - F.col("q_lo") <= 1e-12
    scale = F.when(flat, 1.0).otherwise(2 * outer / F.when(~flat, F.col("q_hi") - F.col("q_lo")))
    return q.select(F.col("d").cast("bigint").alias("d"), F.when(flat, 0.0).otherwise(-outer / scale - F.col("q_lo")).alias("shift"), scale.alias("scale"))


def empirical_codebook(values: DataFrame, column: str, bits: int = 4, rounds: int = 25) -> list[float]:
    """Lloyd-Max levels of a column: quantiles from 0.001 to 0.999 first, then means of the cells."""
    n = 2**bits
    levels = values.select(F.percentile(column, F.array(*(F.lit(float(x)) for x in np.linspace(0.001, 0.999, n)))).alias("q")).first()[0]
    for _ in range(rounds):
        edges = [(a + b) / 2 for a, b in zip(levels, levels[1:], strict=False)]
        cell = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges), F.lit(0))
        means = {r[0]: r[1] for r in values.groupBy(cell.alias("c")).agg(F.avg(column)).collect()}  # one row a level
        new = [means.get(c, levels[c]) for c in range(n)]
        if max(abs(a - b) for a, b in zip(new, levels, strict=True)) < 1e-12:
            break
        levels = new
    return levels
