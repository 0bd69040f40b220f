"""Quality of results: qid, rank, id against exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cuts(k: int) -> list[int]:
    """1, 2, 4, ... 256 as far as k goes, and k."""
    return sorted({t for t in (1, 2, 4, 8, 16, 32, 64, 128, 256) if t <= k} | {k})


def recall_curve(found: DataFrame, exact: DataFrame, k: int, at: list[int] | None = None) -> DataFrame:
    """t, recall1 (share of queries whose nearest is among the first t found) and recall (mean overlap of the first t of both lists)."""
    at = at or cuts(k)
    pairs = exact.select("qid", "id", F.col("rank").alias("er")).join(found.select("qid", "id", F.col("rank").alias("fr")), ["qid", "id"], "full")
    t = F.explode(F.array(*(F.lit(x).cast("bigint") for x in at))).alias("t")
    per = pairs.select("qid", "er", "fr", t).groupBy("qid", "t").agg(
        F.count(F.when((F.col("er") <= F.col("t")) & (F.col("fr") <= F.col("t")), 1)).alias("both"),
        F.count(F.when(F.col("er") <= F.col("t"), 1)).alias("n_exact"),
        F.count(F.when(F.col("fr") <= F.col("t"), 1)).alias("n_found"),
        F.max(F.when((F.col("er") == 1) & (F.col("fr") <= F.col("t")), 1).otherwise(0)).alias("first"),
    )
    most = F.least("n_exact", "n_found", "t")
    return per.groupBy("t").agg(F.avg("first").alias("recall1"), F.avg(F.when(most > 0, F.col("both") / most).otherwise(0.0)).alias("recall"))


def coverage(candidates: DataFrame, exact: DataFrame, t: int) -> DataFrame:
    """Share of the true first t that the candidates (qid, id) hold, over all queries, and whether they hold the nearest."""
    hit = exact.where(F.col("rank") <= t).join(candidates.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return hit.groupBy("qid").agg(F.avg("hit").alias("part"), F.max(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).alias("first")).agg(F.avg("part").alias("coverage"), F.avg("first").alias("nn_found"))


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no row with smaller (or equal) x beats or equals in y; of rows equal in both the first by the other columns.

    Only the best row of each x meets the others, so what is ordered in one task is the different values of a sweep.
    """
    others = [c for c in df.columns if c not in (x, y)]
    best = df.groupBy(x).agg(F.min(F.struct(y, *others)).alias("_s")).select(x, "_s.*")
    w = W.orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    return best.withColumn("_best", F.min(y).over(w)).where(F.col("_best").isNull() | (F.col(y) < F.col("_best"))).select(*df.columns)


def least_product(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row with the smallest x x y (ties: smaller x, then smaller y)."""
    return df.orderBy(F.col(x) * F.col(y), x, y).limit(1)


def summary(df: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """Per configuration: runs, mean, median (of an even number the upper one) and sample deviation (null for one run)."""
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return df.groupBy(*by).agg(F.count(value).alias("runs"), F.round(F.avg(value), digits).alias("mean"), F.round(median, digits).alias("median"), F.round(F.stddev_samp(value), digits).alias("std"))


def tune(run, values: list[int], target: float) -> tuple[int | None, list[tuple[int, float]]]:
    """Smallest of the ascending values for which run(value), a recall, reaches the target: doubling steps, then bisection."""
    seen: list[tuple[int, float]] = []

    def good(k: int) -> bool:
        seen.append((values[k], run(values[k])))
        return seen[-1][1] >= target

    step, low = 1, -1
    while low + step < len(values) and not good(low + step):
        low, step = low + step, step * 2
    high = low + step
    if high >= len(values):
        if low == len(values) - 1 or not good(len(values) - 1):
            return None, seen
        high = len(values) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return values[high], seen
