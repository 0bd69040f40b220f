"""Result reports: `key=value` lines of bench runs, one file a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(result: dict, prefix: str = "") -> list[str]:
    """A (nested) result as key=value lines; keys of inner ones are joined by dots."""
    out = []
    for k, v in result.items():
        out += lines(v, f"{prefix}{k}.") if isinstance(v, dict) else [f"{prefix}{k}={v}"]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """run (file), key, value (a number, else null) and text of all reports below path; lines without `=` are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("run"), "value")
    pair = rows.select("run", F.regexp_extract("value", r"^\s*([^=\s]+)=(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*([^=\s]+)=(.*?)\s*$", 2).alias("text"))
    return pair.where("key <> ''").select("run", "key", F.expr("try_cast(text AS double)").alias("value"), "text")
