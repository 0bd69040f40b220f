"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Where materialised tables are.
_STORED: dict[int, tuple[weakref.ref, str]] = {}

#: Characters that separate words where a contract speaks of `[^\x20\x09-\x0D]+`.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session may do without the setting; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='quiverlake-')}"
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quiverlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` made and that nothing reads any more: all that came of them has been written."""
    for df in tables:
        found = _STORED.pop(id(df), None)
        if found and found[0]() is df:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


#: A key with more rows than this is hot; at most so many hot keys are broadcast.
HOT_ROWS = HOT_KEYS = 100_000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row a key and in `weight` (not returned) how many rows of left it meets.

    rows: those of left, or more. Keys that meet more than HOT_ROWS and more than a HOT_KEYS-th of them, of which there are
    fewer than HOT_KEYS, are broadcast, so that their rows stay where they are; the others are joined by shuffle.
    """
    if rows <= HOT_ROWS:
        return left.join(right.drop(weight), on, how)
    heavy = F.col(weight) > max(HOT_ROWS, rows // HOT_KEYS)
    hot = right.where(heavy).drop(weight)
    met = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~heavy).drop(weight), on, how)
    return met.unionByName(rest)


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
