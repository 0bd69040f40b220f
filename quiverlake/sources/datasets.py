"""Named datasets, Parquet vectors, splits and the cache of exact results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name to (file, format, splits); fixed values.
DATASETS = {
    "glove": ("glove-200-angular.hdf5", "hdf5", ("train", "test")),
    "sift1m": ("sift-128-euclidean.hdf5", "hdf5", ("train", "test")),
    "openai-1536": ("openai-1536.npy", "npy", ("train",)),
    "openai-3072": ("openai-3072.npy", "npy", ("train",)),
}


def resolve(name: str, data_dir: str, split: str = "train") -> tuple[str, str]:
    """(path, format) of a named dataset."""
    known = DATASETS.get({"sift": "sift1m"}.get(name, name))
    if known is None:
        raise ValueError(f"unknown dataset {name}")
    if split not in known[2]:
        raise ValueError(f"{name} has no split {split}")
    return f"{data_dir}/{known[0]}", known[1]


def read_hdf5(spark: SparkSession, path: str, split: str, step: int = 1024) -> DataFrame:
    """id, vec of one dataset of an HDF5 file, read where tasks run; needs the optional h5py."""
    import h5py

    with h5py.File(path, "r") as f:
        rows = f[split].shape[0]

    def run(batches):
        import h5py as h5
        import pyarrow as pa

        with h5.File(path, "r") as f:
            for b in batches:
                for lo in b.column(0).to_pylist():
                    x = f[split][lo : lo + step].astype("float32")
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(x)), pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["id", "vec"])

    return spark.range(0, rows, step).mapInArrow(run, "id bigint, vec array<float>")


def open_dataset(spark: SparkSession, name: str, data_dir: str, split: str = "train", query_limit: int = 1000, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) of a named dataset: its test split where it has one, else the last rows held out."""
    from quiverlake.sources import npy

    path, kind = resolve(name, data_dir, split)
    if kind == "npy":
        return holdout(npy.read_npy(spark, path), query_limit, limit)
    corpus = read_hdf5(spark, path, split)
    corpus = corpus.where(F.col("id") < limit) if limit else corpus
    asked = read_hdf5(spark, path, "test").withColumnRenamed("id", "qid")
    return corpus, asked.where(F.col("qid") < query_limit) if query_limit else asked


def read_vectors(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of a Parquet table with a list column; only these two columns are read."""
    return spark.read.parquet(path).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def meta(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """dim_min, dim_max, n_rows."""
    return df.agg(F.min(F.size(vec_col)).cast("bigint").alias("dim_min"), F.max(F.size(vec_col)).cast("bigint").alias("dim_max"), F.count(F.lit(1)).alias("n_rows"))


def validate(df: DataFrame, dim: int, rows: int | None = None) -> None:
    m = meta(df).first()
    if m["n_rows"] and (m["dim_min"], m["dim_max"]) != (dim, dim) or rows is not None and m["n_rows"] != rows:
        raise ValueError(f"expected {rows} vectors of {dim}, found {m['n_rows']} of {m['dim_min']} to {m['dim_max']}")


def convert(spark: SparkSession, source: DataFrame, target: str, dim: int, force: bool = False) -> DataFrame:
    """Writes the vectors as Parquet unless a valid copy is there."""
    if not force:
        try:
            there = spark.read.parquet(target)
            validate(there, dim)
            return there
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    validate(source, dim)
    source.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def holdout(df: DataFrame, query_limit: int, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries): of the first limit + query_limit ids (all, if either is 0) the last query_limit are queries; with no more rows than that, queries are the corpus."""
    rows = df.where(F.col("id") < limit + query_limit) if limit and query_limit else df.where(F.col("id") < limit) if limit else df
    n = rows.agg(F.max("id")).first()[0]
    edge = (n + 1 if n is not None else 0) - query_limit
    as_queries = rows.withColumnRenamed("id", "qid")
    if edge <= 0:
        return rows, as_queries
    return rows.where(F.col("id") < edge), as_queries.where(F.col("qid") >= edge)


def fingerprint(df: DataFrame) -> dict:
    """Rows of df and a hash of all their values that no order of rows changes."""
    h = F.xxhash64(*df.columns)
    n, x, total = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": f"{x}/{total}"}


def cached(spark: SparkSession, root: str, key: dict, make) -> DataFrame:
    """The result of make() as Parquet under a key; read again while all of the key is the same. The key should hold the fingerprints of what make() reads."""
    text = repr(sorted(key.items()))
    path = f"{root}/key={hashlib.sha256(text.encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
