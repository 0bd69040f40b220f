"""Checks and converts named datasets that have been put into a folder; nothing is downloaded.

`python -m quiverlake.sources.prepare [NAME ... | all] [--data-dir DIR] [--force]` checks every file and writes its vectors
as Parquet beside it (DIR/NAME/SPLIT.parquet). Valid copies stay, unless --force. Shards of an embeddings dataset
(DIR/shards/NAME/*.parquet) take the place of its NPY file.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiverlake.sources import datasets, npy

#: Shape of the embeddings datasets, least size of an HDF5 file, its first bytes, and the vectors' column in shards (fixed values).
ROWS, LEAST_BYTES, HDF5 = 1_000_000, 100_000_000, b"\x89HDF\r\n\x1a\n"
COLUMN = "text-embedding-3-large-{dim}-embedding"


def check_hdf5(path: str, least: int = LEAST_BYTES) -> None:
    if os.path.getsize(path) < least:
        raise ValueError(f"{path} is too small")
    with open(path, "rb") as f:
        if f.read(8) != HDF5:
            raise ValueError(f"{path} is no HDF5 file")


def check_npy(path: str, dim: int, rows: int = ROWS) -> None:
    with open(path, "rb") as f:
        shape = npy.header(f)[:2]
    if shape != (rows, dim):
        raise ValueError(f"{path} has shape {shape}, not {(rows, dim)}")


def from_shards(spark: SparkSession, folder: str, dim: int) -> DataFrame:
    """id, vec of Parquet shards; ids count the rows of the files in order of their names."""
    column = COLUMN.format(dim=dim)
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"), F.col(f"`{column}`").cast("array<float>").alias("vec"))
    before = F.sum("n").over(W.orderBy("f").rowsBetween(W.unboundedPreceding, -1))  # as many rows as files
    files = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).select("f", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(files), "f").select((F.col("before") + F.col("r")).alias("id"), "vec")


def prepare(spark: SparkSession, name: str, data_dir: str, force: bool = False, rows: int = ROWS, least: int = LEAST_BYTES) -> dict[str, DataFrame]:
    """The checked splits of a named dataset, as Parquet tables (id, vec)."""
    path, kind = datasets.resolve(name, data_dir)
    name = {"sift": "sift1m"}.get(name, name)
    out = {}
    if kind == "hdf5":
        check_hdf5(path, least)
        for split in datasets.DATASETS[name][2]:
            source = datasets.read_hdf5(spark, path, split)
            out[split] = datasets.convert(spark, source, f"file://{data_dir}/{name}/{split}.parquet", datasets.meta(source).first()["dim_max"], force)
        return out
    dim = int(name.rsplit("-", 1)[1])
    if os.path.isdir(f"{data_dir}/shards/{name}"):
        source = from_shards(spark, f"file://{data_dir}/shards/{name}", dim)
        datasets.validate(source, dim, rows)
    else:
        check_npy(path, dim, rows)
        source = npy.read_npy(spark, path)
    out["train"] = datasets.convert(spark, source, f"file://{data_dir}/{name}/train.parquet", dim, force)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("names", nargs="+", choices=[*datasets.DATASETS, "sift", "all"])
    p.add_argument("--data-dir", default="data")
    p.add_argument("--force", action="store_true")
    o = p.parse_args(argv)
    if "all" in o.names and len(o.names) > 1:
        p.error("all stands alone")
    spark = SparkSession.builder.getOrCreate()
    for name in datasets.DATASETS if o.names == ["all"] else o.names:
        for split, table in prepare(spark, name, os.path.abspath(o.data_dir), o.force).items():
            m = datasets.meta(table).first()
            print(f"dataset={name} split={split} rows={m['n_rows']} dim={m['dim_max']}")


if __name__ == "__main__":
    main()
