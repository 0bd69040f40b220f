"""NPY matrices as a Spark data source: float32, two dimensions, C order. Row ranges are read in parallel."""

from __future__ import annotations

import ast
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def header(f) -> tuple[int, int, int]:
    """(rows, columns, offset of the data) of an open NPY file."""
    if f.read(6) != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    major = f.read(2)[0]
    if major not in (1, 2):
        raise ValueError(f"NPY version {major} is not known")
    size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
    spec = ast.literal_eval(f.read(size).decode("latin1"))
    if spec["descr"] != "<f4" or spec["fortran_order"] or len(spec["shape"]) != 2:
        raise ValueError("only two-dimensional little-endian float32 matrices in C order are read")
    at = f.tell()
    rows, cols = spec["shape"]
    f.seek(0, 2)
    if f.tell() - at < rows * cols * 4:
        raise ValueError("the NPY file is cut short")
    return rows, cols, at


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("rows_per_partition", 100_000))
        with open(self.path, "rb") as f:
            self.rows, self.cols, self.at = header(f)

    def partitions(self):
        return [_Rows(lo, min(lo + self.step, self.rows)) for lo in range(0, self.rows, self.step)] or [_Rows(0, 0)]

    def read(self, partition):
        step = max(1, 8_000_000 // max(1, self.cols))
        with open(self.path, "rb") as f:
            for lo in range(partition.lo, partition.hi, step):
                hi = min(lo + step, partition.hi)
                f.seek(self.at + lo * self.cols * 4)
                flat = np.frombuffer(f.read((hi - lo) * self.cols * 4), "<f4")
                offsets = pa.array(np.arange(0, len(flat) + 1, self.cols, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "vec"])


class NpyDataSource(DataSource):
    """format("npy"), option path: id (row number) and vec. The path is opened where tasks run, so it must be on a shared mount."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id bigint, vec array<float>"

    def reader(self, schema):
        return _Reader(self.options)


def read_npy(spark, path: str, rows_per_partition: int = 100_000):
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("rows_per_partition", rows_per_partition).load(path)


def write_npy(df, path: str, id_col: str = "id", vec_col: str = "vec", part_bytes: int = 64 << 20) -> None:
    """One NPY file for exchange with other tools, rows by id. `path` must be on a mount that driver and tasks share.

    Ranges of ids of about `part_bytes` each are written by tasks, every one at its own place in the file; a task that
    runs again writes the same bytes. Null and ragged vectors are errors.
    """
    if "://" in path:
        raise ValueError("an NPY file is written to a shared mount, not to a store")
    from pyspark.sql import functions as F

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.coalesce(F.size("vec"), F.lit(-1))), F.max(F.size("vec"))).first()
    if n and (least != most or least < 0):
        raise ValueError("null or ragged vectors")
    cols = most or 0
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, cols)})
        start = f.tell()
        f.truncate(start + 4 * n * cols)
    if not n or not cols:
        return
    parts = max(1, -(-4 * n * cols // part_bytes))
    edges = np.unique(rows.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts)) if parts > 1 else np.zeros(0)

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, b.column(0).to_numpy(), "right").astype(np.int32)), *b.columns], ["part", "id", "vec"])

    dealt = rows.mapInArrow(deal, "part int, id bigint, vec array<float>")
    sizes = dict(dealt.groupBy("part").count().collect())  # as many rows as parts
    first = np.cumsum([0] + [sizes.get(k, 0) for k in range(len(edges) + 1)])

    def put(key, t):
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, cols)[order]
        with open(path, "r+b") as f:
            f.seek(start + 4 * cols * int(first[key[0].as_py()]))
            f.write(flat.tobytes())
        return pa.table({"n": pa.array([len(flat)], pa.int64())})

    if dealt.groupBy("part").applyInArrow(put, "n bigint").agg(F.sum("n")).first()[0] != n:
        raise ValueError("the rows changed while they were written")
