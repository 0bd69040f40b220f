"""The vector model: normalise, rotate, quantise, project on landmarks, quantise again; its kernels run on Arrow batches."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import constants as C

INDEX_SCHEMA = "id bigint, codes binary, alpha double, resid double"
#: Rows of a matrix product taken at a time (see `products`).
BLOCK_ROWS = 384


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column; null and ragged vectors and null components are errors."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten()
    if col.null_count or flat.null_count or len(flat) != dim * len(col):
        raise ValueError(f"every vector must have {dim} components, none null")
    lengths = np.diff(col.offsets.to_numpy()) if hasattr(col, "offsets") else np.array([])
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"every vector must have {dim} components")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def normalise(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n < C.TINY_NORM, 0.0, x / np.where(n < C.TINY_NORM, 1.0, n))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T in blocks of BLOCK_ROWS rows of x, the last one padded with zeros.

    BLAS sums in another order for other shapes and in what is left beside its tiles, so equal rows of two batches could
    differ in the last bit and ties between them not fall to the smaller id. All blocks have one shape without such rests;
    this holds for one BLAS thread, which is what Spark gives a Python worker with one core a task.
    """
    out = np.empty((len(q), len(x)))
    for lo in range(0, len(x), BLOCK_ROWS):
        part = x[lo : lo + BLOCK_ROWS]
        n = len(part)
        out[:, lo : lo + n] = (q @ np.pad(part, ((0, BLOCK_ROWS - n), (0, 0))).T)[:, :n]
    return out


def ratio(a: np.ndarray, b: np.ndarray, tiny: float = 1e-12) -> np.ndarray:
    return np.where(b <= tiny, 0.0, a / np.where(b <= tiny, 1.0, b))


@dataclass(frozen=True)
class Model:
    """m = 0: no landmarks (the flat index). rerank_bits quantises vectors at ingest, bits the landmark space. project_first: project before quantising."""

    dim: int
    bits: int = 4
    m: int = 1024
    seed: int = 0
    rerank_bits: int = 0
    project_first: bool = False

    def __post_init__(self) -> None:
        C.check_shape(self.dim, self.bits, self.m or None)
        C.check_shape(self.dim, self.rerank_bits or self.bits)

    @property
    def width(self) -> int:
        return C.scan_dim(self.m) if self.m else self.dim

    def basis(self) -> np.ndarray:
        return C.landmark_basis(self.dim, self.m, self.seed)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha x quantised rotated unit vectors, and alpha."""
        y = C.rotate(normalise(x))
        bounds, cents = C.codebook(self.rerank_bits or self.bits, self.dim)
        yhat = cents[np.searchsorted(bounds, y, side="right")]
        alpha = ratio((y * yhat).sum(1), (yhat * yhat).sum(1))
        return yhat * alpha[:, None], alpha

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, alpha, residual norm) of the rows of x."""
        if not self.m or self.project_first:
            y = C.rotate(normalise(x))
            square = (y * y).sum(1)
        else:
            y, _ = self.scaled(x)
            square = (y * y).sum(1)
        land = self.pad(np.ascontiguousarray(products(self.basis().T, y).T)) if self.m else y
        resid = np.sqrt(np.maximum(0.0, square - (land * land).sum(1))) if self.m else np.zeros(len(x))
        norm = np.sqrt((land * land).sum(1))
        u = normalise(land)
        bounds, cents = C.codebook(self.bits, self.width)
        codes = np.searchsorted(bounds, u, side="left").astype(np.uint8)
        alpha = ratio(norm, (u * cents[codes]).sum(1))
        return codes, alpha, resid

    def prepare(self, q: np.ndarray, mode: str = "float") -> tuple[np.ndarray, np.ndarray]:
        """Queries in scan space and the norms of what landmarks miss. mode: float, or q4 (int8 queries on the 4-bit basis)."""
        y = C.rotate(normalise(q))
        if not self.m:
            return y, np.zeros(len(q))
        if mode == "q4":
            codes, scales = C.basis_q4(self.dim, self.m, self.seed)
            top = np.abs(y).max(axis=1, keepdims=True) / 127
            z = np.where(top > 0, y / np.where(top > 0, top, 1), 0.0)
            z = np.sign(z) * np.floor(np.abs(z) + 0.5)
            land = (z @ codes) * top * scales
        else:
            land = y @ self.basis()
        land = self.pad(land)
        return land, np.sqrt(np.maximum(0.0, (y * y).sum(1) - (land * land).sum(1)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as bytes: 2-bit codes four to a byte, others two; the first coordinate in the high bits."""
    per = 4 if bits == 2 else 2
    shifts = np.arange(per)[::-1] * (8 // per)
    return (codes.reshape(len(codes), -1, per).astype(np.uint8) << shifts.astype(np.uint8)).sum(axis=2).astype(np.uint8)


def unpack(flat: np.ndarray, bits: int) -> np.ndarray:
    per = 4 if bits == 2 else 2
    shifts = (np.arange(per)[::-1] * (8 // per)).astype(np.uint8)
    return ((flat[:, :, None] >> shifts) & np.uint8((1 << (8 // per)) - 1)).reshape(len(flat), -1)


def bit_planes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Plane after plane, lowest bit first, most significant bit of a byte first (an exchange format)."""
    return np.concatenate([np.packbits((codes >> p) & 1, axis=1) for p in range(bits)], axis=1)


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def codes_of(col: pa.Array, model: Model) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
    return unpack(raw.reshape(len(col), -1), model.bits)


def build(df: DataFrame, model: Model, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The index of df as rows (id, codes, alpha, resid): one pass, no shuffle. Vectors that are null or ragged are an error."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes, alpha, resid = model.encode(matrix(b.column(1), model.dim))
                yield pa.RecordBatch.from_arrays([b.column(0), binary(pack(codes, model.bits)), pa.array(alpha), pa.array(resid)], ["id", "codes", "alpha", "resid"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vec_col).cast("array<float>")).mapInArrow(run, INDEX_SCHEMA)


def save(index: DataFrame, model: Model, path: str, append: bool = False) -> None:
    """Writes index rows as a batch of their own; append adds to those there, streamed ones too, and refuses another model."""
    spark = index.sparkSession
    if append:
        if load(spark, path)[1] != model:
            raise ValueError("the index there was built by another model")
        batch = f"append-{uuid.uuid4().hex}"
    else:
        spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        batch = "first"
    rows = index.select("id", "codes", "alpha", "resid").withColumn("batch", F.lit(batch))
    rows.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(f"{path}/rows")


def load(spark, path: str) -> tuple[DataFrame, Model]:
    """All rows of a saved index (those of `save`, of appends and of streams) and its model."""
    model = Model(**json.loads(spark.read.text(f"{path}/model").first()[0]))
    rows = spark.read.schema(f"{INDEX_SCHEMA}, batch string").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.drop("batch"), model


def index_stats(index: DataFrame, model: Model) -> DataFrame:
    """n_rows, codes_bytes, index_bytes (codes, alpha and residual as 4-byte floats) and bytes per vector."""
    return index.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length("codes")), F.lit(0)).cast("bigint").alias("codes_bytes")).withColumn("index_bytes", F.col("codes_bytes") + F.col("n_rows") * 8).withColumn("bytes_per_vector", F.when(F.col("n_rows") > 0, F.col("index_bytes") / F.col("n_rows")))
