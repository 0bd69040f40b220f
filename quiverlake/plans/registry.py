"""All registered queries of the vector engine, and their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import constants as C
from quiverlake.functions import vector as V
from quiverlake.operators import calibration, metrics
from quiverlake.operators import model as M
from quiverlake.operators import search as S
from quiverlake.plans import sql as Q
from quiverlake.plans.sql import BITS, DIM, K, NQ, wrap
from quiverlake.sources import datasets, npy

MODEL = M.Model(DIM, BITS, Q.M)
FLAT = M.Model(DIM, BITS, 0)
FIRST = M.Model(DIM, BITS, Q.M, project_first=True)

_LOCAL: dict[str, str] = {}
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.read_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return datasets.holdout(vectors(spark, sf_dir), NQ)


def result(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "id", V.round6(F.col("score")).alias("score"))


def exact(spark, sf_dir, k: int = K) -> DataFrame:
    corpus, asked = split(spark, sf_dir)
    return S.exact_topk(corpus, asked, DIM, k)


def found(spark, sf_dir, k: int = K, model: M.Model = MODEL, **options) -> DataFrame:
    corpus, asked = split(spark, sf_dir)
    return S.landmark_search(M.build(corpus, model), asked, model, k, **options)


def per_row(df: DataFrame, fn, schema: str, key: str = "id") -> DataFrame:
    """fn(matrix) -> columns after the key, over Arrow batches of (key, vec)."""

    def run(batches):
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *fn(M.matrix(b.column(1), DIM))], names)

    return df.select(key, "vec").mapInArrow(run, schema)


def lists(x: np.ndarray, kind=None) -> pa.Array:
    kind = kind or pa.float64()
    return pa.array(list(x), pa.list_(kind))


def long(df: DataFrame, key: str, col: str, value: str, rounded: bool = True) -> DataFrame:
    """One row per component: key, d, value."""
    out = df.select(key, F.posexplode(col).alias("d", value))
    return out.select(key, F.col("d").cast("bigint").alias("d"), V.round6(F.col(value)).alias(value) if rounded else F.col(value).cast("bigint").alias(value))


def sql_long(source: str, key: str, col: str, value: str, rounded: bool = True) -> str:
    shown = f"round({value}, 6) + 0.0" if rounded else f"{value}::BIGINT"
    return f"SELECT {key}, d - 1 AS d, {shown} AS {value} FROM (SELECT {key}, unnest({col}) AS {value}, generate_subscripts({col}, 1) AS d FROM {source})"


# scans and filters


@query(f"WITH {Q.BASE} SELECT id, len(v) AS dim, round(v[1], 6) + 0.0 AS first, round(v[{DIM}], 6) + 0.0 AS last FROM e")
def scan_embeddings(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.size("vec").cast("bigint").alias("dim"), V.round6(F.col("vec")[0].cast("double")).alias("first"), V.round6(F.col("vec")[DIM - 1].cast("double")).alias("last"))


@query(f"WITH {Q.BASE} SELECT id FROM e WHERE id < 100")
def scan_limit(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.col("id") < 100).select("id")


@query("SELECT min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max, count(*) AS n_rows FROM embeddings")
def dataset_meta(spark, sf_dir):
    return datasets.meta(vectors(spark, sf_dir))


@query(f"WITH {Q.BASE} SELECT 'corpus' AS part, count(*) AS n_rows, min(id) AS first, max(id) AS last FROM corpus UNION ALL SELECT 'queries', count(*), min(qid), max(qid) FROM queries")
def holdout_split(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return corpus.select(F.lit("corpus").alias("part"), "id").union(asked.select(F.lit("queries"), "qid")).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(wrap(Q.BASE, Q.EXACT, select=f"SELECT * FROM ({Q.OUT} ({Q.best('exact_s')})) WHERE qid % 7 = 0"))
def query_subset(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.exact_topk(corpus, asked.where(F.col("qid") % 7 == 0), DIM, K))


@query(f"WITH {Q.BASE} SELECT round(avg(n), 6) + 0.0 AS norm_mean, round(min(n), 6) + 0.0 AS norm_min, round(max(n), 6) + 0.0 AS norm_max, count(*) AS n_rows FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM e)")
def norm_stats(spark, sf_dir):
    n = vectors(spark, sf_dir).select(V.vec_norm("vec").alias("n"))
    return n.agg(V.round6(F.avg("n")).alias("norm_mean"), V.round6(F.min("n")).alias("norm_min"), V.round6(F.max("n")).alias("norm_max"), F.count(F.lit(1)).alias("n_rows"))


# column functions


@query(wrap(Q.BASE, select="SELECT qid, id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS dot FROM queries q, corpus c"))
def dot_product(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    rows = corpus.select("id", F.col("vec").cast("array<float>"))
    dots = S.all_scores(rows, asked, DIM, lambda q: q, lambda q, b, pairs=None: S.product(q, M.matrix(b.column(1), DIM), pairs))
    return dots.select("qid", "id", V.round6(F.col("score")).alias("dot"))


@query(f"WITH {Q.BASE} SELECT id, sqrt(list_dot_product(v, v)) AS norm FROM e")
def l2_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", V.vec_norm("vec").alias("norm"))


@query(wrap(Q.BASE, Q.unit("cu", "corpus", "id"), select=sql_long("cu", "id", "u", "x")))
def l2_normalize(spark, sf_dir):
    corpus, _ = split(spark, sf_dir)
    return long(corpus.select("id", "vec", V.vec_norm("vec").alias("n")).select("id", V.vec_normalize("vec", F.col("n")).alias("u")), "id", "u", "x")


@query(wrap(Q.BASE, Q.constants(), select="SELECT d - 1 AS d, round(x, 6) + 0.0 AS x, id FROM (SELECT id, unnest(y) AS x, generate_subscripts(y, 1) AS d FROM (SELECT id, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: v[j + 1] * (CASE WHEN bit_count(i & j) % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE)) / 8) AS y FROM corpus))"))
def fwht(spark, sf_dir):
    def run(x):
        y = x.copy()
        for w in (1, 2, 4, 8, 16, 32):
            y = y.reshape(len(x), -1, 2, w)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), DIM)
        return [lists(y / 8)]

    return long(per_row(split(spark, sf_dir)[0], run, "id bigint, y array<double>"), "id", "y", "x")


@query(wrap(Q.BASE, Q.constants(), Q.rotated("r", "corpus", "id"), select=sql_long("r", "id", "y", "x")))
def rotate(spark, sf_dir):
    return long(per_row(split(spark, sf_dir)[0], lambda x: [lists(C.rotate(M.normalise(x)))], "id bigint, y array<double>"), "id", "y", "x")


# constants


def values(columns: str, data) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in data)}) AS t({columns})"


def _rotation_rows():
    signs, perm, _ = C.rotation(DIM)
    return [(i, int(signs[i]), int(perm[i])) for i in range(DIM)]


@query("SELECT d::BIGINT AS d, sign::BIGINT AS sign, source::BIGINT AS source FROM (" + values("d, sign, source", _rotation_rows()) + ")")
def rotation_constants(spark, sf_dir):
    return spark.createDataFrame(_rotation_rows(), "d bigint, sign bigint, source bigint")


def _codebook_rows():
    return [(b, i, round(float(c), 7)) for b in (2, 3, 4) for i, c in enumerate(C.codebook(b, DIM)[1])]


@query("SELECT bits::BIGINT AS bits, level::BIGINT AS level, centroid::DOUBLE AS centroid FROM (" + values("bits, level, centroid", _codebook_rows()) + ")")
def codebook(spark, sf_dir):
    return spark.createDataFrame(_codebook_rows(), "bits bigint, level bigint, centroid double")


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS dot FROM range(48) a(i), range(48) b(j)")
def landmark_basis(spark, sf_dir):
    """Dot products of the basis' columns."""
    cols = spark.createDataFrame([(j, [float(x) for x in c]) for j, c in enumerate(C.landmark_basis(DIM, Q.M).T)], "j bigint, vec array<double>")
    dots = S.all_scores(cols, cols.withColumnRenamed("j", "qid"), DIM, lambda q: q, lambda q, b, pairs=None: S.product(q, M.matrix(b.column(1), DIM), pairs))
    return dots.select(F.col("qid").alias("i"), F.col("id").alias("j"), (F.round("score", 5) + F.lit(0.0)).alias("dot"))


@query(wrap(Q.constants(), "c AS (SELECT unnest(land) AS v, generate_subscripts(land, 1) - 1 AS j FROM k), s AS (SELECT j, v, list_max(list_transform(v, lambda x: abs(x))) / 7 AS scale FROM c)", select="SELECT j, d - 1 AS d, (sign(x / scale) * floor(abs(x / scale) + 0.5))::BIGINT AS code FROM (SELECT j, scale, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM s)"))
def basis_q4(spark, sf_dir):
    codes, _ = C.basis_q4(DIM, Q.M)
    return spark.createDataFrame([(j, d, int(codes[d, j])) for j in range(Q.M) for d in range(DIM)], "j bigint, d bigint, code bigint")


# encoder steps


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=sql_long("corpus_a", "id", "codes", "code", False)))
def quantize_codes(spark, sf_dir):
    bounds, _ = C.codebook(BITS, DIM)
    return long(per_row(split(spark, sf_dir)[0], lambda x: [lists(np.searchsorted(bounds, C.rotate(M.normalise(x)), side="right"), pa.int64())], "id bigint, c array<bigint>"), "id", "c", "code", False)


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select="SELECT id, round(alpha, 6) + 0.0 AS alpha FROM corpus_a"))
def encode_alpha(spark, sf_dir):
    return per_row(split(spark, sf_dir)[0], lambda x: [pa.array(MODEL.scaled(x)[1])], "id bigint, alpha double").select("id", V.round6(F.col("alpha")).alias("alpha"))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=sql_long("corpus_l", "id", "land", "x")))
def landmark_project(spark, sf_dir):
    return long(per_row(split(spark, sf_dir)[0], lambda x: [lists(MODEL.scaled(x)[0] @ MODEL.basis())], "id bigint, l array<double>"), "id", "l", "x")


def index(spark, sf_dir, model=MODEL) -> DataFrame:
    return M.build(split(spark, sf_dir)[0], model)


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select="SELECT id, round(resid, 6) + 0.0 AS resid FROM idx"))
def residual_norm(spark, sf_dir):
    return index(spark, sf_dir).select("id", V.round6(F.col("resid")).alias("resid"))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select="SELECT id, round(alpha, 6) + 0.0 AS alpha, round(resid, 6) + 0.0 AS resid FROM idx"))
def landmark_encode(spark, sf_dir):
    return index(spark, sf_dir).select("id", V.round6(F.col("alpha")).alias("alpha"), V.round6(F.col("resid")).alias("resid"))


def unpacked(df: DataFrame, model=MODEL, shift: int = 0) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), lists(M.codes_of(b.column(1), model) >> shift, pa.int64())], ["id", "c"])

    return long(df.select("id", "codes").mapInArrow(run, "id bigint, c array<bigint>"), "id", "c", "code", False)


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=sql_long("idx", "id", "codes", "code", False)))
def quantize_landmarks(spark, sf_dir):
    return unpacked(index(spark, sf_dir))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), "sg AS (SELECT id, list_transform(codes, lambda c: c // 8) AS s FROM idx)", select=sql_long("sg", "id", "s", "code", False)))
def sign_plane(spark, sf_dir):
    return unpacked(index(spark, sf_dir), shift=BITS - 1)


HEX = "upper(list_aggregate(list_transform(codes, lambda c: format('{:x}', c)), 'string_agg', ''))"


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=f"SELECT id, {HEX} AS codes FROM idx"))
def pack_codes(spark, sf_dir):
    return index(spark, sf_dir).select("id", F.hex("codes").alias("codes"))


INDEX_ROWS = f"SELECT id, {HEX} AS codes, round(alpha, 6) + 0.0 AS alpha, round(resid, 6) + 0.0 AS resid FROM idx"


def index_rows(df: DataFrame) -> DataFrame:
    return df.select("id", F.hex("codes").alias("codes"), V.round6(F.col("alpha")).alias("alpha"), V.round6(F.col("resid")).alias("resid"))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=INDEX_ROWS))
def build_index(spark, sf_dir):
    return index_rows(index(spark, sf_dir))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), select=INDEX_ROWS))
def append_index(spark, sf_dir):
    """Built in two parts."""
    corpus, _ = split(spark, sf_dir)
    return index_rows(M.build(corpus.where("id % 2 = 0"), MODEL).unionByName(M.build(corpus.where("id % 2 = 1"), MODEL)))


@query(f"WITH {Q.BASE} SELECT count(*) AS n_rows, count(*) * 24 AS codes_bytes, count(*) * 32 AS index_bytes, 32.0::DOUBLE AS bytes_per_vector FROM corpus")
def index_stats(spark, sf_dir):
    return M.index_stats(index(spark, sf_dir), MODEL)


@query(wrap(Q.BASE, Q.constants(0), Q.encoded(0), select=f"SELECT id, {HEX} AS codes, round(alpha, 6) + 0.0 AS alpha FROM idx"))
def flat_encode(spark, sf_dir):
    return index_rows(index(spark, sf_dir, FLAT)).drop("resid")


@query(wrap(Q.BASE, Q.constants(), Q.asked(), select=sql_long("q", "qid", "land", "x")))
def query_project(spark, sf_dir):
    return long(per_row(split(spark, sf_dir)[1], lambda x: [lists(MODEL.prepare(x)[0])], "qid bigint, l array<double>", "qid"), "qid", "l", "x")


@query(wrap(Q.BASE, Q.constants(), Q.asked(), select="SELECT qid, round(perp, 6) + 0.0 AS perp FROM q"))
def query_perp(spark, sf_dir):
    return per_row(split(spark, sf_dir)[1], lambda x: [pa.array(MODEL.prepare(x)[1])], "qid bigint, perp double", "qid").select("qid", V.round6(F.col("perp")).alias("perp"))


@query(wrap(Q.BASE, "b AS (SELECT " + Q.rows(C.landmark_basis(DIM, DIM).T) + " AS land)", Q.unit("cu", "corpus", "id"), "c AS (SELECT id, list_transform(land, lambda l: list_dot_product(l, u)) AS y FROM cu, b)", select=sql_long("c", "id", "y", "x")))
def landmark_cossim(spark, sf_dir):
    return long(per_row(split(spark, sf_dir)[0], lambda x: [lists(M.normalise(x) @ C.landmark_basis(DIM, DIM))], "id bigint, y array<double>"), "id", "y", "x")


# searches


@query(wrap(Q.BASE, Q.EXACT, select=f"{Q.OUT} ({Q.best('exact_s')})"))
def exact_topk(spark, sf_dir):
    return result(exact(spark, sf_dir))


_SQL["cosine_topk"] = _SQL["exact_topk"]


@query(_SQL["exact_topk"])
def cosine_topk(spark, sf_dir):
    """As exact_topk, with column functions and a window alone."""
    corpus, asked = split(spark, sf_dir)
    c = corpus.select("id", "vec", V.vec_norm("vec").alias("n")).select("id", V.vec_normalize("vec", F.col("n")).alias("u"))
    q = asked.select("qid", "vec", V.vec_norm("vec").alias("n")).select("qid", V.vec_normalize("vec", F.col("n")).alias("w"))
    return result(S.rank(c.join(F.broadcast(q)).select("qid", "id", V.vec_dot("w", "u").alias("score")), K))  # the 50 held-out queries


@query(wrap(Q.BASE, Q.EXACT, select=f"SELECT id, round(score, 6) + 0.0 AS score FROM exact_s WHERE qid = (SELECT min(qid) FROM queries) ORDER BY exact_s.score DESC, id LIMIT {K}"))
def single_query_topk(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    q = M.normalise(np.array([asked.orderBy("qid").first()["vec"]], float))[0]
    c = corpus.select("id", "vec", V.vec_norm("vec").alias("n")).select("id", V.vec_normalize("vec", F.col("n")).alias("u"))
    return c.select("id", V.vec_dot("u", V.literal(q)).alias("score")).orderBy(F.desc("score"), "id").limit(K).select("id", V.round6(F.col("score")).alias("score"))


@query("SELECT qid, rank, id, score FROM (SELECT o_custkey AS qid, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return S.rank(orders, 3).select("qid", "rank", "id", "score")


@query(wrap(Q.BASE, Q.EXACT, select="SELECT qid, id, round(score, 6) + 0.0 AS score FROM exact_s"))
def score_matrix(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return S.exact_scores(corpus, asked, DIM).select("qid", "id", V.round6(F.col("score")).alias("score"))


@query(wrap(Q.BASE, Q.EXACT, "o AS (SELECT qid, id, score + (id % 2) * (qid % 3) * 0.1::DOUBLE AS score FROM exact_s)", select=f"{Q.OUT} ({Q.best('o')})"))
def score_offset(spark, sf_dir):
    """Two buckets of the corpus, one with an offset for each query, merged."""
    corpus, asked = split(spark, sf_dir)
    plain = S.exact_topk(corpus.where("id % 2 = 0"), asked, DIM, K)
    raised = S.exact_topk(corpus.where("id % 2 = 1"), asked.withColumn("offset", (F.col("qid") % 3) * F.lit(0.1)), DIM, K)
    return result(S.rank(plain.union(raised).drop("rank"), K))


def thirds(spark, sf_dir) -> DataFrame:
    """A mask: each query with every third row."""
    corpus, asked = split(spark, sf_dir)
    return corpus.select("id").join(F.broadcast(asked.select("qid")), (F.col("qid") + F.col("id")) % 3 == 0).select("qid", "id")  # the 50 held-out queries


@query(wrap(Q.BASE, Q.EXACT, "o AS (SELECT * FROM exact_s WHERE (qid + id) % 3 = 0)", select=f"{Q.OUT} ({Q.best('o')})"))
def masked_search(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.exact_topk(corpus, asked, DIM, K, mask=thirds(spark, sf_dir)))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), "o AS (SELECT * FROM scores WHERE (qid + id) % 3 = 0)", select=f"{Q.OUT} ({Q.best('o')})"))
def masked_rerank(spark, sf_dir):
    """The quantised scores over a mask."""
    return result(found(spark, sf_dir, mask=thirds(spark, sf_dir)))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), "o AS (SELECT qid, id, score + (qid % 3) * 0.25::DOUBLE AS score FROM scores WHERE qid % 2 = 0 AND (qid + id) % 3 = 0)", select=f"{Q.OUT} ({Q.best('o')})"))
def score_prepared(spark, sf_dir):
    """Query subset, offset, mask and residual in one scan of an index."""
    corpus, asked = split(spark, sf_dir)
    some = asked.where("qid % 2 = 0").withColumn("offset", (F.col("qid") % 3) * F.lit(0.25))
    return result(S.landmark_search(M.build(corpus, MODEL), some, MODEL, K, mask=thirds(spark, sf_dir)))


@query(wrap(Q.BASE, Q.EXACT, select="SELECT qid, count(*) AS n FROM exact_s WHERE score >= 0.2 GROUP BY qid"))
def threshold_count(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return S.exact_count(corpus, asked, DIM, 0.2)


@query(wrap(Q.BASE, Q.EXACT, f"a AS ({Q.best('(SELECT * FROM exact_s WHERE id % 2 = 0)')}), b AS ({Q.best('(SELECT qid, id, score + 0.1 AS score FROM exact_s WHERE id % 3 = 0)')}), u AS (SELECT qid, id, max(score) AS score FROM (SELECT qid, id, score FROM a UNION ALL SELECT qid, id, score FROM b) GROUP BY qid, id)", select=f"{Q.OUT} ({Q.best('u')})"))
def merge_results(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    a = S.exact_topk(corpus.where("id % 2 = 0"), asked, DIM, K)
    b = S.exact_topk(corpus.where("id % 3 = 0"), asked, DIM, K).withColumn("score", F.col("score") + 0.1)
    return result(S.merge_results(a, b, K))


@query(_SQL["exact_topk"])
def multi_bucket_topk(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    parts = [S.exact_topk(corpus.where(F.col("id") % 4 == b), asked, DIM, K) for b in range(4)]
    return result(S.rank(parts[0].union(parts[1]).union(parts[2]).union(parts[3]).drop("rank"), K))


@query(wrap(Q.BASE, Q.EXACT, select=f"SELECT qid, rank, 1000000 + id * 3 AS id, round(score, 6) + 0.0 AS score FROM ({Q.best('exact_s')})"))
def id_remap(spark, sf_dir):
    corpus, _ = split(spark, sf_dir)
    mapping = corpus.select("id", (F.col("id") * 3 + 1000000).alias("mapped"))
    return result(exact(spark, sf_dir).join(mapping, "id").drop("id").withColumnRenamed("mapped", "id"))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), select=f"{Q.OUT} ({Q.best('scores')})"))
def landmark_search(spark, sf_dir):
    return result(found(spark, sf_dir))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored("idx.alpha * list_dot_product(q.land, idx.point)"), select=f"{Q.OUT} ({Q.best('scores')})"))
def landmark_scan(spark, sf_dir):
    return result(found(spark, sf_dir, use_residual=False))


@query(wrap(Q.BASE, Q.constants(0), Q.encoded(0), Q.asked(0), Q.scored(), select=f"{Q.OUT} ({Q.best('scores')})"))
def flat_search(spark, sf_dir):
    return result(found(spark, sf_dir, model=FLAT))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(Q.M, True), Q.asked(), Q.scored(), select=f"{Q.OUT} ({Q.best('scores')})"))
def project_then_quant(spark, sf_dir):
    return result(found(spark, sf_dir, model=FIRST))


SIGN = Q.scored("list_dot_product(q.land, list_transform(idx.codes, lambda c: (2 * (c // 8) - 1)::DOUBLE))", "signs")


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), SIGN, select=f"{Q.OUT} ({Q.best('signs')})"))
def sign_scan(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.sign_search(M.build(corpus, MODEL), asked, MODEL, K))


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored("idx.alpha * list_dot_product(q.land, list_transform(idx.codes, lambda c: (2 * (c // 8) - 1)::DOUBLE))", "signs"), select=f"{Q.OUT} ({Q.best('signs')})"))
def sign_alpha_scan(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.sign_search(M.build(corpus, MODEL), asked, MODEL, K, sign_alpha=True))


STAGED = wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), SIGN, f"short AS ({Q.best('signs', S.shortlist_size(K, BITS))})", Q.scored(), "kept AS (SELECT scores.* FROM scores JOIN short USING (qid, id))", select=f"{Q.OUT} ({Q.best('kept')})")


@query(STAGED)
def staged_search(spark, sf_dir):
    """Both stages read the saved index, so vectors are encoded once."""
    corpus, asked = split(spark, sf_dir)
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    M.save(M.build(corpus, MODEL), MODEL, path)
    return result(S.staged_search(M.load(spark, path)[0], asked, MODEL, K, staged=True))


@query(_SQL["landmark_search"])
def staged_auto(spark, sf_dir):
    """The full scan, at any number of rows."""
    corpus, asked = split(spark, sf_dir)
    return result(S.staged_search(M.build(corpus, MODEL), asked, MODEL, K))


def _rescored(n: int) -> str:
    return wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), f"short AS ({Q.best('scores', n)})", Q.EXACT, "kept AS (SELECT exact_s.* FROM exact_s JOIN short USING (qid, id))", select=f"{Q.OUT} ({Q.best('kept')})")


@query(_rescored(K))
def float_rescore(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.float_rescore(found(spark, sf_dir), corpus, asked, DIM, K))


@query(_rescored(100))
def wide_rescore(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    return result(S.float_rescore(found(spark, sf_dir, 100), corpus, asked, DIM, K))


ROUND = "sign({x}) * floor(abs({x}) + 0.5)"
PLACES = f"range(1, {C.scan_dim(Q.M)} + 1)"
LUT = wrap(
    Q.BASE, Q.constants(), Q.encoded(), Q.asked(),
    f"t AS (SELECT qid, perp, list_transform(q.land, lambda x: list_transform(c_lm, lambda c: x * c)) AS t FROM q, k)",
    "lo AS (SELECT qid, perp, t, list_transform(t, lambda r: list_min(r)) AS least, list_max(list_transform(t, lambda r: list_max(r) - list_min(r))) / 127 AS span FROM t)",
    f"lut AS (SELECT qid, perp, span AS scale, list_sum(least) AS bias, list_transform({PLACES}, lambda j: list_transform(t[j], lambda v: floor((v - least[j]) / span + 0.5))) AS lut FROM lo)",
    f"scores AS (SELECT qid, id, idx.alpha * (scale * list_sum(list_transform({PLACES}, lambda j: lut[j][codes[j] + 1])) + bias) + perp * resid AS score FROM lut, idx)",
    select=f"{Q.OUT} ({Q.best('scores')})",
)


@query(LUT)
def lut_score(spark, sf_dir):
    """Landmark search by the queries' lookup tables of 0 to 127."""
    return result(found(spark, sf_dir, mode="lut"))


INT8 = wrap(
    Q.BASE, Q.constants(), Q.encoded(), Q.asked(),
    "u AS (SELECT list_max(list_transform(c_lm, lambda c: abs(c))) / 127 AS unit FROM k)",
    f"lv AS (SELECT unit, list_transform(c_lm, lambda c: {ROUND.format(x='(c / unit)')}) AS levels FROM k, u)",
    "qs AS (SELECT qid, perp, land, list_max(list_transform(land, lambda x: abs(x))) / 127 AS s FROM q)",
    f"qi AS (SELECT qid, perp, s, list_transform(land, lambda x: {ROUND.format(x='(x / s)')}) AS w FROM qs)",
    "scores AS (SELECT qid, id, idx.alpha * list_dot_product(w, list_transform(codes, lambda c: levels[c + 1])) * s * unit + perp * resid AS score FROM qi, idx, lv)",
    select=f"{Q.OUT} ({Q.best('scores')})",
)


@query(INT8)
def int8_score(spark, sf_dir):
    """Landmark search with int8 queries times int8 levels."""
    return result(found(spark, sf_dir, mode="int8"))


def _q4() -> str:
    codes, scales = C.basis_q4(DIM, Q.M)
    return wrap(
        Q.BASE, Q.constants(), Q.encoded(), f"b4 AS (SELECT {Q.rows(codes.T)} AS basis, {Q.numbers(scales)} AS scales)", Q.rotated("q_r", "queries", "qid"),
        "q_t AS (SELECT qid, y, list_max(list_transform(y, lambda x: abs(x))) / 127 AS top FROM q_r)",
        f"q_z AS (SELECT qid, y, top, list_transform(y, lambda x: {ROUND.format(x='(x / top)')}) AS z FROM q_t)",
        f"q_l AS (SELECT qid, y, list_transform({PLACES}, lambda j: list_dot_product(basis[j], z) * top * scales[j]) AS land FROM q_z, b4)",
        "q AS (SELECT qid, land, sqrt(greatest(0.0, list_dot_product(y, y) - list_dot_product(land, land))) AS perp FROM q_l)",
        Q.scored(), select=f"{Q.OUT} ({Q.best('scores')})",
    )


@query(_q4())
def query_q4(spark, sf_dir):
    """Landmark search with int8 queries on the 4-bit basis."""
    return result(found(spark, sf_dir, mode="q4"))


# quality

CURVE = metrics.cuts(K)
LISTS = f"f AS ({Q.best('scores')}), x AS ({Q.best('exact_s')})"
RECALL = f"""SELECT t, avg(first)::DOUBLE AS recall1, avg(part)::DOUBLE AS recall FROM (
SELECT t, x.qid, max(CASE WHEN x.rank = 1 AND f.rank <= t THEN 1 ELSE 0 END) AS first, count(CASE WHEN x.rank <= t AND f.rank <= t THEN 1 END) / t::DOUBLE AS part
FROM x LEFT JOIN f USING (qid, id), (SELECT unnest({CURVE})::BIGINT AS t) c GROUP BY t, x.qid) GROUP BY t"""
CURVE_SQL = wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), Q.EXACT, LISTS, f"c AS ({RECALL})", select="SELECT t, round(recall1, 6) + 0.0 AS recall1, round(recall, 6) + 0.0 AS recall FROM c")


def curve(spark, sf_dir):
    return metrics.recall_curve(found(spark, sf_dir), exact(spark, sf_dir), K).select("t", V.round6(F.col("recall1")).alias("recall1"), V.round6(F.col("recall")).alias("recall"))


@query(CURVE_SQL)
def recall_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@query(f"SELECT t, recall1 FROM ({CURVE_SQL})")
def recall1_at_t(spark, sf_dir):
    return curve(spark, sf_dir).select("t", "recall1")


@query(f"SELECT t, recall FROM ({CURVE_SQL})")
def recall_at_t(spark, sf_dir):
    return curve(spark, sf_dir).select("t", "recall")


@query(wrap(Q.BASE, Q.constants(), Q.encoded(), Q.asked(), Q.scored(), Q.EXACT, f"f AS ({Q.best('scores', 100)}), x AS ({Q.best('exact_s')}), h AS (SELECT x.qid, x.rank, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS hit FROM x LEFT JOIN f USING (qid, id))", select="SELECT round(avg(part), 6) + 0.0 AS coverage, round(avg(first), 6) + 0.0 AS nn_found FROM (SELECT qid, avg(hit) AS part, max(CASE WHEN rank = 1 THEN hit ELSE 0 END) AS first FROM h GROUP BY qid)"))
def shortlist_coverage(spark, sf_dir):
    return metrics.coverage(found(spark, sf_dir, 100), exact(spark, sf_dir), K).select(V.round6(F.col("coverage")).alias("coverage"), V.round6(F.col("nn_found")).alias("nn_found"))


PREFIXES = (16, 32, 48, 64)


@query(wrap(Q.BASE, "b AS (SELECT " + Q.rows(C.landmark_basis(DIM, DIM).T) + " AS land)", Q.EXACT, "cy AS (SELECT id, list_transform(land, lambda l: list_dot_product(l, u)) AS y FROM cu, b), qy AS (SELECT qid, list_transform(land, lambda l: list_dot_product(l, u)) AS y FROM qu, b)", f"p AS (SELECT unnest({list(PREFIXES)})::BIGINT AS m)", "s AS (SELECT m, qid, id, list_dot_product(qy.y[1:m], cy.y[1:m]) AS score FROM cy, qy, p)", "r AS (SELECT *, row_number() OVER (PARTITION BY m, qid ORDER BY score DESC, id) AS rank FROM s), x AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM exact_s) WHERE rank = 1)", select="SELECT m, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS nn_recall FROM r JOIN x USING (qid, id) GROUP BY m"))
def prefix_recall(spark, sf_dir):
    corpus, asked = split(spark, sf_dir)
    first = exact(spark, sf_dir, 1).select("qid", "id")
    out = None
    for m in PREFIXES:
        basis = C.landmark_basis(DIM, DIM)[:, :m]
        rows = corpus.select(F.col("id").cast("bigint"), F.col("vec").cast("array<float>"))
        near = S.scan(rows, asked, DIM, 20, lambda q, basis=basis: M.normalise(q) @ basis, lambda q, b, basis=basis: q @ (M.normalise(M.matrix(b.column(1), DIM)) @ basis).T)
        hit = first.join(near.select("qid", "id", F.lit(1.0).alias("hit")), ["qid", "id"], "left").agg(V.round6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("nn_recall"))
        part = hit.select(F.lit(m).cast("bigint").alias("m"), "nn_recall")
        out = part if out is None else out.union(part)
    return out


_OUTER, _LO, _HI = calibration.tails(DIM, BITS)
FIT = f"""coords AS (SELECT d - 1 AS d, x FROM (SELECT unnest(y) AS x, generate_subscripts(y, 1) AS d FROM r)),
cal_n AS (SELECT count(*) AS n FROM corpus),
cal_at AS (SELECT floor(n * {_LO!r}::DOUBLE)::BIGINT AS lo, greatest(least(floor(n * {_HI!r}::DOUBLE)::BIGINT, n - 1), floor(n * {_LO!r}::DOUBLE)::BIGINT + 1) AS hi FROM cal_n),
cal_o AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY x) - 1 AS pos FROM coords),
cal_q AS (SELECT d, max(CASE WHEN pos = lo THEN x END) AS q_lo, max(CASE WHEN pos = hi THEN x END) AS q_hi FROM cal_o, cal_at GROUP BY d),
cal AS (SELECT d, q_lo, 2 * {_OUTER!r}::DOUBLE / (q_hi - q_lo) AS scale FROM cal_q)"""


@query(wrap(Q.BASE, Q.constants(), Q.rotated("r", "corpus", "id"), FIT, select=f"SELECT d, round(-{_OUTER!r}::DOUBLE / scale - q_lo, 6) + 0.0 AS shift, round(scale, 6) + 0.0 AS scale FROM cal"))
def calibration_fit(spark, sf_dir):
    return calibration.fit(split(spark, sf_dir)[0], DIM, BITS).select("d", V.round6(F.col("shift")).alias("shift"), V.round6(F.col("scale")).alias("scale"))


@query(
    wrap(
        Q.BASE, Q.constants(0), Q.rotated("r", "corpus", "id"), FIT, f"cs AS (SELECT list(-{_OUTER!r}::DOUBLE / scale - q_lo ORDER BY d) AS shift, list(scale ORDER BY d) AS scale FROM cal)",
        "cc AS (SELECT id, y, list_transform(range(64), lambda i: len(list_filter(b_lm, lambda b: (y[i + 1] + shift[i + 1]) * scale[i + 1] > b))) AS codes FROM r, k, cs)",
        "ch AS (SELECT id, y, list_transform(range(64), lambda i: c_lm[codes[i + 1] + 1] / scale[i + 1] - shift[i + 1]) AS yhat FROM cc, k, cs)",
        "idx AS (SELECT id, yhat AS point, CASE WHEN list_dot_product(y, yhat) <= 1e-12 THEN 0.0 ELSE sqrt(list_dot_product(y, y)) / list_dot_product(y, yhat) END AS alpha FROM ch)", Q.asked(0),
        Q.scored("idx.alpha * list_dot_product(q.land, idx.point)"), select=f"{Q.OUT} ({Q.best('scores')})",
    )
)
def calibrated_search(spark, sf_dir):
    """Full-dimension codes of calibrated coordinates."""
    corpus, asked = split(spark, sf_dir)
    cal = calibration.fit(corpus, DIM, BITS).orderBy("d").collect()  # one row a dimension
    shift, scale = np.array([r["shift"] for r in cal]), np.array([r["scale"] for r in cal])
    bounds, cents = C.codebook(BITS, DIM)

    def score(q, b):
        y = C.rotate(M.normalise(M.matrix(b.column(1), DIM)))
        yhat = cents[np.searchsorted(bounds, (y + shift) * scale, side="left")] / scale - shift
        return (q @ yhat.T) * M.ratio(np.sqrt((y * y).sum(1)), (y * yhat).sum(1))

    rows = corpus.select(F.col("id").cast("bigint"), F.col("vec").cast("array<float>"))
    return result(S.scan(rows, asked, DIM, K, lambda q: C.rotate(M.normalise(q)), score))


@query("WITH p AS (SELECT p_size::BIGINT AS x, min(p_retailprice) AS y FROM part GROUP BY p_size), o AS (SELECT *, min(y) OVER (ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) SELECT x, y FROM o WHERE best IS NULL OR y < best")
def pareto_front(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_size").cast("bigint").alias("x")).agg(F.min("p_retailprice").alias("y"))
    return metrics.pareto_front(p, "x", "y")


def _coverage(m: int, n: int) -> str:
    """Mean share of the true ten among the n first found with m landmarks, and how often the nearest is."""
    return wrap(Q.BASE, Q.constants(m), Q.encoded(m), Q.asked(m), Q.scored(), Q.EXACT, f"f AS ({Q.best('scores', n)}), x AS ({Q.best('exact_s')}), h AS (SELECT x.qid, x.rank, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS hit FROM x LEFT JOIN f USING (qid, id))", select=f"SELECT {m}::BIGINT AS landmarks, {n}::BIGINT AS shortlist, avg(part) AS coverage, avg(first) AS nn_found FROM (SELECT qid, avg(hit) AS part, max(CASE WHEN rank = 1 THEN hit ELSE 0 END) AS first FROM h GROUP BY qid)")


STEPS, GOAL = tuple(range(8, DIM + 1, 8)), 0.5


@query(f"WITH c AS ({' UNION ALL '.join(f'({_coverage(m, 64)})' for m in STEPS)}) SELECT landmarks, round(coverage, 6) + 0.0 AS coverage FROM c WHERE coverage >= {GOAL} ORDER BY landmarks LIMIT 1")
def tune(spark, sf_dir):
    """Fewest landmarks (in steps of 8) at which half of the true ten are in the first 64 found."""
    truth = datasets.cached(spark, scratch(spark), cache_key(spark, sf_dir), lambda: exact(spark, sf_dir))

    def run(m: int) -> float:
        return metrics.coverage(found(spark, sf_dir, 64, M.Model(DIM, BITS, m)), truth, K).first()["coverage"]

    best, seen = metrics.tune(run, list(STEPS), GOAL)
    return spark.createDataFrame([(m, round(r, 6)) for m, r in dict(seen).items() if m == best], "landmarks bigint, coverage double")


GRID = tuple((m, n) for m in (16, 32, 48) for n in (16, 64, 256))


def sweep(spark, sf_dir) -> DataFrame:
    """Coverage after the landmark stage for numbers of landmarks and lengths of its shortlist."""
    truth = datasets.cached(spark, scratch(spark), cache_key(spark, sf_dir), lambda: exact(spark, sf_dir))
    out = None
    for m in sorted({m for m, _ in GRID}):
        most = max(n for x, n in GRID if x == m)
        short = found(spark, sf_dir, most, M.Model(DIM, BITS, m))
        for n in (n for x, n in GRID if x == m):
            part = metrics.coverage(short.where(F.col("rank") <= n), truth, K).select(F.lit(m).cast("bigint").alias("landmarks"), F.lit(n).cast("bigint").alias("shortlist"), "coverage", "nn_found")
            out = part if out is None else out.union(part)
    return out


SWEEP = " UNION ALL ".join(f"({_coverage(m, n)})" for m, n in GRID)


@query(f"SELECT landmarks, shortlist, round(coverage, 6) + 0.0 AS coverage, round(nn_found, 6) + 0.0 AS nn_found FROM ({SWEEP})")
def landmark_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).select("landmarks", "shortlist", V.round6(F.col("coverage")).alias("coverage"), V.round6(F.col("nn_found")).alias("nn_found"))


@query(f"SELECT landmarks, shortlist, landmarks * shortlist AS product FROM ({SWEEP}) WHERE coverage >= 0.6 ORDER BY product, landmarks LIMIT 1")
def sweep_pick(spark, sf_dir):
    """Of the settings that find six of ten the one with the smallest product of landmarks and shortlist."""
    good = sweep(spark, sf_dir).where("coverage >= 0.6").select("landmarks", "shortlist")
    return metrics.least_product(good, "landmarks", "shortlist").withColumn("product", F.col("landmarks") * F.col("shortlist"))


def _lloyd(bits: int = BITS, rounds: int = 25) -> str:
    n = 2**bits
    steps = ["coords AS MATERIALIZED (SELECT unnest(y) AS x FROM r)", f"l0 AS MATERIALIZED (SELECT quantile_cont(x, {Q.numbers(np.linspace(0.001, 0.999, n))}) AS q FROM coords)"]
    for k in range(rounds):
        cells = f"SELECT len(list_filter(edges, lambda e: x > e)) AS c, avg(x) AS m FROM coords, (SELECT list_transform(range(1, {n}), lambda i: (q[i] + q[i + 1]) / 2) AS edges FROM l{k}) GROUP BY 1"
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT list(coalesce(m, old) ORDER BY c) AS q FROM (SELECT c, q[c + 1] AS old FROM l{k}, range({n}) g(c)) LEFT JOIN ({cells}) USING (c))")
    return wrap(Q.BASE, Q.constants(), Q.rotated("r", "corpus", "id"), *steps, select=f"SELECT level - 1 AS level, round(centroid, 6) + 0.0 AS centroid FROM (SELECT unnest(q) AS centroid, generate_subscripts(q, 1) AS level FROM l{rounds})")


@query(_lloyd())
def empirical_codebook(spark, sf_dir):
    x = calibration.coordinates(split(spark, sf_dir)[0], DIM)
    levels = calibration.empirical_codebook(x, "x", BITS)
    return spark.createDataFrame([(k, round(v, 6) + 0.0) for k, v in enumerate(levels)], "level bigint, centroid double")


def scratch(spark) -> str:
    """A folder for files of a query: the shared one of the cluster, or a temporary one on a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named:
        return named.rstrip("/") + "/quiverlake-cache"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='quiverlake-')}"
    return _LOCAL[app]


def cache_key(spark, sf_dir) -> dict:
    return {"source": sf_dir, "queries": NQ, "k": K, "metric": "cosine", **datasets.fingerprint(vectors(spark, sf_dir))}


@query(_SQL["exact_topk"])
def exact_topk_cache(spark, sf_dir):
    return result(datasets.cached(spark, scratch(spark), cache_key(spark, sf_dir), lambda: exact(spark, sf_dir)))


@query(f"WITH {Q.BASE} SELECT id, len(v) AS dim, round(v[1], 6) + 0.0 AS first FROM corpus")
def scan_npy(spark, sf_dir):
    """The corpus written as an NPY file and read again by row ranges; the shared folder must be a mount."""
    folder = scratch(spark)
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("an NPY file is written to a shared mount, not to a store")
    path = os.path.join(folder.removeprefix("file://").removeprefix("file:"), f"{uuid.uuid4().hex}.npy")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    npy.write_npy(split(spark, sf_dir)[0], path, part_bytes=64 << 10)
    return npy.read_npy(spark, path, 200).select("id", F.size("vec").cast("bigint").alias("dim"), V.round6(F.col("vec")[0].cast("double")).alias("first"))


@query("SELECT o_orderpriority AS config, count(o_totalprice) AS runs, round(avg(o_totalprice), 4) AS mean, round(list_sort(list(o_totalprice))[count(o_totalprice) // 2 + 1], 4) AS median, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def bench_summary(spark, sf_dir):
    """Mean, upper median and sample deviation per configuration, here of order totals by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("config"), "o_totalprice")
    return metrics.summary(orders, ["config"], "o_totalprice")
