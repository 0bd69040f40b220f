"""SQL texts of the registered queries: the model's steps as common table expressions with its constants inlined."""

from __future__ import annotations

from functools import lru_cache

from quiverlake.functions import constants as C

DIM, M, BITS, NQ, K = 64, 48, 4, 50, 10


def numbers(values) -> str:
    return "[" + ", ".join(repr(float(x)) for x in values) + "]::DOUBLE[]"


def rows(values) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in values) + "]::DOUBLE[][]"


BASE = f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
edge AS (SELECT max(id) + 1 - {NQ} AS n FROM e),
corpus AS (SELECT e.* FROM e, edge WHERE id < n),
queries AS (SELECT id AS qid, v FROM e, edge WHERE id >= n)"""

NORMAL = "CASE WHEN {n} < 1e-10 THEN list_transform({v}, lambda x: 0.0::DOUBLE) ELSE list_transform({v}, lambda x: x / {n}) END"


@lru_cache
def constants(m: int = M) -> str:
    b_in, c_in = C.codebook(BITS, DIM)
    b_lm, c_lm = C.codebook(BITS, C.scan_dim(m) if m else DIM)
    land = rows(C.landmark_basis(DIM, m).T) if m else "[]::DOUBLE[][]"
    return f"k AS (SELECT {rows(C.rotation_matrix(DIM))} AS rot, {land} AS land, {numbers(b_in)} AS b_in, {numbers(c_in)} AS c_in, {numbers(b_lm)} AS b_lm, {numbers(c_lm)} AS c_lm)"


def unit(name: str, source: str, key: str) -> str:
    return f"{name}_n AS (SELECT {key}, v, sqrt(list_dot_product(v, v)) AS n FROM {source}), {name} AS (SELECT {key}, n, {NORMAL.format(n='n', v='v')} AS u FROM {name}_n)"


def rotated(name: str, source: str, key: str) -> str:
    return f"{unit(name + '_u', source, key)}, {name} AS (SELECT {key}, list_transform(rot, lambda r: list_dot_product(r, u)) AS y FROM {name}_u, k)"


@lru_cache
def encoded(m: int = M, project_first: bool = False) -> str:
    """corpus_r (y), corpus_a (codes, yhat, alpha), corpus_l (land, resid), idx (id, codes, alpha, resid, point)."""
    body = f"""{rotated('corpus_r', 'corpus', 'id')},
corpus_c AS (SELECT id, y, list_transform(y, lambda x: len(list_filter(b_in, lambda b: x >= b))) AS codes FROM corpus_r, k),
corpus_h AS (SELECT id, y, codes, list_transform(codes, lambda c: c_in[c + 1]) AS yhat FROM corpus_c, k),
corpus_a AS (SELECT id, y, codes, yhat, CASE WHEN list_dot_product(yhat, yhat) <= 1e-12 THEN 0.0 ELSE list_dot_product(y, yhat) / list_dot_product(yhat, yhat) END AS alpha FROM corpus_h),"""
    if not m:
        body += "corpus_l AS (SELECT id, y AS land, 0.0::DOUBLE AS resid FROM corpus_a),"
    else:
        base = "y" if project_first else "list_transform(yhat, lambda x: x * alpha)"
        body += f"""corpus_s AS (SELECT id, {base} AS s FROM corpus_a),
corpus_p AS (SELECT id, s, list_transform(land, lambda l: list_dot_product(l, s)) AS land FROM corpus_s, k),
corpus_l AS (SELECT id, land, sqrt(greatest(0.0, list_dot_product(s, s) - list_dot_product(land, land))) AS resid FROM corpus_p),"""
    return body + f"""
corpus_ln AS (SELECT id, land, resid, sqrt(list_dot_product(land, land)) AS n FROM corpus_l),
corpus_lu AS (SELECT id, resid, n, {NORMAL.format(n='n', v='land')} AS u FROM corpus_ln),
corpus_lc AS (SELECT id, resid, n, u, list_transform(u, lambda x: len(list_filter(b_lm, lambda b: x > b))) AS codes FROM corpus_lu, k),
corpus_lp AS (SELECT id, resid, n, u, codes, list_transform(codes, lambda c: c_lm[c + 1]) AS point FROM corpus_lc, k),
idx AS (SELECT id, codes, point, resid, CASE WHEN list_dot_product(u, point) <= 1e-12 THEN 0.0 ELSE n / list_dot_product(u, point) END AS alpha FROM corpus_lp)"""


@lru_cache
def asked(m: int = M) -> str:
    """q (qid, land, perp)."""
    if not m:
        return f"{rotated('q_r', 'queries', 'qid')}, q AS (SELECT qid, y AS land, 0.0::DOUBLE AS perp FROM q_r)"
    return f"""{rotated('q_r', 'queries', 'qid')}, q_l AS (SELECT qid, y, list_transform(land, lambda l: list_dot_product(l, y)) AS land FROM q_r, k),
q AS (SELECT qid, land, sqrt(greatest(0.0, list_dot_product(y, y) - list_dot_product(land, land))) AS perp FROM q_l)"""


def best(scores: str, k: int = K, extra: str = "") -> str:
    """CTEs that rank a table (qid, id, score)."""
    return f"SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {scores}) {extra} WHERE rank <= {k}"


EXACT = f"""{unit('cu', 'corpus', 'id')}, {unit('qu', 'queries', 'qid')},
exact_s AS (SELECT qid, id, list_dot_product(qu.u, cu.u) AS score FROM qu, cu)"""


def scored(expr: str = "idx.alpha * list_dot_product(q.land, idx.point) + q.perp * idx.resid", name: str = "scores") -> str:
    return f"{name} AS (SELECT qid, id, {expr} AS score FROM q, idx)"


def wrap(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n" + select


OUT = "SELECT qid, rank, id, round(score, 6) + 0.0 AS score FROM"
