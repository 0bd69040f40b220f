"""The registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import ann, chat, decontam, dedup, html, licenses, mixing, tokens, toxicity, urls
from quiverlake.llm.common import table

#: Rules of the URL filter: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: File of the tokenizer; its place is that of the installed library's vocabularies.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans: offending stretches as first character-end, comma-joined."""
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("n_spans", F.size("spans").cast("long")).withColumn("spans", places)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, RULES))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return {**own, "pipeline": _pipeline}


OP7_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
fits AS (
  SELECT page_id, max(struct_pack(n := length(r_host || r_path), rule := r_host || r_path, verdict := r_verdict)) AS best
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""

OP10_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns, count(*) AS n_turns FROM turns GROUP BY conv_id),
equal AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns, n_turns FROM whole GROUP BY turns, n_turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM equal, unnest(range(1, n_turns)) AS x(k))
SELECT conv_id, n_turns, n_copies, list_aggregate(list_transform(turns, lambda x: '<|' || replace(coalesce(x.r, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || chr(10)), 'string_agg', '') AS rendered
FROM equal e WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = e.turns)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op10_chat_formatting": OP10_SQL}
