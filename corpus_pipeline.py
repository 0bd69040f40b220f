"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents, extra ones included. Between stages the documents are written as Parquet to the shared folder and
read again. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlake.llm import decontam, dedup, mixing, toxicity
from quiverlake.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below its threshold; null and empty texts stay, repeated rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows of one id stay or go together, null ids and texts without words stay."""
    return dedup.drop_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts stay, repeated rows are judged alike."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, copies and rate of every document; null texts have no words and no copies, a null source is the last, repeated rows are rows of their own."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: SQL cannot express the random field, the forest or the rounding; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
