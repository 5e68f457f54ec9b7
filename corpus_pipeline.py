"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns their columns (the last one adds its result). Nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import decontaminate, langid, near_dup, pieces, secrets
from flowlake.llm.common import id_remainder, table
from flowlake.session import cut_lineage

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of which no language has half the probability."""
    found = langid.fit_predict(docs, id_remainder("doc_id", 4) != 2)
    return found.where((found["lang_pred"] != "und") & (found["score"] >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each group of copies and near copies that has the least doc_id."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the pieces of each text and whether decoding gives the text back."""
    return pieces.encode_column(docs, check=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
