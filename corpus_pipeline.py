"""The corpus pipeline: quality rules, exact and near deduplication, shared passages, packing.

All stages but the last give rows with the columns of ``documents``. Rows may have
nulls in any column, repeat, or have ids of their own twice; texts are read whole,
however long. Columns beside the five of ``documents`` are dropped by the first
stage, whatever their names. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import exact, minhash, packing, passages, quality
from tapewright.llm.scratch import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null, empty and very short texts fail the base rules. A null language or source
    is the empty one. Rows are judged one by one: equal rows stay or go together,
    rows with a null id like any other, rows that repeat an id each by its own text.
    """
    return quality.keep_quality(docs).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id; of rows that tie in text and id, one.

    A null text is the empty one. A row with a null id stays only if no row of its
    text has an id. Rows that share an id but no text all stay.
    """
    return exact.drop_exact_copies(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the one with the smallest id.

    Texts without words and rows with a null id are linked with nothing and stay.
    Rows that share an id are one document and stay or go together.
    """
    return minhash.keep_one_of_each(docs).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has; ``n_chars`` follows.

    Null and short texts and rows with a null id stay as they are. Rows that share
    an id are cut each by its own text, and not compared with each other. A document
    of which no word is left goes.
    """
    return passages.drop_shared_passages(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, every sequence with the sources' shares.

    A null or empty text is its end id alone, a null source the empty one. Every row
    is packed, those with a null or a repeated id too, in storage order.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: Robust outliers, chained links and tokenisation are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and the stage before's are discarded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return docs
