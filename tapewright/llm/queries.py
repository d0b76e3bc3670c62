"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, chunks, cotrain, exact, langid, middle, minhash, negatives, packing, passages, quality, rans, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.coded(_table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.round_trip(_table(spark, sf_dir, "documents"))


def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(_table(spark, sf_dir, "documents"))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_negatives(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op8_cotrained_quality": op8_cotrained_quality,
        "op1_language_fusion": op1_language_fusion,
        "op2_url_vocabulary": op2_url_vocabulary,
        "op4_shared_passages": op4_shared_passages,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op7_rans_token_files": op7_rans_token_files,
        "op3_mixture_packing": op3_mixture_packing,
        "op5_minmax_near_dedup": op5_minmax_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op9_quality_outliers": op9_quality_outliers,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_cap_filters": op12_cap_filters,
        "op13_hilbert_negatives": op13_hilbert_negatives,
    }


ORACLE: dict[str, str] = {
    "op2_url_vocabulary": urls.oracle(),
    "op11_fill_in_middle": middle.oracle(),
    "op12_cap_filters": caps.oracle(),
    "op13_hilbert_negatives": negatives.oracle(),
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
