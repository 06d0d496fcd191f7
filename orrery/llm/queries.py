"""Queries ``op1_`` to ``op10_`` and ``pipeline``, and SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, url_filter, warc
from .common import work_dir
from .mixing import Mix, mix_schedule
from .near_vectors import near_vectors
from .ngram_join import ngram_jaccard_classes
from .oracles import ORACLES  # noqa: F401  registered with the queries
from .packing import pack_sequences
from .quality import repetition_quality
from .suffix_dedup import suffix_dedup_report
from .toxicity import toxicity_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), most_rows=20_000)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 3-word shingle sets at Jaccard >= 0.9 over all documents."""
    return ngram_jaccard_classes(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids."""
    return pack_sequences(_table(spark, sf_dir, "documents"), _vocabulary(), capacity=4096, eos=2)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine >= 0.9."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict on every page's URL."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier, over all documents."""
    return suffix_dedup_report(_table(spark, sf_dir, "documents"), length=100)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back from it."""
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read_archive(spark, path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdicts of all documents."""
    return repetition_quality(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of all documents under a mix of at most two passes over a source."""
    return mix_schedule(_table(spark, sf_dir, "documents"), Mix(repeats=2.0))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as whole texts and by line."""
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_packing": op3_packing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_license_scans": op10_license_scans,
}
