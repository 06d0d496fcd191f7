"""A training corpus from ``documents``: filter, de-duplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows and reads them
back as the next one's input.

A null or empty text has too few words and goes in the first stage, repeated rows keep one
in the second, a row without an id is compared with nothing and stays, and an empty table
gives no rows. Only doc_id, text and source are read; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import keep
from orrery.llm.mixing import Mix, mix_documents
from orrery.llm.ngram_join import keep_one_per_class, ngram_jaccard_classes
from orrery.llm.packing import pack_sequences
from orrery.llm.quality import keep_good
from orrery.llm.suffix_dedup import suffix_dedup_texts

#: The mix: no source is passed over more than twice, none less than once.
MIX = Mix(repeats=2.0, keep_all=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at Jaccard >= 0.8."""
    return keep_one_per_class(docs, ngram_jaccard_classes(docs, width=5, num=80, den=100))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that occur earlier in the corpus."""
    out = suffix_dedup_texts(docs, length=100)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mix_documents(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    import public_tokenizers

    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, eos=2)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can't tokenize or plan windows; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
