"""Source trees: file walk, language by extension, digests, dotenv and pattern files."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.working import working_path

# Extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "cs": "csharp", "go": "go", "rs": "rust",
    "rb": "ruby", "php": "php", "kt": "kotlin", "cpp": "cpp", "c": "c", "swift": "swift", "scala": "scala",
}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(table, ext), F.lit("unknown"))


def walk(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = 1 << 20) -> DataFrame:
    """path, language, file_size, mtime, content_hash and text of the files under ``root`` up to a size.

    The size is tested on the listing, so larger files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.where(F.col("length") <= most_bytes)
    return files.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), F.xxhash64("content").alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def dotenv(text: Column) -> Column:
    """KEY=VALUE lines as an array of (key, value); comments and blank lines are out, quotes are stripped."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*="))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"=(.*)$", 1)), r"^[\"']|[\"']$", "").alias("value")))


def pattern_table(spark: SparkSession, source: str) -> DataFrame:
    """User patterns from TOML: id, category, regex, confidence, cwe. A handful of rows, fit to broadcast."""
    rows = [(p["id"], p.get("category", "other"), p["regex"], float(p.get("confidence", 0.8)), p.get("cwe")) for p in tomllib.loads(source).get("pattern", [])]
    return spark.createDataFrame(rows, "id string, category string, regex string, confidence double, cwe string")


def write_shards(df: DataFrame, by: str) -> str:
    """Write ``df`` as one folder per value of ``by`` in the shared working folder; rows of a value are spread over its writers."""
    path = working_path(df.sparkSession, "shards")
    df.write.partitionBy(by).parquet(path)
    return path


def read_shard(spark: SparkSession, path: str, by: str, value) -> DataFrame:
    """The rows of one shard; the filter on the folder's column prunes all others."""
    return spark.read.parquet(path).where(F.col(by) == value)
