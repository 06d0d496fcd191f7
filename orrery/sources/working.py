"""Working tables for loops: written to the shared folder, so a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints/orrery"


def working_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a session that runs in one JVM may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FALLBACK
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def working_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = working_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
