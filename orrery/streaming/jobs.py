"""Structured Streaming jobs over event folders.

Each builder takes a streaming DataFrame of events (event_id, ts, user_id, event_type,
value) and returns the transformed stream; ``run_available`` runs one to the end of
what is there and returns the result table. Windows and watermarks extend what the
reference does with callbacks and queues.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream; its time is given a zone, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A stream reads folders: a table that is one file is matched by a glob on its name."""
    return f"{sf_dir}/events.parquet*"


def dedup(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """First of equal events (user, type, value) within a time to live."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type", "value"])


def daily_rollup(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def rate_windows(events: DataFrame, width: str = "1 minute", slide: str = "10 seconds", most: int = 100) -> DataFrame:
    """Sliding counts per user and whether they exceed the limit."""
    w = events.withWatermark("ts", width).groupBy("user_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def idle_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts(events: DataFrame, least: int = 3) -> DataFrame:
    """More than ``least`` errors of a user within an hour."""
    w = events.where("event_type = 'error'").withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") > least).select("user_id", F.col("w.start").alias("start"), "n")


def causal_delivery(events: DataFrame) -> DataFrame:
    """Deliver each user's events in their own sequence: one whose predecessors are missing waits in state.

    events need ``seq``, 1, 2, 3, ... per user. State is the next number and what waits.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, waiting = state.get if state.exists else (1, [])
        held = {int(s): int(e) for s, e in (x.split(":") for x in waiting)}
        for pdf in frames:
            held.update((int(s), int(e)) for s, e in zip(pdf["seq"], pdf["event_id"]) if s >= nxt)
        out = []
        while nxt in held:
            out.append((key[0], held.pop(nxt), nxt))
            nxt += 1
        state.update((nxt, [f"{s}:{e}" for s, e in sorted(held.items())]))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "seq"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, seq long", "nxt long, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def backpressure_mode(fill, was_batching):
    """Hysteresis: batching from 0.8 on until below 0.5."""
    return F.when(fill > 0.8, True).when(fill < 0.5, False).otherwise(was_batching)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the available input and return what was written."""
    from orrery.sources.working import LOCAL_FALLBACK

    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FALLBACK
    place = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/out").outputMode("append").start()
    else:
        # A complete result replaces the one before.
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
