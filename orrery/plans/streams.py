"""Streaming jobs run to the end of the events, and their batch equivalents in SQL where state allows it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.streaming import jobs as J

from .registry import query


@query("", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_rollup_stream(spark, d):
    out = J.run_available(J.daily_rollup(J.read_events(spark, d)), "complete")
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 1")
def error_alerts_stream(spark, d):
    out = J.run_available(J.alerts(J.read_events(spark, d), 1), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def event_dedup_stream(spark, d):
    """State with a time to live: which repeat is dropped depends on the watermark."""
    return J.run_available(J.dedup(J.read_events(spark, d))).groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def rate_limit_windows(spark, d):
    """Sliding windows of a minute, one each ten seconds."""
    return J.run_available(J.rate_windows(J.read_events(spark, d), most=2), "complete").where("limited")


@query()
def session_windows_stream(spark, d):
    return J.run_available(J.idle_sessions(J.read_events(spark, d)), "complete")


@query("", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def causal_delivery_stream(spark, d):
    """Every event is delivered once its predecessors were; over all input that is every event in sequence."""
    from orrery.sources.facts import table
    from orrery.sources.working import working_table

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ordered = working_table(table(spark, d, "events").select("user_id", "event_id", seq.cast("bigint").alias("seq")), "sequenced")
    stream = spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", 1).parquet(ordered.inputFiles()[0].rsplit("/", 1)[0])
    return J.run_available(J.causal_delivery(stream))
