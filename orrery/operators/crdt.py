"""Mergeable values as aggregates: counters, registers, sets, vector clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gcounter(rows: DataFrame, key: str, agent: str, value: str) -> DataFrame:
    """Per agent the largest count, summed: merging twice changes nothing."""
    return rows.groupBy(key, agent).agg(F.max(value).alias("v")).groupBy(key).agg(F.sum("v").alias("total"))


def lww(rows: DataFrame, key: str, value: str, ts: str, agent: str) -> DataFrame:
    """The latest write; equal times go to the larger agent."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(ts, agent)).alias(value))


def max_register(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(value).alias(value))


def mv_register(rows: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """All values of the highest version, sorted."""
    top = rows.groupBy(key).agg(F.max(version).alias("_v"))
    return rows.join(top, key).where(F.col(version) == F.col("_v")).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def or_set(rows: DataFrame, key: str, element: str, tag: str, removed: str) -> DataFrame:
    """Elements with a tag that nothing removed: adds win over removals of other tags."""
    live = rows.groupBy(key, element, tag).agg(F.bool_or(removed).alias("_r")).where("not _r")
    return live.select(key, element).distinct()


def clock_merge(rows: DataFrame, key: str, agent: str, tick: str) -> DataFrame:
    m = rows.groupBy(key, agent).agg(F.max(tick).alias("t"))
    return m.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(agent, "t")))).alias("clock"))


def clock_order(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent of two map clocks; a missing agent is at 0."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    less, more = F.exists(keys, lambda k: at(a, k) < at(b, k)), F.exists(keys, lambda k: at(a, k) > at(b, k))
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def merge_fields(a: DataFrame, b: DataFrame, key: str, highest: list[str], latest: list[str], ts: str) -> DataFrame:
    """Column-wise merge of two replicas: largest of some fields, the later side's of the others."""
    y = b.select(key, *(F.col(c).alias(f"_{c}") for c in [*highest, *latest, ts]))
    j = a.join(y, key, "full_outer")
    later = F.coalesce(F.col(f"_{ts}") > F.col(ts), F.col(ts).isNull())
    return j.select(key, *(F.greatest(c, f"_{c}").alias(c) for c in highest), *(F.when(later, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in latest), F.greatest(ts, f"_{ts}").alias(ts))
