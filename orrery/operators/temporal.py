"""Bitemporal queries: as-of, ranges, replay, diffs, versions, retention, pattern detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TX, FROM, UNTIL = "transaction_time", "valid_time", "valid_until"


def visible_at(system, valid=None, archived: str | None = "archived") -> Column:
    """What was recorded by ``system`` and held at ``valid``; an open interval has no end."""
    s, v = F.lit(system), F.lit(system if valid is None else valid)
    out = (F.col(TX) <= s) & (F.col(FROM) <= v) & (F.col(UNTIL).isNull() | (F.col(UNTIL) > v))
    return out & ~F.col(archived) if archived else out


def overlaps(start, end) -> Column:
    return (F.col(FROM) < F.lit(end)) & (F.col(UNTIL).isNull() | (F.col(UNTIL) > F.lit(start)))


def contains(start, end) -> Column:
    return (F.col(FROM) <= F.lit(start)) & (F.col(UNTIL).isNull() | (F.col(UNTIL) >= F.lit(end)))


def started_during(start, end) -> Column:
    return (F.col(FROM) >= F.lit(start)) & (F.col(FROM) < F.lit(end))


def ended_during(start, end) -> Column:
    return (F.col(UNTIL) >= F.lit(start)) & (F.col(UNTIL) < F.lit(end))


def modified_between(events: DataFrame, key: str, start, end, ts: str = "recorded_at") -> DataFrame:
    """Distinct ids with an event in (start, end]."""
    return events.where((F.col(ts) > F.lit(start)) & (F.col(ts) <= F.lit(end))).select(key).distinct()


def replay(events: DataFrame, key: str, field: str, value: str, order: str, until=None, ts: str = "recorded_at") -> DataFrame:
    """State by folding events: each field's value is its latest event's, a partial aggregate."""
    e = events if until is None else events.where(F.col(ts) <= F.lit(until))
    return e.groupBy(key, field).agg(F.max_by(value, order).alias(value), F.max(order).alias("last_event"), F.count("*").alias("n_events"))


def reconstruct(snapshots: DataFrame, events: DataFrame, key: str, field: str, value: str, order: str) -> DataFrame:
    """Snapshot values, overridden by the events after the snapshot's own."""
    s = snapshots.select(key, field, F.struct(F.col("last_event").alias("o"), F.col(value).alias("v")).alias("x"))
    tail = events.join(snapshots.groupBy(key).agg(F.max("last_event").alias("_upto")), key, "left").where(F.col("_upto").isNull() | (F.col(order) > F.col("_upto")))
    t = tail.select(key, field, F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("x"))
    return s.unionByName(t).groupBy(key, field).agg(F.max("x").alias("x")).select(key, field, F.col("x.v").alias(value), F.col("x.o").alias("last_event"))


def diff(before: DataFrame, after: DataFrame, key: str, value: str, margin: float = 0.0) -> DataFrame:
    """created, archived, modified or unchanged per id between two states."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    change = F.when(F.col("_ia").isNull(), "created").when(F.col("_ib").isNull(), "archived").when(F.abs(F.col("_a") - F.col("_b")) > margin, "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def latest_versions(rows: DataFrame, key: str, order: list[Column], keep: int = 10) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("version_rank", k).where(F.col("version_rank") <= keep)


def as_of_nearest(probes: DataFrame, snapshots: DataFrame, key: str, at: str, ts: str, columns: list[str]) -> DataFrame:
    """For each probe (key, at) the snapshot of its key with the largest ts <= at, as one aggregate over the equi-join."""
    j = probes.join(snapshots, key, "left").where(F.col(ts).isNull() | (F.col(ts) <= F.col(at)))
    return j.groupBy(key, at).agg(F.max_by(F.struct(*columns), ts).alias("_s")).select(key, at, "_s.*")


def close_and_insert(history: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Type-2 correction: an open row of a corrected key ends where the fact begins, and the fact is inserted open.

    facts: key, valid_time and the payload columns of ``history``.
    """
    first = facts.groupBy(key).agg(F.min(FROM).alias("_new"))
    h = history.join(first, key, "left")
    closed = h.withColumn(UNTIL, F.when(F.col(UNTIL).isNull() & F.col("_new").isNotNull() & (F.col("_new") > F.col(FROM)), F.col("_new")).otherwise(F.col(UNTIL))).drop("_new")
    return closed.unionByName(facts.withColumn(UNTIL, F.lit(None).cast(history.schema[UNTIL].dataType)).select(*history.columns))


# Allowed moves of the epistemic state machine.
MOVES = {("conjecture", "provisional"), ("provisional", "verified"), ("verified", "stale"), ("provisional", "stale"), ("stale", "verified")}


def transition(state: Column, to: Column) -> Column:
    """The new state, or null where the move isn't allowed."""
    ok = F.lit(False)
    for a, b in sorted(MOVES):
        ok = ok | ((state == a) & (to == b))
    return F.when(ok, to)


def freshness_index(stale: Column, n: Column) -> Column:
    return 1.0 - 0.5 * stale / n
