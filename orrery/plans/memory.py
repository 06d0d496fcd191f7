"""Bitemporal store, event log, retrieval scores and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import crdt as C
from orrery.operators import temporal as T
from orrery.sources.facts import relation

from .registry import query

r6 = lambda c: F.round(c, 6)

AT, LATER = "1996-06-01 00:00:00", "1997-06-01 00:00:00"
_AT, _LATER = f"TIMESTAMP '{AT}'", f"TIMESTAMP '{LATER}'"


def _ts(x: str):
    return F.lit(x).cast("timestamp_ntz")


@query("memories", f"SELECT memory_id, memory_type FROM memories WHERE transaction_time <= {_AT} AND valid_time <= {_AT} AND (valid_until IS NULL OR valid_until > {_AT}) AND NOT archived")
def as_of(spark, d):
    return relation(spark, d, "memories").where(T.visible_at(_ts(AT))).select("memory_id", "memory_type")


@query("memories", f"SELECT memory_type, count(*) AS n FROM memories WHERE valid_time < {_LATER} AND (valid_until IS NULL OR valid_until > {_AT}) GROUP BY 1")
def range_overlaps(spark, d):
    return relation(spark, d, "memories").where(T.overlaps(_ts(AT), _ts(LATER))).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("memories", f"SELECT memory_type, count(*) AS n FROM memories WHERE valid_time <= {_AT} AND (valid_until IS NULL OR valid_until >= {_LATER}) GROUP BY 1")
def range_contains(spark, d):
    return relation(spark, d, "memories").where(T.contains(_ts(AT), _ts(LATER))).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("memories", f"SELECT memory_type, count(*) AS n FROM memories WHERE valid_time >= {_AT} AND valid_time < {_LATER} GROUP BY 1")
def range_started(spark, d):
    return relation(spark, d, "memories").where(T.started_during(_ts(AT), _ts(LATER))).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("memories", f"SELECT memory_type, count(*) AS n FROM memories WHERE valid_until >= {_AT} AND valid_until < {_LATER} GROUP BY 1")
def range_ended(spark, d):
    return relation(spark, d, "memories").where(T.ended_during(_ts(AT), _ts(LATER))).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("memory_events", "WITH a AS (SELECT max(recorded_at) AS now FROM memory_events) SELECT DISTINCT memory_id FROM memory_events, a WHERE recorded_at > now - INTERVAL 2 DAY AND recorded_at <= now - INTERVAL 1 DAY")
def modified_between(spark, d):
    e = relation(spark, d, "memory_events")
    now = F.broadcast(e.agg(F.max("recorded_at").alias("now")))  # one row
    day = lambda n: F.col("now") - F.make_dt_interval(F.lit(n))
    return e.join(now).where((F.col("recorded_at") > day(2)) & (F.col("recorded_at") <= day(1))).select("memory_id").distinct()


@query("memory_events", "SELECT memory_id, field, max_by(delta, event_id) AS delta, max(event_id) AS last_event, count(*) AS n_events FROM memory_events GROUP BY 1, 2")
def event_replay(spark, d):
    return T.replay(relation(spark, d, "memory_events"), "memory_id", "field", "delta", "event_id")


@query("memory_events", "SELECT memory_id, field, max_by(delta, event_id) AS delta, max(event_id) AS last_event FROM memory_events GROUP BY 1, 2")
def snapshot_reconstruct(spark, d):
    """A snapshot half way and the events after it give what a full replay gives."""
    e = relation(spark, d, "memory_events")
    half = F.broadcast(e.agg((F.max("event_id") / 2).alias("half")))  # one row
    before = e.join(half).where("event_id <= half").drop("half")
    return T.reconstruct(T.replay(before, "memory_id", "field", "delta", "event_id"), e, "memory_id", "field", "delta", "event_id")


@query(
    "memories",
    f"""WITH x AS (SELECT memory_id, confidence FROM memories WHERE transaction_time <= {_AT} AND (valid_until IS NULL OR valid_until > {_AT})), y AS (SELECT memory_id, CASE WHEN access_count > 30 THEN confidence * 0.5 ELSE confidence END AS confidence FROM memories WHERE transaction_time <= {_LATER} AND (valid_until IS NULL OR valid_until > {_LATER}))
    SELECT CASE WHEN x.memory_id IS NULL THEN 'created' WHEN y.memory_id IS NULL THEN 'archived' WHEN abs(x.confidence - y.confidence) > 0.05 THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM x FULL OUTER JOIN y USING (memory_id) GROUP BY 1""",
)
def temporal_diff(spark, d):
    m = relation(spark, d, "memories")
    at = lambda ts: m.where(T.visible_at(_ts(ts), archived=None))
    later = at(LATER).withColumn("confidence", F.when(F.col("access_count") > 30, F.col("confidence") * 0.5).otherwise(F.col("confidence")))
    return T.diff(at(AT), later, "memory_id", "confidence", 0.05).groupBy("change").agg(F.count("*").alias("n"))


@query("memories", "SELECT entity, memory_id, row_number() OVER (PARTITION BY entity ORDER BY transaction_time DESC, memory_id DESC) AS version_rank FROM memories QUALIFY version_rank <= 10")
def version_retain10(spark, d):
    return T.latest_versions(relation(spark, d, "memories"), "entity", [F.desc("transaction_time"), F.desc("memory_id")], 10).select("entity", "memory_id", "version_rank")


@query("memory_events", "WITH l AS (SELECT memory_id, event_id, delta - lag(delta) OVER (PARTITION BY memory_id ORDER BY event_id) AS step FROM memory_events WHERE event_type = 'confidence_changed') SELECT memory_id, count(*) AS declines, round(sum(step), 4) AS total FROM l WHERE step < 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY declines DESC, memory_id LIMIT 100")
def erosion(spark, d):
    step = F.col("delta") - F.lag("delta").over(Window.partitionBy("memory_id").orderBy("event_id"))
    l = relation(spark, d, "memory_events").where("event_type = 'confidence_changed'").withColumn("step", step).where("step < 0")
    return l.groupBy("memory_id").agg(F.count("*").alias("declines"), F.round(F.sum("step"), 4).alias("total")).where("declines >= 2").orderBy(F.desc("declines"), "memory_id").limit(100)


@query(
    "memory_events",
    """WITH w AS (SELECT DISTINCT CAST(recorded_at AS DATE) AS day FROM memory_events), c AS (SELECT day, count(*) FILTER (WHERE CAST(recorded_at AS DATE) = day) AS recent, count(*) FILTER (WHERE CAST(recorded_at AS DATE) < day) / 3.0 AS base
        FROM w JOIN memory_events ON event_type = 'created' AND CAST(recorded_at AS DATE) BETWEEN day - 3 AND day GROUP BY 1)
    SELECT day, recent, round(base, 4) AS base, round((recent - base) / greatest(0.5 * base, 0.1), 4) AS sigma FROM c WHERE base > 0 AND (recent - base) / greatest(0.5 * base, 0.1) > 0.1""",
)
def explosion(spark, d):
    """Days whose creations exceed those of the three days before by more than a tenth of sigma."""
    e = relation(spark, d, "memory_events").select(F.to_date("recorded_at").alias("day"), "event_type").groupBy("day").agg(F.count_if(F.col("event_type") == "created").alias("n"))
    # A day counts in its own window and in those of the next three.
    c = e.withColumn("ahead", F.explode(F.array(*map(F.lit, range(4))))).select(F.date_add("day", F.col("ahead")).alias("day"), "ahead", "n")
    c = c.groupBy("day").agg(F.sum(F.when(F.col("ahead") == 0, F.col("n"))).alias("recent"), (F.sum(F.when(F.col("ahead") > 0, F.col("n")).otherwise(0)) / 3.0).alias("base")).where("recent is not null and base > 0")
    sigma = (F.col("recent") - F.col("base")) / F.greatest(0.5 * F.col("base"), F.lit(0.1))
    return c.where(sigma > 0.1).select("day", "recent", F.round("base", 4).alias("base"), F.round(sigma, 4).alias("sigma"))


@query("memory_events", "SELECT CAST(recorded_at AS DATE) AS day, count(*) FILTER (WHERE event_type = 'contradicted') AS conflicts, round(count(*) FILTER (WHERE event_type = 'contradicted') * 1.0 / count(DISTINCT memory_id), 6) AS density FROM memory_events GROUP BY 1")
def conflict_wave(spark, d):
    g = relation(spark, d, "memory_events").groupBy(F.to_date("recorded_at").alias("day")).agg(F.count_if(F.col("event_type") == "contradicted").alias("conflicts"), F.countDistinct("memory_id").alias("m"))
    return g.select("day", "conflicts", r6(F.col("conflicts") / F.col("m")).alias("density"))


@query("memories", "WITH a AS (SELECT max(transaction_time) AS now FROM memories) SELECT memory_type, round(1 - 0.5 * count(*) FILTER (WHERE transaction_time < now - INTERVAL 90 DAY) / count(*), 6) AS freshness FROM memories, a GROUP BY 1")
def evidence_freshness(spark, d):
    m = relation(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("transaction_time").alias("now")))  # one row
    stale = F.count_if(F.col("transaction_time") < F.col("now") - F.make_dt_interval(F.lit(90)))
    return m.join(now).groupBy("memory_type").agg(r6(T.freshness_index(stale, F.count("*"))).alias("freshness"))


@query(
    "memories",
    """WITH b AS (SELECT memory_id, entity, memory_type, confidence, epoch(transaction_time) / 86400 AS day FROM memories)
    SELECT a.memory_id AS decision, c.memory_id AS change, round(exp(-(c.day - a.day) / (7.0 / 3)), 6) AS strength FROM b AS a JOIN b AS c ON a.entity = c.entity AND a.memory_id <> c.memory_id AND c.day >= a.day AND c.day - a.day <= 7 WHERE exp(-(c.day - a.day) / (7.0 / 3)) > 0.1""",
)
def decision_correlation(spark, d):
    """Interval join: bucketed by the window, so it is an equi-join on (entity, week or the one before)."""
    day = F.unix_micros(F.col("transaction_time").cast("timestamp")) / 86_400_000_000
    b = relation(spark, d, "memories").select("memory_id", "entity", day.alias("day"))
    week = F.floor(F.col("day") / 7)
    a = b.select("entity", F.col("memory_id").alias("decision"), F.col("day").alias("d0"), F.explode(F.array(week, week + 1)).alias("week"))
    c = b.select("entity", F.col("memory_id").alias("change"), F.col("day").alias("d1"), week.alias("week"))
    gap = F.col("d1") - F.col("d0")
    j = a.join(c, ["entity", "week"]).where((F.col("decision") != F.col("change")) & (gap >= 0) & (gap <= 7))
    return j.withColumn("strength", F.exp(-gap / (7.0 / 3))).where("strength > 0.1").select("decision", "change", r6(F.col("strength")).alias("strength"))


@query(
    "memories",
    """SELECT a.memory_id AS earlier, b.memory_id AS later FROM memories AS a JOIN memories AS b ON a.entity = b.entity AND a.memory_type = b.memory_type AND b.transaction_time > a.transaction_time WHERE a.confidence > 0.5 AND b.confidence < 0.2""",
)
def reversals(spark, d):
    m = relation(spark, d, "memories").select("entity", "memory_type", "memory_id", "transaction_time", "confidence")
    a = m.where("confidence > 0.5").select("entity", "memory_type", F.col("memory_id").alias("earlier"), F.col("transaction_time").alias("t0"))
    b = m.where("confidence < 0.2").select("entity", "memory_type", F.col("memory_id").alias("later"), F.col("transaction_time").alias("t1"))
    return a.join(b, ["entity", "memory_type"]).where("t1 > t0").select("earlier", "later")


_DECAY = """x AS (SELECT memory_id, archived, confidence, importance, access_count, date_diff('day', CAST(transaction_time AS DATE), CAST(now AS DATE)) AS age, CASE memory_type WHEN '1-URGENT' THEN 365.0 WHEN '2-HIGH' THEN 180.0 WHEN '3-MEDIUM' THEN 90.0 WHEN '4-NOT SPECIFIED' THEN 60.0 ELSE 30.0 END AS hl FROM memories, (SELECT max(transaction_time) AS now FROM memories)),
    y AS (SELECT *, greatest(0.0, least(1.0, confidence * exp(-age / hl) * least(1.5, 1 + ln(1 + access_count) * 0.1) * CASE importance WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'normal' THEN 1.0 ELSE 0.8 END)) AS decayed FROM x)"""


def _decayed(spark, d):
    m = relation(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("transaction_time").alias("now")))  # one row
    age = F.date_diff(F.to_date("now"), F.to_date("transaction_time"))
    return m.join(now).withColumn("decayed", S.decay_product(F.col("confidence"), age, S.half_life_days(F.col("memory_type")), F.lit(1.0), S.usage_factor(F.col("access_count")), S.importance_weight(F.col("importance")), F.lit(1.0)))


@query("memories", f"WITH {_DECAY} SELECT memory_id, round(decayed, 6) AS confidence FROM y WHERE decayed >= 0.000001")
def decay(spark, d):
    return _decayed(spark, d).where("decayed >= 0.000001").select("memory_id", r6(F.col("decayed")).alias("confidence"))


@query("memories", f"WITH {_DECAY} SELECT importance, count(*) FILTER (WHERE decayed < 0.15 AND NOT archived) AS to_archive, count(*) AS n FROM y GROUP BY 1")
def archival_decision(spark, d):
    return _decayed(spark, d).groupBy("importance").agg(F.count_if((F.col("decayed") < 0.15) & ~F.col("archived")).alias("to_archive"), F.count("*").alias("n"))


@query("feedback", "SELECT author, round(count(*) FILTER (WHERE action = 'fix') / (count(*) + 1.0) * (1 - count(*) FILTER (WHERE action = 'dismiss') / (count(*) + 1.0)), 6) AS trust FROM feedback GROUP BY 1")
def agent_trust(spark, d):
    g = relation(spark, d, "feedback").groupBy("author").agg(F.count_if(F.col("action") == "fix").alias("p"), F.count_if(F.col("action") == "dismiss").alias("n"), F.count("*").alias("all"))
    return g.select("author", r6(S.trust(F.col("p"), F.col("n"), F.col("all"))).alias("trust"))


@query("memories", "SELECT entity, memory_type, count(*) AS n, round(least(1.0, avg(confidence) + 0.2), 6) AS boosted FROM memories WHERE NOT archived GROUP BY 1, 2 HAVING count(*) >= 3")
def consensus_groups(spark, d):
    g = relation(spark, d, "memories").where("not archived").groupBy("entity", "memory_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")).where("n >= 3")
    return g.select("entity", "memory_type", "n", r6(F.least(F.lit(1.0), F.col("c") + 0.2)).alias("boosted"))


@query("memory_events", "SELECT CASE WHEN hour(recorded_at) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(recorded_at) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(recorded_at) BETWEEN 18 AND 23 THEN 'evening' ELSE 'night' END AS part, count(*) AS n FROM memory_events GROUP BY 1")
def time_buckets(spark, d):
    return relation(spark, d, "memory_events").groupBy(S.day_part(F.col("recorded_at")).alias("part")).agg(F.count("*").alias("n"))


@query("memory_events", "WITH m AS (SELECT field, memory_id, max(event_id) AS v FROM memory_events GROUP BY 1, 2) SELECT field, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY 1")
def gcounter_merge(spark, d):
    return C.gcounter(relation(spark, d, "memory_events"), "field", "memory_id", "event_id")


@query("memory_events", "SELECT memory_id, arg_max(delta, (recorded_at, event_id)) AS delta FROM memory_events GROUP BY 1")
def lww_merge(spark, d):
    return C.lww(relation(spark, d, "memory_events"), "memory_id", "delta", "recorded_at", "event_id")


@query("memory_events", "SELECT memory_id, max(delta) AS delta FROM memory_events GROUP BY 1")
def maxreg_merge(spark, d):
    return C.max_register(relation(spark, d, "memory_events"), "memory_id", "delta")


@query("memory_events", "WITH t AS (SELECT memory_id, field, event_id % 3 AS tag, bool_or(event_type = 'contradicted') AS gone FROM memory_events GROUP BY 1, 2, 3) SELECT DISTINCT memory_id, field FROM t WHERE NOT gone")
def orset_merge(spark, d):
    e = relation(spark, d, "memory_events").select("memory_id", "field", (F.col("event_id") % 3).alias("tag"), (F.col("event_type") == "contradicted").alias("gone"))
    return C.or_set(e, "memory_id", "field", "tag", "gone")


@query(
    "memory_events",
    """WITH c AS (SELECT memory_id, field, count(*) FILTER (WHERE event_id % 2 = 0) AS x, count(*) FILTER (WHERE event_id % 2 = 1) AS y FROM memory_events GROUP BY 1, 2), f AS (SELECT memory_id, bool_or(x < y) AS lt, bool_or(x > y) AS gt FROM c GROUP BY 1)
    SELECT CASE WHEN lt AND gt THEN 'concurrent' WHEN lt THEN 'before' WHEN gt THEN 'after' ELSE 'equal' END AS ordering, count(*) AS n FROM f GROUP BY 1""",
)
def vector_clock_order(spark, d):
    c = relation(spark, d, "memory_events").groupBy("memory_id", "field").agg(F.count_if(F.col("event_id") % 2 == 0).alias("x"), F.count_if(F.col("event_id") % 2 == 1).alias("y"))
    clock = lambda v: F.map_from_entries(F.collect_list(F.struct("field", v)))
    g = c.groupBy("memory_id").agg(clock("x").alias("a"), clock("y").alias("b"))
    return g.groupBy(C.clock_order(F.col("a"), F.col("b")).alias("ordering")).agg(F.count("*").alias("n"))
