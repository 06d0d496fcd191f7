"""Derived aggregates, windows, evidence formulas and graph checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import knowledge as N
from orrery.functions import scores as S
from orrery.operators import graph as G
from orrery.operators import relational as R
from orrery.operators import temporal as T
from orrery.operators import text as X
from orrery.sources.facts import relation, table

from .registry import query

r6 = lambda c: F.round(c, 6)
_ONE = "CAST('2024-01-01' AS TIMESTAMP)"


def _one(df, *cells):
    """One row of aggregates, small enough to send everywhere."""
    return F.broadcast(df.agg(*cells))


# Aggregates

@query("memories", "SELECT memory_type, round(avg(confidence * access_count), 6) AS health FROM memories GROUP BY 1")
def product_aggregate(spark, d):
    return relation(spark, d, "memories").groupBy("memory_type").agg(r6(F.avg(F.col("confidence") * F.col("access_count"))).alias("health"))


@query("memories", "SELECT memory_type, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least FROM memories GROUP BY 1")
def confidence_aggregate(spark, d):
    """Mean, and the least as the conjunction of all."""
    return relation(spark, d, "memories").groupBy("memory_type").agg(r6(F.avg("confidence")).alias("mean"), r6(F.min("confidence")).alias("least"))


@query("detections", "SELECT pattern_id, file, md5(string_agg(DISTINCT line || ':' || column_num, ',' ORDER BY line || ':' || column_num)) AS digest FROM detections GROUP BY 1, 2")
def location_hash(spark, d):
    """One digest of a file's locations of a pattern, whatever their order."""
    at = F.concat_ws(":", "line", "column_num")
    return relation(spark, d, "detections").groupBy("pattern_id", "file").agg(F.md5(F.array_join(F.array_sort(F.collect_set(at)), ",")).alias("digest"))


@query("detections", "WITH x AS (SELECT pattern_id, file, line, column_num, max(confidence) AS c FROM detections GROUP BY 1, 2, 3, 4) SELECT pattern_id, count(*) AS locations, count(DISTINCT file) AS spread, round(avg(c), 6) AS mean, round(coalesce(stddev_samp(c), 0), 6) AS spread_of_confidence FROM x GROUP BY 1")
def reconcile_counters(spark, d):
    x = relation(spark, d, "detections").groupBy("pattern_id", "file", "line", "column_num").agg(F.max("confidence").alias("c"))
    return x.groupBy("pattern_id").agg(F.count("*").alias("locations"), F.countDistinct("file").alias("spread"), r6(F.avg("c")).alias("mean"), r6(F.coalesce(F.stddev_samp("c"), F.lit(0.0))).alias("spread_of_confidence"))


@query(
    "detections",
    """WITH x AS (SELECT pattern_id, category, file, line, column_num, count(*) AS n FROM detections GROUP BY 1, 2, 3, 4, 5), f AS (SELECT pattern_id, category, sum(n) AS hits, count(*) AS locations, count(DISTINCT file) AS files FROM x GROUP BY 1, 2)
    SELECT category, count(*) AS patterns, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(locations) AS BIGINT) AS locations, round(1 - sum(locations) * 1.0 / sum(hits), 6) AS dedup_ratio, count(*) FILTER (WHERE files > 1) AS multi_file FROM f GROUP BY 1""",
)
def diagnostics(spark, d):
    x = relation(spark, d, "detections").groupBy("pattern_id", "category", "file", "line", "column_num").agg(F.count("*").alias("n"))
    f = x.groupBy("pattern_id", "category").agg(F.sum("n").alias("hits"), F.count("*").alias("locations"), F.countDistinct("file").alias("files"))
    return f.groupBy("category").agg(F.count("*").alias("patterns"), F.sum("hits").alias("h"), F.sum("locations").alias("locations"), F.count_if(F.col("files") > 1).alias("multi_file")).select("category", "patterns", F.col("h").alias("hits"), "locations", r6(1 - F.col("locations") / F.col("h")).alias("dedup_ratio"), "multi_file")


@query("functions", "WITH s AS (SELECT module, name, count(*) AS n FROM functions GROUP BY 1, 2), x AS (SELECT module, CASE WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][A-Za-z0-9]*)+$') THEN 'camelCase' ELSE 'other' END AS style, sum(n) AS n FROM s GROUP BY 1, 2) SELECT module, style, round(n * 1.0 / sum(n) OVER (PARTITION BY module), 6) AS share, n >= 0.4 * sum(n) OVER (PARTITION BY module) AS is_constraint FROM x")
def naming_ratio(spark, d):
    """Share of each naming style in a module; a constraint where it leads (here from .4, as the names are mixed)."""
    f = relation(spark, d, "functions").groupBy("module", S.naming_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("module"))  # a row per style
    return f.select("module", "style", r6(F.col("n") / all_).alias("share"), (F.col("n") >= 0.4 * all_).alias("is_constraint"))


# Windows

@query("detections", "WITH c AS (SELECT category, count(*) AS n FROM detections GROUP BY 1), a AS (SELECT count(DISTINCT CAST(created_at AS DATE)) AS days FROM detections) SELECT category, CASE WHEN n * 1.0 / days > 5 THEN 'rapid' WHEN n * 1.0 / days < 0.5 THEN 'stagnant' ELSE 'healthy' END AS growth FROM c, a")
def growth_classify(spark, d):
    x = relation(spark, d, "detections")
    days = _one(x, F.countDistinct(F.to_date("created_at")).alias("days"))
    return x.groupBy("category").agg(F.count("*").alias("n")).join(days).select("category", N.growth(F.col("n") / F.col("days")).alias("growth"))


@query(
    "violations",
    """WITH m AS (SELECT project, year(created_at) AS y, avg(CASE WHEN severity = 'error' THEN 1.0 ELSE 0.0 END) AS distance FROM violations GROUP BY 1, 2), l AS (SELECT *, distance - lag(distance) OVER (PARTITION BY project ORDER BY y) AS delta FROM m)
    SELECT project, y, CASE WHEN delta < -0.05 THEN 'improving' WHEN delta > 0.05 THEN 'degrading' ELSE 'stable' END AS trend FROM l WHERE delta IS NOT NULL""",
)
def coupling_trend(spark, d):
    m = relation(spark, d, "violations").groupBy("project", F.year("created_at").cast("bigint").alias("y")).agg(F.avg(F.when(F.col("severity") == "error", 1.0).otherwise(0.0)).alias("distance"))
    delta = F.col("distance") - F.lag("distance").over(Window.partitionBy("project").orderBy("y"))
    return m.withColumn("delta", delta).where("delta is not null").select("project", "y", F.when(F.col("delta") < -0.05, "improving").when(F.col("delta") > 0.05, "degrading").otherwise("stable").alias("trend"))


@query("memory_events", "WITH s AS (SELECT memory_id, max(event_id) FILTER (WHERE event_id % 10 = 0) AS snap FROM memory_events GROUP BY 1) SELECT e.memory_id, count(*) AS pending, count(*) >= 20 AS due FROM memory_events AS e JOIN s USING (memory_id) WHERE e.event_id > coalesce(s.snap, -1) GROUP BY 1")
def events_since_snapshot(spark, d):
    """Events after a memory's latest snapshot (every tenth event takes one), and whether a new one is due."""
    e = relation(spark, d, "memory_events")
    snap = e.where("event_id % 10 = 0").groupBy("memory_id").agg(F.max("event_id").alias("snap"))
    return e.join(snap, "memory_id", "left").where(F.col("event_id") > F.coalesce("snap", F.lit(-1))).groupBy("memory_id").agg(F.count("*").alias("pending")).select("memory_id", "pending", (F.col("pending") >= 20).alias("due"))


@query("memory_events", "WITH x AS (SELECT event_type, delta, row_number() OVER (PARTITION BY event_type ORDER BY delta) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM memory_events WHERE delta IS NOT NULL) SELECT event_type, max(delta) FILTER (WHERE k = round(0.5 * (n - 1))) AS p50, max(delta) FILTER (WHERE k = round(0.95 * (n - 1))) AS p95 FROM x GROUP BY 1")
def latency_percentile(spark, d):
    """Nearest-rank percentiles; equal values are counted before the running sum, so its window holds distinct values only."""
    x = relation(spark, d, "memory_events").where("delta is not null").groupBy("event_type", "delta").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("delta")
    x = x.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    at = lambda p: F.min(F.when(F.col("upto") > F.round(p * (F.col("n") - 1)), F.col("delta")))
    return x.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("memories", "SELECT memory_id, round(access_count * confidence / (SELECT max(access_count * confidence) FROM memories), 6) AS score FROM memories")
def score_normalised(spark, d):
    m = relation(spark, d, "memories").withColumn("s", F.col("access_count") * F.col("confidence"))
    return m.join(_one(m, F.max("s").alias("top"))).select("memory_id", r6(F.col("s") / F.col("top")).alias("score"))


# Joins and filters

@query("memories", "WITH x AS (SELECT a.memory_id AS probe, b.memory_id AS found, row_number() OVER (PARTITION BY a.memory_id ORDER BY b.confidence DESC, b.memory_id) AS k FROM memories AS a JOIN memories AS b ON a.entity = b.entity AND a.memory_id <> b.memory_id WHERE a.memory_id % 50 = 0) SELECT probe, found FROM x WHERE k <= 5")
def shared_entity_topk(spark, d):
    """The five surest memories that share an entity with each probe; an entity's best six serve all its probes."""
    m = relation(spark, d, "memories").select("memory_id", "entity", "confidence")
    best = m.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("confidence"), "memory_id"))).where("k <= 6").select("entity", F.col("memory_id").alias("found"), "k")
    near = m.where("memory_id % 50 = 0").select(F.col("memory_id").alias("probe"), "entity").join(best, "entity").where("probe <> found")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("k"))).where("r <= 5").select("probe", "found")


@query("", "SELECT l.quality, count(*) AS vectors, count(DISTINCT e.label) AS labels FROM embeddings AS e JOIN labels AS l ON l.doc_id = e.vec_id GROUP BY 1")
def embedding_link_join(spark, d):
    e, l = table(spark, d, "embeddings").select("vec_id", "label"), table(spark, d, "labels").select("doc_id", "quality")
    return e.join(l, e.vec_id == l.doc_id).groupBy("quality").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("labels"))


@query("", "WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9]+')) AS term FROM pages) SELECT t.term, count(*) AS pages, CAST(sum(length(p.html)) AS BIGINT) AS chars FROM t JOIN pages AS p USING (page_id) GROUP BY 1 HAVING count(*) >= 3")
def fts_rowid_join(spark, d):
    """Inverted index of URL terms joined back to its rows."""
    p = table(spark, d, "pages")
    t = p.select("page_id", F.explode(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).distinct()
    return t.join(p.select("page_id", F.length("html").cast("bigint").alias("n")), "page_id").groupBy("term").agg(F.count("*").alias("pages"), F.sum("n").alias("chars")).where("pages >= 3")


@query(
    "memory_events memories",
    "WITH g AS (SELECT m.memory_type, count(*) AS conflicts FROM memory_events AS e JOIN memories AS m USING (memory_id) WHERE e.event_type = 'contradicted' GROUP BY 1), n AS (SELECT memory_type, count(*) AS memories FROM memories GROUP BY 1) SELECT memory_type, conflicts, round(conflicts * 1.0 / memories, 6) AS density FROM g JOIN n USING (memory_type) ORDER BY density DESC, memory_type LIMIT 1",
)
def conflict_hotspot(spark, d):
    """Where contradictions are densest."""
    m = relation(spark, d, "memories").select("memory_id", "memory_type")
    g = relation(spark, d, "memory_events").where("event_type = 'contradicted'").groupBy("memory_id").agg(F.count("*").alias("c")).join(m, "memory_id").groupBy("memory_type").agg(F.sum("c").alias("conflicts"))
    n = m.groupBy("memory_type").agg(F.count("*").alias("memories"))
    return g.join(n, "memory_type").select("memory_type", "conflicts", r6(F.col("conflicts") / F.col("memories")).alias("density")).orderBy(F.desc("density"), "memory_type").limit(1)


@query("memories call_edges functions", "SELECT m.memory_type, count(DISTINCT m.memory_id) AS memories, count(*) AS links FROM memories AS m JOIN call_edges AS e ON e.caller = m.memory_id JOIN functions AS f ON f.id = e.callee GROUP BY 1")
def memory_links_join(spark, d):
    m, e, f = relation(spark, d, "memories"), relation(spark, d, "call_edges"), relation(spark, d, "functions")
    return m.join(e, m.memory_id == e.caller).join(f.select("id"), F.col("callee") == F.col("id")).groupBy("memory_type").agg(F.countDistinct("memory_id").alias("memories"), F.count("*").alias("links"))


@query("memories memory_events", f"SELECT memory_id FROM memories AS m WHERE EXISTS (SELECT 1 FROM memory_events AS e WHERE e.memory_id = m.memory_id AND e.event_type <> 'created' AND e.recorded_at > {_ONE})")
def changed_after(spark, d):
    e = relation(spark, d, "memory_events").where(f"event_type <> 'created' and recorded_at > {_ONE}").select("memory_id")
    return relation(spark, d, "memories").join(e, "memory_id", "left_semi").select("memory_id")


@query("memories", f"SELECT memory_type, count(*) AS n FROM memories WHERE transaction_time > CAST('1996-06-01' AS TIMESTAMP) GROUP BY 1")
def created_after(spark, d):
    return relation(spark, d, "memories").where("transaction_time > cast('1996-06-01' as timestamp)").groupBy("memory_type").agg(F.count("*").alias("n"))


@query("memories detections", "SELECT m.memory_type, count(*) AS known FROM memories AS m WHERE m.entity IN (SELECT file FROM detections) GROUP BY 1")
def cross_catalog_count(spark, d):
    """Memories whose entity the analysis store knows."""
    files = relation(spark, d, "detections").select(F.col("file").alias("entity"))
    return relation(spark, d, "memories").join(files, "entity", "left_semi").groupBy("memory_type").agg(F.count("*").alias("known"))


@query("violations", "SELECT project, count(*) AS n FROM violations WHERE severity IN ('error', 'warning') AND cost BETWEEN 10000 AND 50000 AND (suppressed OR is_new) AND created_at >= CAST('1994-01-01' AS TIMESTAMP) AND file % 10 IN (1, 2, 3) GROUP BY 1")
def filter_object(spark, d):
    """A filter given as an object, each part a predicate."""
    wanted = {"severity": ["error", "warning"], "cost": (10000, 50000), "any": ["suppressed", "is_new"], "since": ("created_at", "1994-01-01")}
    v = relation(spark, d, "violations").where(R.matches(wanted)).where((F.col("file") % 10).isin(1, 2, 3))
    return v.groupBy("project").agg(F.count("*").alias("n"))


@query("memory_events", "SELECT CASE WHEN recorded_at < CAST('2024-01-15' AS TIMESTAMP) THEN 'archive' ELSE 'live' END AS side, event_type, count(*) AS n FROM memory_events GROUP BY 1, 2")
def archive_move(spark, d):
    """Old events move to the archive: the two sides of one predicate."""
    e = relation(spark, d, "memory_events")
    old, live = R.split_by(e, F.col("recorded_at") < F.lit("2024-01-15").cast("timestamp"))
    return old.withColumn("side", F.lit("archive")).unionByName(live.withColumn("side", F.lit("live"))).groupBy("side", "event_type").agg(F.count("*").alias("n"))


# Pattern intelligence

@query(
    "detections",
    """WITH s AS (SELECT pattern_id, avg(confidence) AS m, stddev_pop(confidence) AS sd FROM detections GROUP BY 1), x AS (SELECT d.id, d.pattern_id, CASE WHEN confidence <= 0 THEN 'high' WHEN sd > 0 AND abs(confidence - m) / sd > 3 THEN 'critical' WHEN m > 0 AND (m - confidence) / m > 0.5 THEN 'high' END AS tier FROM detections AS d JOIN s USING (pattern_id))
    SELECT id, tier, CASE WHEN tier IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS severity FROM x WHERE tier IS NOT NULL""",
)
def rule_outliers(spark, d):
    """Outliers by rules, turned into violations."""
    x = relation(spark, d, "detections")
    tier = N.rule_outlier(F.col("confidence"), F.col("m"), F.col("sd"))
    return x.join(x.groupBy("pattern_id").agg(F.avg("confidence").alias("m"), F.stddev_pop("confidence").alias("sd")), "pattern_id").select("id", tier.alias("tier")).where("tier is not null").withColumn("severity", N.violation_severity(F.col("tier")))


@query("detections", "SELECT CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'low' END AS tier, CASE WHEN confidence >= 0.7 THEN 'error' WHEN confidence >= 0.4 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM detections GROUP BY 1, 2")
def significance_tiers(spark, d):
    x = relation(spark, d, "detections").withColumn("tier", N.significance(F.col("confidence")))
    return x.groupBy("tier", N.violation_severity(F.col("tier")).alias("severity")).agg(F.count("*").alias("n"))


@query("violations", "SELECT project, CASE WHEN count(*) FILTER (WHERE is_new AND cost > 90000) = 0 THEN 'skip' WHEN count(*) FILTER (WHERE is_new AND cost > 90000) * 1.0 / count(*) > 0.10 THEN 'full' ELSE 'incremental' END AS mode FROM violations GROUP BY 1")
def relearn_mode(spark, d):
    g = relation(spark, d, "violations").groupBy("project").agg(F.count_if(F.col("is_new") & (F.col("cost") > 90000)).alias("changed"), F.count("*").alias("total"))
    return g.select("project", N.learning_mode(F.col("changed"), F.col("total")).alias("mode"))


@query("violations", "WITH s AS (SELECT rule_id, count(*) AS n FROM violations GROUP BY 1), p AS (SELECT a.rule_id AS a, b.rule_id AS b, least(a.n, b.n) * 1.0 / greatest(a.n, b.n) AS sim FROM s AS a JOIN s AS b ON b.rule_id = a.rule_id + 1) SELECT a, b, CASE WHEN sim > 0.95 THEN 'auto_merge' WHEN sim > 0.90 THEN 'merge' WHEN sim >= 0.85 THEN 'review' ELSE 'none' END AS tier FROM p")
def audit_duplicates(spark, d):
    """Tier of neighbouring rules by how near their counts are."""
    s = relation(spark, d, "violations").groupBy("rule_id").agg(F.count("*").alias("n"))
    b = s.select((F.col("rule_id") - 1).alias("a"), F.col("rule_id").alias("b"), F.col("n").alias("nb"))
    return s.withColumnRenamed("rule_id", "a").join(b, "a").select("a", "b", S.audit_duplicate_tier(F.least("n", "nb") / F.greatest("n", "nb")).alias("tier"))


# Evidence formulas

@query("memories", "SELECT memory_id, round(90.0 * least(2.0, greatest(1.0, 1 + log10(access_count + 1) / 2)) * (1 + 0.5 * confidence) * least(1.3, 1 + 0.06 * least(entity % 7, 5)), 6) AS days FROM memories")
def adaptive_half_life(spark, d):
    return relation(spark, d, "memories").select("memory_id", r6(N.adaptive_half_life(F.lit(90.0), F.col("access_count"), F.col("confidence"), F.col("entity") % 7)).alias("days"))


_COMPOSITE = "0.35 * least(1.0, access_count / 20.0) + 0.25 * CASE WHEN memory_id % 11 > 0 THEN greatest(0.0, least(1.0, 1 - (memory_id % 11 - 1) / 9.0)) ELSE 0 END + 0.15 * least(1.0, entity % 5 / 3.0) + 0.10 * least(1.0, memory_id % 7 / 5.0) + 0.15 * confidence"


@query("memories", f"WITH x AS (SELECT importance, {_COMPOSITE} AS s FROM memories) SELECT importance, CASE WHEN importance = 'low' AND s > 0.7 THEN 'normal' WHEN importance = 'normal' AND s > 0.85 THEN 'high' WHEN importance = 'high' AND s > 0.95 THEN 'critical' WHEN importance = 'critical' AND s < 0.5 THEN 'high' WHEN importance = 'high' AND s < 0.3 THEN 'normal' WHEN importance = 'normal' AND s < 0.15 THEN 'low' END AS becomes, count(*) AS n, round(avg(s), 6) AS composite FROM x GROUP BY 1, 2")
def reclassify(spark, d):
    """Importance levels that signals move, upgrades first."""
    s = N.reclass_composite(F.col("access_count"), F.col("memory_id") % 11, F.col("entity") % 5, F.col("memory_id") % 7, F.col("confidence"))
    x = relation(spark, d, "memories").select("importance", s.alias("s"))
    return x.groupBy("importance", N.reclassified(F.col("importance"), F.col("s")).alias("becomes")).agg(F.count("*").alias("n"), r6(F.avg("s")).alias("composite"))


@query("feedback", "WITH g AS (SELECT author, count(*) AS n, count(*) FILTER (WHERE action = 'fix') AS v, count(*) FILTER (WHERE action = 'escalate') AS u, count(*) FILTER (WHERE reason = 'false_positive') AS c FROM feedback GROUP BY 1) SELECT author, round(least(1.0, greatest(0.0, 0.5 + 0.05 * v + 0.03 * u - 0.10 * c)), 6) AS trust FROM g")
def weighted_trust(spark, d):
    g = relation(spark, d, "feedback").groupBy("author").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "fix").alias("v"), F.count_if(F.col("action") == "escalate").alias("u"), F.count_if(F.col("reason") == "false_positive").alias("c"))
    return g.select("author", r6(N.weighted_trust(F.col("n"), F.col("v"), F.col("u"), F.col("c"))).alias("trust"))


@query("feedback", "WITH g AS (SELECT author, count(*) FILTER (WHERE action = 'fix') * 1.0 / (count(*) + 1) AS t, max(event_id) % 30 AS days FROM feedback GROUP BY 1) SELECT author, round(t + (0.5 - t) * (1 - pow(0.99, days)), 6) AS trust FROM g")
def trust_decay(spark, d):
    g = relation(spark, d, "feedback").groupBy("author").agg((F.count_if(F.col("action") == "fix") / (F.count("*") + 1)).alias("t"), (F.max("event_id") % 30).alias("days"))
    return g.select("author", r6(S.trust_decay(F.col("t"), F.col("days"))).alias("trust"))


@query("memories", "SELECT memory_id, round(least(1.0, greatest(0.0, 0.30 * confidence + 0.25 * least(1.0, ln(1 + entity % 10) / ln(11)) + 0.15 * least(1.0, ln(1 + memory_id % 12) / ln(11)) + 0.15 * least(1.0, ln(1 + access_count) / ln(11)) + 0.15 * pow(0.5, memory_id % 365 / 90.0))), 6) AS confidence FROM memories")
def calibrate(spark, d):
    c = S.calibrate(F.col("confidence"), F.col("entity") % 10, F.col("memory_id") % 12, F.col("access_count"), F.col("memory_id") % 365)
    return relation(spark, d, "memories").select("memory_id", r6(c).alias("confidence"))


_PAIR = "x AS (SELECT entity, memory_id, memory_type, lag(memory_id) OVER w AS prev, lag(memory_type) OVER w AS prev_type FROM memories WINDOW w AS (PARTITION BY entity ORDER BY memory_id)), p AS (SELECT *, memory_id % 3 = prev % 3 AS f, memory_id % 5 = prev % 5 AS g, memory_id % 2 = prev % 2 AS h FROM x WHERE prev IS NOT NULL)"


@query("memories", f"WITH {_PAIR} SELECT prev, memory_id, round(0.4 * CASE WHEN f THEN 1.0 ELSE 1.0 / 3 END + 0.35 * CASE WHEN g THEN 1 ELSE 0 END + 0.25 * CASE WHEN h THEN 1 ELSE 0 END, 6) AS entities, round(0.5 * CASE WHEN f THEN 1.0 ELSE 1.0 / 3 END + 0.2 * CASE WHEN memory_type = prev_type THEN 0.3 ELSE 0 END + 0.3 * CASE WHEN g THEN 1 ELSE 0 END, 6) AS semantic, CASE WHEN f THEN 1.0 ELSE round(1.0 / 3, 6) END AS files FROM p")
def causal_strategies(spark, d):
    """Entity, semantic and file overlap of each memory with the one before it of its entity."""
    w = Window.partitionBy("entity").orderBy("memory_id")
    x = relation(spark, d, "memories").select("entity", "memory_id", "memory_type", F.lag("memory_id").over(w).alias("prev"), F.lag("memory_type").over(w).alias("prev_type")).where("prev is not null")
    files = lambda c: F.array(F.concat(F.lit("f"), (F.col(c) % 3).cast("string")), F.lit("common"))
    one = lambda c, n: F.array((F.col(c) % n).cast("string"))
    f, g, h = S.jaccard(files("memory_id"), files("prev")), S.jaccard(one("memory_id", 5), one("prev", 5)), S.jaccard(one("memory_id", 2), one("prev", 2))
    same = F.col("memory_type") == F.col("prev_type")
    return x.select("prev", "memory_id", r6(N.entity_overlap(f, g, h)).alias("entities"), r6(N.semantic_overlap(f, same, g == 1)).alias("semantic"), r6(f).alias("files"))


@query("call_edges", "SELECT caller, callee, round(0.25 * confidence + 0.20 * (line % 10) / 10.0 + 0.15 * (line % 7) / 7.0 + 0.15 * (line % 5) / 5.0 + 0.10 * (line % 4) / 4.0 + 0.08 * (line % 3) / 3.0 + 0.07 * (line % 2), 6) AS confidence FROM call_edges")
def contract_confidence(spark, d):
    e = relation(spark, d, "call_edges")
    c = N.contract_confidence([F.col("confidence"), *((F.col("line") % n) / float(n) for n in (10, 7, 5, 4, 3)), (F.col("line") % 2).cast("double")])
    return e.select("caller", "callee", r6(c).alias("confidence"))


_WEIGHT = "CASE event_type WHEN 'created' THEN 0.18 WHEN 'confidence_changed' THEN 0.13 WHEN 'contradicted' THEN 0.09 WHEN 'accessed' THEN 0.07 ELSE 0.05 END"


@query("memory_events", f"WITH x AS (SELECT memory_id, {_WEIGHT} AS w, least(1.0, delta / 500.0) AS s FROM memory_events), g AS (SELECT memory_id, sum(w * s) / sum(w) AS score FROM x GROUP BY 1) SELECT CASE WHEN score >= 0.7 THEN 'validated' WHEN score >= 0.4 THEN 'partial' WHEN score >= 0.2 THEN 'weak' ELSE 'invalidated' END AS verdict, count(*) AS n, round(avg(score), 6) AS mean FROM g GROUP BY 1")
def grounding(spark, d):
    """Memories by how well weighted evidence supports them."""
    kind = F.create_map(*(F.lit(x) for pair in (("created", "pattern_confidence"), ("confidence_changed", "pattern_occurrence"), ("contradicted", "false_positive_rate"), ("accessed", "coupling_metric"), ("modified", "boundary_data")) for x in pair))
    weights = F.create_map(*(F.lit(x) for pair in N.EVIDENCE_WEIGHTS.items() for x in pair))
    e = relation(spark, d, "memory_events").select("memory_id", weights[kind[F.col("event_type")]].alias("w"), F.least(F.lit(1.0), F.col("delta") / 500.0).alias("s"))
    g = e.groupBy("memory_id").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("score"))
    return g.groupBy(N.grounding_verdict(F.col("score")).alias("verdict")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"))


@query("violations", "SELECT file, round(greatest(0.0, 100 - sum(CASE severity WHEN 'error' THEN 15.0 WHEN 'warning' THEN 8.0 ELSE 3.0 END * CASE WHEN suppressed THEN 0.2 ELSE 0.5 END)), 4) AS health, count(*) FILTER (WHERE severity = 'error') AS critical FROM violations GROUP BY 1")
def crypto_health(spark, d):
    """100 less 15, 8 or 3 for each finding, by its severity and confidence."""
    penalty = F.when(F.col("severity") == "error", 15.0).when(F.col("severity") == "warning", 8.0).otherwise(3.0) * F.when(F.col("suppressed"), 0.2).otherwise(0.5)
    return relation(spark, d, "violations").groupBy("file").agg(F.round(S.clamp(100 - F.sum(penalty), 0.0, 100.0), 4).alias("health"), F.count_if(F.col("severity") == "error").alias("critical"))


@query(
    "violations",
    """WITH a AS (SELECT project, rule_id AS gene, severity, count(*) AS n FROM violations GROUP BY 1, 2, 3), g AS (SELECT project, gene, max(n) * 1.0 / sum(n) AS c, count(*) AS alleles, sum(n) - max(n) AS m FROM a GROUP BY 1, 2)
    SELECT project, round(least(100.0, 100 * (0.4 * avg(c) + 0.3 * avg(c) + 0.2 * (1 - least(1.0, sum(CASE WHEN c < 0.6 THEN 1 ELSE 0 END) * 1.0 / count(*))) + 0.1 * avg(CASE WHEN c >= 0.6 THEN 1.0 ELSE 0.0 END)))) AS health, round(least(1.0, sum(alleles) / (5.0 * count(*))), 6) AS diversity FROM g GROUP BY 1""",
)
def dna_health(spark, d):
    """Consistency, confidence, mutations and coverage of a project's genes, and their diversity."""
    a = relation(spark, d, "violations").groupBy("project", F.col("rule_id").alias("gene"), "severity").agg(F.count("*").alias("n"))
    g = a.groupBy("project", "gene").agg((F.max("n") / F.sum("n")).alias("c"), F.count("*").alias("alleles"))
    strong = F.col("c") >= 0.6
    overall = 100 * (0.7 * F.avg("c") + 0.2 * (1 - F.least(F.lit(1.0), F.count_if(~strong) / F.count("*"))) + 0.1 * F.avg(F.when(strong, 1.0).otherwise(0.0)))
    return g.groupBy("project").agg(F.round(S.clamp(overall, 0.0, 100.0)).alias("health"), r6(F.least(F.lit(1.0), F.sum("alleles") / (5.0 * F.count("*")))).alias("diversity"))


@query("functions", "WITH x AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'int' WHEN id % 4 = 1 THEN 'string' WHEN id % 4 = 2 THEN 'double' ELSE 'any' END AS a, CASE WHEN id % 3 = 0 THEN 'number' WHEN id % 3 = 1 THEN 'uuid' ELSE 'boolean' END AS b FROM functions) SELECT a, b, bool_or(a = 'any' OR (a IN ('int', 'double') AND b = 'number') OR (a = 'string' AND b = 'uuid')) AS compatible, count(*) AS n FROM x GROUP BY 1, 2")
def type_compatibility(spark, d):
    i = F.col("id")
    x = relation(spark, d, "functions").select(F.element_at(F.array(*map(F.lit, ("int", "string", "double", "any"))), (i % 4 + 1).cast("int")).alias("a"), F.element_at(F.array(*map(F.lit, ("number", "uuid", "boolean"))), (i % 3 + 1).cast("int")).alias("b"))
    return x.groupBy("a", "b").agg(F.bool_or(S.types_compatible(F.col("a"), F.col("b"))).alias("compatible"), F.count("*").alias("n"))


@query("", "WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS ch, length(url) AS n FROM pages), k AS (SELECT page_id, n, ch, count(*) AS k FROM c GROUP BY 1, 2, 3), b AS (SELECT page_id, -sum(k * 1.0 / n * log2(k * 1.0 / n)) AS bits FROM k GROUP BY 1) SELECT CASE WHEN bits >= 5 THEN 'very_high' WHEN bits >= 3.5 THEN 'high' WHEN bits >= 2 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM b GROUP BY 1")
def entropy_level(spark, d):
    p = table(spark, d, "pages").where("length(url) > 0").select(F.round(S.shannon_entropy(F.col("url")), 9).alias("bits"))
    return p.groupBy(S.entropy_level(F.col("bits")).alias("level")).agg(F.count("*").alias("n"))


@query("functions", "SELECT string_split(path, '/')[1] AS module, count(*) AS functions FROM functions GROUP BY 1")
def module_of_file(spark, d):
    return relation(spark, d, "functions").groupBy(F.substring_index("path", "/", 1).alias("module")).agg(F.count("*").alias("functions"))


@query("call_edges", "SELECT resolution, count(*) AS n FROM call_edges WHERE caller % 100 = 7 OR callee % 100 = 7 GROUP BY 1")
def either_endpoint(spark, d):
    """Edges that touch a node on either side."""
    e = relation(spark, d, "call_edges").where(R.either_is(F.col("caller") % 100, F.col("callee") % 100, 7))
    return e.groupBy("resolution").agg(F.count("*").alias("n"))


# Graph checks

@query("call_edges functions", f"""WITH RECURSIVE e AS (SELECT DISTINCT caller AS src, callee AS dst FROM call_edges WHERE caller <> callee), r(start, node) AS (SELECT src, dst FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node),
    g AS (SELECT r.start, bool_or(f.name = 'userRepository') AS s, bool_or(f.name = 'invokeAll') AS c, bool_or(f.name = 'lazyPane') AS fl, bool_or(f.name = 'apiList') AS nw FROM r JOIN functions AS f ON f.id = r.node WHERE r.start <> r.node GROUP BY 1)
    SELECT f.id, CASE WHEN f.name = 'onClick' AND (coalesce(s, false) OR coalesce(c, false)) THEN 'critical' WHEN f.name = 'onClick' AND (coalesce(fl, false) OR coalesce(nw, false)) THEN 'high' WHEN f.name = 'main' AND (coalesce(s, false) OR coalesce(c, false) OR coalesce(fl, false)) THEN 'medium' ELSE 'low' END AS sensitivity FROM functions AS f LEFT JOIN g ON g.start = f.id""")
def reach_sensitivity(spark, d):
    """How sensitive what a function reaches is, by where it starts and which sinks are below it."""
    f = relation(spark, d, "functions").select("id", "name")
    e = G.clean_edges(relation(spark, d, "call_edges"), "caller", "callee")
    sinks = f.select(F.col("id").alias("node"), *((F.col("name") == n).alias(k) for n, k in (("userRepository", "sql"), ("invokeAll", "command"), ("lazyPane", "file"), ("apiList", "network")))).where("sql or command or file or network")
    # Only what leads to a sink matters: search backwards from the sinks.
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = G.reach(back, sinks.select(F.col("node").alias("start"))).select(F.col("start").alias("node"), F.col("node").alias("id"))
    g = above.join(sinks, "node").groupBy("id").agg(*(F.bool_or(c).alias(c) for c in ("sql", "command", "file", "network")))
    x = f.join(g, "id", "left").fillna(False)
    flag = [F.coalesce(F.col(c), F.lit(False)) for c in ("sql", "command", "file", "network")]
    return x.select("id", N.reach_sensitivity(F.col("name") == "onClick", F.col("name") == "main", *flag).alias("sensitivity"))


@query("call_edges", "WITH k AS (SELECT caller, callee FROM call_edges WHERE confidence >= 0.8), n AS (SELECT caller AS id FROM call_edges UNION SELECT callee FROM call_edges), m AS (SELECT caller AS id FROM k UNION SELECT callee FROM k) SELECT (SELECT count(*) FROM call_edges WHERE confidence < 0.8) AS edges_removed, count(*) AS nodes_removed FROM n WHERE id NOT IN (SELECT id FROM m)")
def prune_weak_edges(spark, d):
    """Weak edges go, and nodes that are left without any."""
    e = relation(spark, d, "call_edges")
    ends = lambda x: x.select(F.explode(F.array("caller", "callee")).alias("id")).distinct()
    gone = ends(e).join(ends(e.where("confidence >= 0.8")), "id", "left_anti").agg(F.count("*").alias("nodes_removed"))
    return e.agg(F.count_if(F.col("confidence") < 0.8).alias("edges_removed")).join(F.broadcast(gone))


@query("call_edges", "WITH RECURSIVE e AS (SELECT DISTINCT caller AS src, callee AS dst FROM call_edges WHERE caller <> callee), r(start, node) AS (SELECT src, dst FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node), p AS (SELECT DISTINCT dst AS a, src AS b FROM e WHERE src % 5 = 0 UNION SELECT DISTINCT src, src + 1 FROM e) SELECT p.a AS source, p.b AS target, NOT EXISTS (SELECT 1 FROM r WHERE r.start = p.b AND r.node = p.a) AS accepted FROM p WHERE p.a <> p.b")
def cycle_safe_insert(spark, d):
    """Proposed edges, refused where the target already reaches the source."""
    e = G.clean_edges(relation(spark, d, "call_edges"), "caller", "callee")
    p = e.where("src % 5 = 0").select(F.col("dst").alias("source"), F.col("src").alias("target")).union(e.select("src", F.col("src") + 1)).distinct().where("source <> target")
    closing = G.reached_pairs(e, p.select(F.col("target").alias("start"), F.col("source").alias("node")))
    return closing.select(F.col("node").alias("source"), F.col("start").alias("target"), (~F.col("reached")).alias("accepted"))


@query("call_edges functions", "WITH RECURSIVE e AS (SELECT DISTINCT caller AS src, callee AS dst FROM call_edges WHERE caller <> callee), r(start, node) AS (SELECT src, dst FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node) SELECT f.id AS removed, count(DISTINCT r.node) AS affected FROM functions AS f JOIN r ON r.start = f.id AND r.node <> f.id WHERE f.is_entry GROUP BY 1")
def counterfactual(spark, d):
    """What would be affected had an entry point not been there: everything below it."""
    e = G.clean_edges(relation(spark, d, "call_edges"), "caller", "callee")
    starts = relation(spark, d, "functions").where("is_entry").select(F.col("id").alias("start"))
    return G.reach(e, starts).groupBy(F.col("start").alias("removed")).agg(F.count("*").alias("affected"))


_NET = "net AS (SELECT DISTINCT l_suppkey % 40 AS src, (l_suppkey % 40 * 3 + l_linenumber) % 40 AS dst FROM lineitem WHERE l_suppkey % 40 <> (l_suppkey % 40 * 3 + l_linenumber) % 40 AND l_suppkey % 3 = 0)"


@query("", f"WITH RECURSIVE {_NET}, r(start, node) AS (SELECT src, dst FROM net UNION SELECT r.start, net.dst FROM r JOIN net ON net.src = r.node), c AS (SELECT a.start AS node, min(a.node) AS component FROM r AS a JOIN r AS b ON b.start = a.node AND b.node = a.start GROUP BY 1 HAVING count(DISTINCT a.node) > 1), i AS (SELECT n.dst AS node, count(*) AS k FROM net AS n JOIN c AS x ON x.node = n.src JOIN c AS y ON y.node = n.dst WHERE x.component = y.component GROUP BY 1) SELECT c.component, n.src, n.dst, round(1.0 / i.k, 6) AS impact FROM net AS n JOIN c ON c.node = n.src JOIN c AS y ON y.node = n.dst AND y.component = c.component JOIN i ON i.node = n.dst")
def cycle_breaks(spark, d):
    """Edges inside import cycles, with what removing one would achieve: the fewer other edges enter its target, the more."""
    src = F.col("l_suppkey") % 40
    e = G.clean_edges(table(spark, d, "lineitem").where("l_suppkey % 3 = 0").select(src.alias("a"), ((src * 3 + F.col("l_linenumber")) % 40).alias("b")), "a", "b")
    c = G.strong_components(e)
    inside = e.join(c.select(F.col("node").alias("src"), "component"), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    k = inside.groupBy("dst").agg(F.count("*").alias("k"))
    return inside.join(k, "dst").select("component", "src", "dst", r6(1.0 / F.col("k")).alias("impact"))


# Temporal

@query("memories", "SELECT memory_type, count(*) FILTER (WHERE m.memory_id % 13 = 0 AND NOT EXISTS (SELECT 1 FROM memories AS x WHERE x.memory_id = m.memory_id + 1)) AS dangling, count(*) AS n FROM memories AS m GROUP BY 1")
def referential_integrity(spark, d):
    """Memories superseded by one that isn't in the set: the reference is dropped."""
    m = relation(spark, d, "memories").select("memory_id", "memory_type")
    known = m.select(F.col("memory_id").alias("ref"), F.lit(True).alias("ok"))
    x = m.withColumn("ref", F.when(F.col("memory_id") % 13 == 0, F.col("memory_id") + 1)).join(known, "ref", "left")
    return x.groupBy("memory_type").agg(F.count_if(F.col("ref").isNotNull() & F.col("ok").isNull()).alias("dangling"), F.count("*").alias("n"))


@query(
    "memory_events",
    """WITH x AS (SELECT memory_id, recorded_at, event_id FROM memory_events WHERE event_type = 'contradicted'), l AS (SELECT *, lag(recorded_at) OVER (PARTITION BY memory_id ORDER BY recorded_at, event_id) AS prev FROM x)
    SELECT memory_id, count(*) AS alerts FROM l WHERE prev IS NULL OR recorded_at - prev > INTERVAL 1 DAY GROUP BY 1""",
)
def dampened_alerts(spark, d):
    """Contradiction alerts, silent within a day of the one before."""
    prev = F.lag("recorded_at").over(Window.partitionBy("memory_id").orderBy("recorded_at", "event_id"))
    x = relation(spark, d, "memory_events").where("event_type = 'contradicted'").withColumn("prev", prev)
    return x.where("prev is null or recorded_at - prev > interval 1 day").groupBy("memory_id").agg(F.count("*").alias("alerts"))


@query(
    "memories",
    """WITH k AS (SELECT memory_id, entity, transaction_time AS at FROM memories WHERE memory_type = '1-URGENT')
    SELECT k.memory_id AS decision, count(*) FILTER (WHERE m.transaction_time <= k.at AND (m.valid_until IS NULL OR m.valid_until > k.at)) AS context, count(*) FILTER (WHERE m.transaction_time > k.at) AS hindsight FROM k JOIN memories AS m ON m.entity = k.entity AND m.memory_id <> k.memory_id GROUP BY 1""",
)
def decision_replay(spark, d):
    """What was known of a decision's entity when it was made, and what came to light later."""
    m = relation(spark, d, "memories")
    k = m.where("memory_type = '1-URGENT'").select(F.col("memory_id").alias("decision"), "entity", F.col("transaction_time").alias("at"))
    j = k.join(m.select("memory_id", "entity", "transaction_time", "valid_until"), "entity").where("memory_id <> decision")
    known = (F.col("transaction_time") <= F.col("at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("at")))
    return j.groupBy("decision").agg(F.count_if(known).alias("context"), F.count_if(F.col("transaction_time") > F.col("at")).alias("hindsight"))


@query("memory_events", "WITH p AS (SELECT memory_id, recorded_at AS at FROM memory_events WHERE event_id % 50 = 0), s AS (SELECT memory_id, event_id, recorded_at FROM memory_events WHERE event_type = 'created') SELECT p.memory_id, p.at, max_by(s.event_id, s.recorded_at) AS snapshot FROM p JOIN s ON s.memory_id = p.memory_id AND s.recorded_at <= p.at GROUP BY 1, 2")
def as_of_snapshot(spark, d):
    """The latest snapshot at or before each probe."""
    e = relation(spark, d, "memory_events")
    p = e.where("event_id % 50 = 0").select("memory_id", F.col("recorded_at").alias("at"))
    s = e.where("event_type = 'created'").select("memory_id", F.col("event_id").alias("snapshot"), F.col("recorded_at").alias("ts"))
    return T.as_of_nearest(p, s, "memory_id", "at", "ts", ["snapshot"]).where("snapshot is not null")


@query("memories", "WITH x AS (SELECT CASE memory_id % 4 WHEN 0 THEN 'conjecture' WHEN 1 THEN 'provisional' WHEN 2 THEN 'verified' ELSE 'stale' END AS a, CASE memory_id % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'verified' ELSE 'stale' END AS b FROM memories) SELECT a, b, CASE WHEN (a, b) IN (('conjecture', 'provisional'), ('provisional', 'verified'), ('verified', 'stale'), ('provisional', 'stale'), ('stale', 'verified')) THEN b END AS becomes, count(*) AS n FROM x GROUP BY 1, 2, 3")
def epistemic_moves(spark, d):
    """Requested moves of the epistemic state machine and what comes of them."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("memory_id") % len(names) + 1).cast("int"))
    x = relation(spark, d, "memories").select(pick(("conjecture", "provisional", "verified", "stale")).alias("a"), pick(("provisional", "verified", "stale")).alias("b"))
    return x.groupBy("a", "b", T.transition(F.col("a"), F.col("b")).alias("becomes")).agg(F.count("*").alias("n"))


@query("memories", "WITH x AS (SELECT memory_id, confidence, CASE importance WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'normal' THEN 0.5 ELSE 0.25 END AS w FROM memories WHERE NOT archived AND confidence < 0.5) SELECT memory_id, round((1 - confidence) * w, 6) AS priority FROM x ORDER BY round((1 - confidence) * w, 9) DESC, memory_id LIMIT 20")
def active_learning(spark, d):
    """The twenty memories whose confirmation is worth most (the report's own length)."""
    w = F.when(F.col("importance") == "critical", 1.0).when(F.col("importance") == "high", 0.75).when(F.col("importance") == "normal", 0.5).otherwise(0.25)
    x = relation(spark, d, "memories").where("not archived and confidence < 0.5").withColumn("p", (1 - F.col("confidence")) * w)
    return x.orderBy(F.desc(F.round("p", 9)), "memory_id").limit(20).select("memory_id", r6(F.col("p")).alias("priority"))


@query("memories feedback", "WITH t AS (SELECT author, count(*) FILTER (WHERE action = 'fix') * 1.0 / count(*) AS trust FROM feedback GROUP BY 1) SELECT memory_id, round(confidence * coalesce(trust, 0.5), 6) AS score FROM memories AS m LEFT JOIN t ON t.author = m.entity")
def trust_weighting(spark, d):
    """Scores times the trust in their author, a half where nothing is known."""
    t = relation(spark, d, "feedback").groupBy(F.col("author").alias("entity")).agg((F.count_if(F.col("action") == "fix") / F.count("*")).alias("trust"))
    return relation(spark, d, "memories").join(t, "entity", "left").select("memory_id", r6(F.col("confidence") * F.coalesce("trust", F.lit(0.5))).alias("score"))


@query("memories", "WITH a AS (SELECT max(transaction_time) AS now FROM memories), x AS (SELECT valid_until IS NOT NULL AND valid_until < now AS gone, date_diff('day', CAST(transaction_time AS DATE), CAST(now AS DATE)) AS age FROM memories, a) SELECT CASE WHEN gone THEN 'expired' WHEN age > 1.5 * 1000 THEN 'overdue' WHEN age > 0.8 * 1000 THEN 'due' ELSE 'fresh' END AS flag, count(*) AS n, round(avg(CASE WHEN gone THEN 0 ELSE pow(2.0, -age / 1000.0) END), 6) AS validity FROM x GROUP BY 1")
def temporal_validity(spark, d):
    """Validity of memories: none after their end, else halved each half-life; flagged from .8 and 1.5 of it."""
    m = relation(spark, d, "memories")
    x = m.join(_one(m, F.max("transaction_time").alias("now"))).select(F.coalesce(F.col("valid_until") < F.col("now"), F.lit(False)).alias("gone"), F.date_diff(F.to_date("now"), F.to_date("transaction_time")).alias("age"))
    flag = F.when(F.col("gone"), "expired").when(F.col("age") > 1500, "overdue").when(F.col("age") > 800, "due").otherwise("fresh")
    return x.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"), r6(F.avg(S.validity(F.col("age"), F.lit(1000.0), F.col("gone")))).alias("validity"))


@query("functions", "SELECT CASE WHEN regexp_matches(lower(name), 'password|secret|token|credential') THEN 'secret' ELSE 'none' END AS kind, count(*) AS n FROM functions GROUP BY 1")
def sensitive_names(spark, d):
    return relation(spark, d, "functions").groupBy(X.sensitivity(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))
