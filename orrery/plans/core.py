"""Relational queries: summaries, filters, paging, views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import relational as R
from orrery.sources.facts import relation, table

from .registry import query

big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)


@query("detections", "SELECT detection_method, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM detections GROUP BY 1")
def detection_summary(spark, d):
    return relation(spark, d, "detections").groupBy("detection_method").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("avg_confidence"))


@query("detections", "SELECT category, pattern_id, count(*) AS n, count(DISTINCT file) AS files, round(max(confidence), 6) AS best FROM detections GROUP BY 1, 2")
def detections_by_category(spark, d):
    return relation(spark, d, "detections").groupBy("category", "pattern_id").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), r6(F.max("confidence")).alias("best"))


@query("detections", "SELECT id, file, pattern_id FROM detections WHERE lower(pattern_id) LIKE 'cl%'")
def detections_by_prefix(spark, d):
    return relation(spark, d, "detections").where(R.ilike_prefix(F.col("pattern_id"), "CL")).select("id", "file", "pattern_id")


@query("detections", "SELECT id, file, line, round(confidence, 6) AS confidence FROM detections WHERE category = 'errors' AND confidence BETWEEN 0.5 AND 0.9")
def detections_in_range(spark, d):
    return relation(spark, d, "detections").where((F.col("category") == "errors") & F.col("confidence").between(0.5, 0.9)).select("id", "file", "line", r6(F.col("confidence")).alias("confidence"))


@query(
    "detections violations call_edges functions memories",
    "SELECT 'detections' AS name, count(*) AS n FROM detections UNION ALL SELECT 'violations', count(*) FROM violations UNION ALL SELECT 'call_edges', count(*) FROM call_edges "
    "UNION ALL SELECT 'functions', count(*) FROM functions UNION ALL SELECT 'memories', count(*) FROM memories",
)
def count_tables(spark, d):
    out = None
    for name in ("detections", "violations", "call_edges", "functions", "memories"):
        one = relation(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "detections",
    """SELECT count(*) AS total, count(*) FILTER (WHERE category IN ('auth', 'data_access')) AS sensitive,
    count(*) FILTER (WHERE category = 'errors' AND confidence > 0.8) AS critical, count(DISTINCT file) AS files, round(avg(confidence), 6) AS avg_confidence FROM detections""",
)
def security_view(spark, d):
    c = F.col("category")
    return relation(spark, d, "detections").agg(
        F.count("*").alias("total"), F.count_if(c.isin("auth", "data_access")).alias("sensitive"), F.count_if((c == "errors") & (F.col("confidence") > 0.8)).alias("critical"),
        F.countDistinct("file").alias("files"), r6(F.avg("confidence")).alias("avg_confidence"),
    )


@query(
    "violations",
    """SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE suppressed) AS suppressed, count(*) FILTER (WHERE is_new) AS new
    FROM violations WHERE created_at = (SELECT max(created_at) FROM violations)""",
)
def status_view(spark, d):
    v = relation(spark, d, "violations")
    last = v.agg(F.max("created_at").alias("last"))
    latest = v.join(F.broadcast(last), v.created_at == last.last)  # one row
    return latest.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if("suppressed").alias("suppressed"), F.count_if("is_new").alias("new"))


@query(
    "violations",
    """SELECT rule_id, count(*) AS n, count(DISTINCT file) AS files, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE NOT suppressed) AS open
    FROM violations GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 20""",
)
def violations_top_rules(spark, d):
    g = relation(spark, d, "violations").groupBy("rule_id")
    out = g.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(~F.col("suppressed")).alias("open"))
    return out.orderBy(F.desc("n"), "rule_id").limit(20)


@query("violations", "SELECT CAST(created_at AS DATE) AS day, severity, count(*) AS n FROM violations GROUP BY 1, 2")
def violations_daily(spark, d):
    return relation(spark, d, "violations").groupBy(F.to_date("created_at").alias("day"), "severity").agg(F.count("*").alias("n"))


@query(
    "violations",
    """WITH p AS (SELECT project, count(*) AS total, count(*) FILTER (WHERE severity = 'error' AND NOT suppressed) AS errors, count(*) FILTER (WHERE is_new) AS new, max(created_at) AS last_at FROM violations GROUP BY 1),
    last AS (SELECT v.project, count(*) AS last_n FROM violations AS v JOIN p ON p.project = v.project AND p.last_at = v.created_at GROUP BY 1)
    SELECT p.project, total, errors, new, round(100.0 * (total - errors) / total, 6) AS score, last_at, last_n FROM p JOIN last USING (project)""",
)
def project_health(spark, d):
    # One aggregation: the number of rows at the latest time rides along as a count by time, folded per project.
    v = relation(spark, d, "violations")
    by_time = v.groupBy("project", "created_at").agg(F.count("*").alias("n"), F.count_if((F.col("severity") == "error") & ~F.col("suppressed")).alias("e"), F.count_if("is_new").alias("w"))
    out = by_time.groupBy("project").agg(F.sum("n").alias("total"), F.sum("e").alias("errors"), F.sum("w").alias("new"), F.max("created_at").alias("last_at"), F.max_by("n", "created_at").alias("last_n"))
    return out.select("project", "total", "errors", "new", r6(100.0 * (F.col("total") - F.col("errors")) / F.col("total")).alias("score"), "last_at", "last_n")


@query(
    "violations",
    """SELECT project, greatest(0.0, round(100 - sum(CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 WHEN 'info' THEN 1 ELSE 0 END) FILTER (WHERE NOT suppressed) * 100.0 / (10.0 * count(*)), 6)) AS posture,
    count(*) FILTER (WHERE suppressed) AS suppressed FROM violations GROUP BY 1""",
)
def security_posture(spark, d):
    # Penalties 10 / 3 / 1 / 0 by severity.
    penalty = F.when(~F.col("suppressed"), F.when(F.col("severity") == "error", 10).when(F.col("severity") == "warning", 3).when(F.col("severity") == "info", 1).otherwise(0))
    g = relation(spark, d, "violations").groupBy("project").agg(F.sum(penalty).alias("p"), F.count("*").alias("n"), F.count_if("suppressed").alias("suppressed"))
    return g.select("project", F.greatest(F.lit(0.0), F.round(100 - F.col("p") * 100.0 / (10.0 * F.col("n")), 6)).alias("posture"), "suppressed")


@query(
    "violations",
    """WITH a AS (SELECT max(created_at) AS now FROM violations) SELECT count(*) AS kept, count(DISTINCT file) AS files FROM violations, a
    WHERE created_at >= now - INTERVAL 1 DAY * CASE severity WHEN 'error' THEN 365 WHEN 'warning' THEN 90 ELSE 30 END""",
)
def retention_survivors(spark, d):
    v = relation(spark, d, "violations")
    now = v.agg(F.max("created_at").alias("now"))
    days = F.when(F.col("severity") == "error", 365).when(F.col("severity") == "warning", 90).otherwise(30)
    kept = v.join(F.broadcast(now)).where(F.col("created_at") >= F.col("now") - F.make_dt_interval(days))
    return kept.agg(F.count("*").alias("kept"), F.countDistinct("file").alias("files"))


@query("call_edges functions", "SELECT DISTINCT callee FROM call_edges WHERE callee NOT IN (SELECT id FROM functions)")
def orphan_rows(spark, d):
    e, f = relation(spark, d, "call_edges"), relation(spark, d, "functions")
    return e.select("callee").distinct().join(f.select(F.col("id").alias("callee")), "callee", "left_anti")


@query("call_edges functions", "SELECT count(*) AS entry_points FROM functions WHERE id NOT IN (SELECT callee FROM call_edges)")
def entry_point_count(spark, d):
    e, f = relation(spark, d, "call_edges"), relation(spark, d, "functions")
    return f.join(e.select(F.col("callee").alias("id")), "id", "left_anti").agg(F.count("*").alias("entry_points"))


@query("detections", "SELECT id, file, confidence_6 AS confidence, (SELECT count(*) FROM detections WHERE id > 100) > 50 AS has_more FROM (SELECT id, file, round(confidence, 6) AS confidence_6 FROM detections WHERE id > 100 ORDER BY id LIMIT 50)")
def keyset_page(spark, d):
    page = R.keyset_page(relation(spark, d, "detections").select("id", "file", "confidence"), "id", 100, 50)
    return page.select("id", "file", r6(F.col("confidence")).alias("confidence"), "has_more")


@query("detections", "SELECT id, file, round(confidence, 6) AS confidence FROM detections WHERE confidence < 0.5 OR (confidence = 0.5 AND id > 10) ORDER BY detections.confidence DESC, id LIMIT 25")
def composite_cursor_page(spark, d):
    return R.composite_page(relation(spark, d, "detections"), "confidence", "id", (0.5, 10), 25).select("id", "file", r6(F.col("confidence")).alias("confidence"))


@query("detections", "SELECT id, pattern_id, file FROM detections ORDER BY file, id OFFSET 40 LIMIT 20")
def offset_page(spark, d):
    return R.offset_page(relation(spark, d, "detections").select("id", "pattern_id", "file"), [F.col("file"), F.col("id")], 40, 20)


@query("detections", "SELECT file, id, pattern_id FROM detections QUALIFY row_number() OVER (PARTITION BY file ORDER BY created_at DESC, id DESC) = 1")
def latest_per_key(spark, d):
    return R.latest_wins(relation(spark, d, "detections").select("file", "id", "pattern_id", "created_at"), ["file"], [F.col("created_at"), F.col("id")]).drop("created_at")


@query("detections", "SELECT file, line, pattern_id, max(id) AS id FROM detections GROUP BY 1, 2, 3")
def upsert_latest(spark, d):
    return R.latest_wins(relation(spark, d, "detections").select("file", "line", "pattern_id", "id"), ["file", "line", "pattern_id"], [F.col("id")])


@query(
    "detections",
    """WITH old AS (SELECT file, pattern_id, min(id) AS id FROM detections WHERE detection_method < 2 GROUP BY 1, 2), new AS (SELECT file, pattern_id, min(id) AS id FROM detections WHERE detection_method >= 2 GROUP BY 1, 2)
    SELECT * FROM old UNION ALL SELECT * FROM new AS n WHERE NOT EXISTS (SELECT 1 FROM old AS o WHERE o.file = n.file AND o.pattern_id = n.pattern_id)""",
)
def insert_or_ignore(spark, d):
    part = lambda c: relation(spark, d, "detections").where(c).groupBy("file", "pattern_id").agg(F.min("id").alias("id"))
    return R.first_wins(part("detection_method < 2"), part("detection_method >= 2"), ["file", "pattern_id"])


@query(
    "call_edges functions",
    """WITH gone AS (SELECT id FROM functions WHERE module = 7) SELECT caller, callee, resolution FROM call_edges WHERE caller NOT IN (SELECT id FROM gone) AND callee NOT IN (SELECT id FROM gone)""",
)
def cascade_delete(spark, d):
    gone = relation(spark, d, "functions").where("module = 7")
    return R.cascade_delete(relation(spark, d, "call_edges"), gone, ["caller", "callee"], "id").select("caller", "callee", "resolution")


@query("call_edges functions", "SELECT f.module, count(*) AS n FROM functions AS f WHERE f.id IN (SELECT caller FROM call_edges WHERE resolution NOT IN ('fuzzy', 'unresolved')) GROUP BY 1")
def resolved_callers(spark, d):
    e = relation(spark, d, "call_edges").where(~F.col("resolution").isin("fuzzy", "unresolved"))
    return relation(spark, d, "functions").join(e, F.col("id") == F.col("caller"), "left_semi").groupBy("module").agg(F.count("*").alias("n"))


@query("memories", "SELECT memory_id, memory_type, round(confidence, 6) AS confidence FROM memories WHERE valid_until IS NULL AND NOT archived AND confidence < 0.05")
def missing_env_analogue(spark, d):
    m = relation(spark, d, "memories").where(F.col("valid_until").isNull() & ~F.col("archived") & (F.col("confidence") < 0.05))
    return m.select("memory_id", "memory_type", r6(F.col("confidence")).alias("confidence"))


@query("detections", "SELECT pattern_id, round(count(DISTINCT file) * 1.0 / nullif((SELECT count(DISTINCT file) FROM detections), 0), 6) AS rate FROM detections GROUP BY 1")
def occurrence_rate(spark, d):
    x = relation(spark, d, "detections")
    all_files = F.broadcast(x.agg(F.countDistinct("file").alias("all")))  # one row
    return x.groupBy("pattern_id").agg(F.countDistinct("file").alias("n")).join(all_files).select("pattern_id", r6(F.try_divide(F.col("n"), F.col("all"))).alias("rate"))


@query("feedback", "SELECT detector, round(sum(CASE WHEN action = 'dismiss' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS fp_rate, count(*) AS n FROM feedback GROUP BY 1")
def false_positive_rate(spark, d):
    return relation(spark, d, "feedback").groupBy("detector").agg(r6(F.avg(F.when(F.col("action") == "dismiss", 1.0).otherwise(0.0))).alias("fp_rate"), F.count("*").alias("n"))


@query("call_edges", "SELECT caller AS node FROM call_edges UNION SELECT callee FROM call_edges")
def union_distinct_nodes(spark, d):
    e = relation(spark, d, "call_edges")
    return e.select(F.explode(F.array("caller", "callee")).alias("node")).distinct()


@query(
    "memories",
    """WITH a AS (SELECT max(transaction_time) AS now FROM memories) SELECT memory_id, memory_type, importance FROM memories, a
    WHERE memory_type IN ('1-URGENT', '2-HIGH') AND confidence >= 0.3 AND importance IN ('high', 'critical') AND transaction_time >= now - INTERVAL 365 DAY AND NOT archived""",
)
def projection_filter(spark, d):
    m = relation(spark, d, "memories")
    now = m.agg(F.max("transaction_time")).first()[0]  # one value: the explicit anchor
    p = R.Projection(types=("1-URGENT", "2-HIGH"), min_confidence=0.3, min_importance="high", max_age_days=365, archived=False)
    return m.where(p.condition(m.columns, now)).select("memory_id", "memory_type", "importance")


@query("detections", "SELECT file, array_to_string(list_sort(list(DISTINCT pattern_id)), ',') AS patterns, count(*) AS n FROM detections GROUP BY 1")
def file_index_collect(spark, d):
    return relation(spark, d, "detections").groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("pattern_id")), ",").alias("patterns"), F.count("*").alias("n"))


_OLD = "SELECT doc_id, n_chars AS stamp, md5(text) AS digest FROM documents WHERE source <> 'src1'"
_NEW = "SELECT doc_id, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS stamp, CASE WHEN lang = 'fr' AND source = 'src3' THEN md5('x' || text) ELSE md5(text) END AS digest FROM documents WHERE source <> 'src2'"


@query(
    "",
    f"""WITH old AS ({_OLD}), new AS ({_NEW}) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
    WHEN o.stamp = n.stamp THEN 'unchanged' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'modified' END AS status FROM old AS o FULL OUTER JOIN new AS n ON o.doc_id = n.doc_id""",
)
def scan_diff(spark, d):
    # The digest is taken before the join, so texts aren't shuffled.
    docs = table(spark, d, "documents")
    old = docs.where("source <> 'src1'").select("doc_id", F.col("n_chars").alias("stamp"), F.md5("text").alias("digest"))
    moved = F.col("lang") == "fr"
    new = docs.where("source <> 'src2'").select(
        "doc_id", F.when(moved, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("stamp"), F.when(moved & (F.col("source") == "src3"), F.md5(F.concat(F.lit("x"), "text"))).otherwise(F.md5("text")).alias("digest")
    )
    return R.scan_diff(old, new, "doc_id", "stamp", "digest")


@query("detections", "SELECT max(id) AS cursor, count(*) AS n FROM detections WHERE id > 500")
def cloud_cursor(spark, d):
    return relation(spark, d, "detections").where("id > 500").agg(F.max("id").alias("cursor"), F.count("*").alias("n"))


@query("violations", "SELECT severity, count(*) AS n, round(avg(cost), 4) AS avg_cost, GROUPING(severity) AS all_severities FROM violations GROUP BY GROUPING SETS ((severity), ())")
def severity_rollup(spark, d):
    """An extension: the reference has no grouping sets."""
    g = relation(spark, d, "violations").rollup("severity").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("avg_cost"), F.grouping("severity").cast("bigint").alias("all_severities"))
    return g.select("severity", "n", "avg_cost", "all_severities")


@query(
    "detections",
    """WITH g AS (SELECT pattern_id, CASE confidence >= 0.5 WHEN true THEN 'hi' ELSE 'lo' END AS band, count(*) AS n FROM detections GROUP BY 1, 2)
    SELECT pattern_id, band, n, round(n * 1.0 / sum(n) OVER (PARTITION BY pattern_id), 6) AS share FROM g""",
)
def share_by_band(spark, d):
    g = relation(spark, d, "detections").groupBy("pattern_id", F.when(F.col("confidence") >= 0.5, "hi").otherwise("lo").alias("band")).agg(F.count("*").alias("n"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("pattern_id"))))
