"""Health, gates, policies, feedback, trends and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import gates as K
from orrery.sources.facts import relation

from .registry import query

r6 = lambda c: F.round(c, 6)

_HEALTH = """avg(confidence) AS c, avg(CASE WHEN confidence >= 0.5 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN category <> 'errors' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN detection_method < 4 THEN 1.0 ELSE 0.0 END) AS x, count(DISTINCT (file, line, pattern_id)) * 1.0 / count(*) AS u"""


def _health(df, *by):
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = df.groupBy(*by).agg(
        F.avg("confidence").alias("c"), flag(F.col("confidence") >= 0.5).alias("a"), flag(F.col("category") != "errors").alias("p"), flag(F.col("detection_method") < 4).alias("x"),
        (F.countDistinct("file", "line", "pattern_id") / F.count("*")).alias("u"),
    )
    return g.select(*by, F.round(100 * K.health(F.col("c"), F.col("a"), F.col("p"), F.col("x"), F.col("u")), 4).alias("health"))


@query("detections", f"WITH h AS (SELECT {_HEALTH} FROM detections) SELECT round(100 * (0.30 * c + 0.20 * a + 0.20 * p + 0.15 * x + 0.15 * u), 4) AS health FROM h")
def health_score(spark, d):
    return _health(relation(spark, d, "detections"))


@query("detections", f"WITH h AS (SELECT category, {_HEALTH} FROM detections GROUP BY 1) SELECT category, round(100 * (0.30 * c + 0.20 * a + 0.20 * p + 0.15 * x + 0.15 * u), 4) AS health FROM h")
def health_by_category(spark, d):
    return _health(relation(spark, d, "detections"), "category")


_DAILY = "daily AS (SELECT pattern_id AS metric, CAST(created_at AS DATE) AS day, avg(confidence) * 100 AS value FROM detections GROUP BY 1, 2)"


def _daily(spark, d):
    return relation(spark, d, "detections").groupBy(F.col("pattern_id").alias("metric"), F.to_date("created_at").alias("day")).agg((F.avg("confidence") * 100).alias("value"))


@query(
    "detections",
    f"""WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS k FROM daily), m AS (SELECT metric, avg(value) FILTER (WHERE k <= 7) - avg(value) FILTER (WHERE k BETWEEN 8 AND 14) AS delta FROM r GROUP BY 1)
    SELECT metric, round(delta, 4) AS delta, CASE WHEN delta > 2 THEN 'improving' WHEN delta < -2 THEN 'declining' ELSE 'stable' END AS trend FROM m""",
)
def trend_class(spark, d):
    return K.trend(_daily(spark, d), "metric", "day", "value").select("metric", F.round("delta", 4).alias("delta"), "trend")


@query(
    "detections",
    f"""WITH {_DAILY}, t AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS x FROM daily)
    SELECT metric, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x) + regr_slope(value, x) * (max(x) + 30), 3) AS in_30, round(regr_r2(value, x), 5) AS r2 FROM t GROUP BY 1""",
)
def trend_forecast(spark, d):
    x = F.row_number().over(Window.partitionBy("metric").orderBy("day")) - 1
    g = _daily(spark, d).withColumn("x", x).groupBy("metric").agg(F.regr_slope("value", "x").alias("s"), F.regr_intercept("value", "x").alias("i"), F.regr_r2("value", "x").alias("r2"), F.max("x").alias("last"))
    return g.select("metric", F.round("s", 4).alias("slope"), F.round(F.col("i") + F.col("s") * (F.col("last") + 30), 3).alias("in_30"), F.round("r2", 5).alias("r2"))


@query("detections", f"WITH {_DAILY} SELECT metric, round(abs(max_by(value, day) - avg(value)) / stddev_pop(value), 4) AS z, abs(max_by(value, day) - avg(value)) / stddev_pop(value) > 2 AS anomaly FROM daily GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(value) > 0")
def anomaly_last(spark, d):
    g = _daily(spark, d).groupBy("metric").agg(F.max_by("value", "day").alias("last"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")).where("n >= 3 and s > 0")
    z = F.abs(F.col("last") - F.col("m")) / F.col("s")
    return g.select("metric", F.round(z, 4).alias("z"), (z > 2).alias("anomaly"))


@query(
    "detections",
    f"""WITH {_DAILY}, l AS (SELECT metric, day, value - lag(value) OVER (PARTITION BY metric ORDER BY day) AS delta FROM daily) SELECT metric, day, round(delta, 4) AS delta, CASE WHEN delta <= -15 THEN 'critical' ELSE 'warning' END AS level FROM l WHERE delta <= -5""",
)
def degradation_alerts(spark, d):
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("metric").orderBy("day"))
    l = _daily(spark, d).withColumn("delta", delta).where("delta <= -5")
    return l.select("metric", "day", F.round("delta", 4).alias("delta"), F.when(F.col("delta") <= -15, "critical").otherwise("warning").alias("level"))


_FB = "f AS (SELECT detector, count(*) AS n, count(*) FILTER (WHERE action = 'fix') AS fixes, count(*) FILTER (WHERE action = 'dismiss') AS dismissals, count(*) FILTER (WHERE action = 'dismiss' AND reason = 'false_positive') AS fps FROM feedback GROUP BY 1)"


@query("feedback", f"WITH {_FB} SELECT detector, n, fixes, dismissals, round(fps * 1.0 / nullif(fixes + dismissals, 0), 6) AS fp_rate, round(fixes * 1.0 / n, 6) AS action_rate, n >= 10 AND fps > 0.2 * (fixes + dismissals) AS disable FROM f")
def feedback_metrics(spark, d):
    return K.feedback(relation(spark, d, "feedback"), "detector").select("detector", "n", "fixes", "dismissals", r6(F.col("fp_rate")).alias("fp_rate"), r6(F.col("action_rate")).alias("action_rate"), "disable")


@query(
    "feedback",
    """SELECT detector, round(sum(CASE action WHEN 'fix' THEN 1.0 WHEN 'escalate' THEN 0.5 ELSE 0 END), 4) AS alpha, round(sum(CASE WHEN action = 'dismiss' AND reason = 'false_positive' THEN 0.5 WHEN action = 'dismiss' AND reason IN ('wont_fix', 'duplicate') THEN 0 WHEN action = 'dismiss' THEN 0.25 WHEN action = 'suppress' THEN 0.1 ELSE 0 END), 4) AS beta FROM feedback GROUP BY 1""",
)
def feedback_alpha_beta(spark, d):
    return K.alpha_beta(relation(spark, d, "feedback"), "detector").select("detector", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


@query(
    "feedback",
    """WITH x AS (SELECT author, created_at, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, event_id DESC) AS k FROM feedback WHERE action = 'dismiss')
    SELECT author, epoch_us(max(created_at)) - epoch_us(min(created_at)) <= 21600000000 AS abuse FROM x WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3""",
)
def dismissal_abuse(spark, d):
    """Whether an author's latest three dismissals lie within six hours."""
    k = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("created_at"), F.desc("event_id")))
    x = relation(spark, d, "feedback").where("action = 'dismiss'").select("author", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), k.alias("k")).where("k <= 3")
    return x.groupBy("author").agg((F.max("at") - F.min("at") <= 3600 * 6 * 1_000_000).alias("abuse"), F.count("*").alias("n")).where("n = 3").drop("n")


@query("violations", "SELECT rule_id, CASE WHEN count(*) FILTER (WHERE suppressed) > 0.2 * count(*) AND max(severity = 'error') THEN 'warning' WHEN max(severity = 'error') THEN 'error' WHEN max(severity = 'warning') THEN 'warning' ELSE 'info' END AS severity, count(*) FILTER (WHERE is_new) AS new FROM violations GROUP BY 1")
def rule_severity(spark, d):
    g = relation(spark, d, "violations").groupBy("rule_id").agg(F.bool_or(F.col("severity") == "error").alias("e"), F.bool_or(F.col("severity") == "warning").alias("w"), F.count_if("suppressed").alias("s"), F.count("*").alias("n"), F.count_if("is_new").alias("new"))
    severity = F.when(F.col("e") & (F.col("s") > 0.2 * F.col("n")), "warning").when(F.col("e"), "error").when(F.col("w"), "warning").otherwise("info")
    return g.select("rule_id", severity.alias("severity"), "new")


@query("violations", "SELECT file, line, rule_id, CASE min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM violations GROUP BY 1, 2, 3")
def violation_dedup(spark, d):
    return K.dedup_highest(relation(spark, d, "violations"), ["file", "line", "rule_id"])


@query(
    "violations",
    """WITH a AS (SELECT max(created_at) AS now FROM violations), x AS (SELECT severity, is_new, date_diff('day', CAST(created_at AS DATE), CAST(now AS DATE)) AS age FROM violations, a)
    SELECT CASE WHEN is_new OR age >= 2000 THEN severity WHEN severity = 'error' AND age < 500 THEN 'info' WHEN severity = 'error' AND age < 1000 THEN 'warning' WHEN severity = 'warning' AND age < 1000 THEN 'info' ELSE severity END AS effective, count(*) AS n FROM x GROUP BY 1""",
)
def progressive_severity(spark, d):
    v = relation(spark, d, "violations")
    now = F.broadcast(v.agg(F.max("created_at").alias("now")))  # one row
    age = F.date_diff(F.to_date("now"), F.to_date("created_at"))
    return v.join(now).groupBy(S.progressive_severity(F.col("severity"), age, 2000.0, F.col("is_new")).alias("effective")).agg(F.count("*").alias("n"))


_GATES = """g AS (SELECT project, 'pattern_compliance' AS gate, 100.0 * count(*) FILTER (WHERE severity <> 'error') / count(*) AS score FROM violations GROUP BY 1
    UNION ALL SELECT project, 'security', 100.0 * count(*) FILTER (WHERE NOT (severity = 'error' AND is_new)) / count(*) FROM violations GROUP BY 1
    UNION ALL SELECT project, 'suppression', 100.0 * count(*) FILTER (WHERE NOT suppressed) / count(*) FROM violations GROUP BY 1),
    w AS (SELECT project, gate, score, CASE gate WHEN 'pattern_compliance' THEN 70.0 WHEN 'security' THEN 80.0 ELSE 50.0 END AS threshold, CASE gate WHEN 'pattern_compliance' THEN 0.5 WHEN 'security' THEN 0.3 ELSE 0.2 END AS weight FROM g)"""


def _gates(spark, d):
    return K.gate_rows(relation(spark, d, "violations"), "project")


@query("violations", f"WITH {_GATES} SELECT project, gate, round(score, 4) AS score, score >= threshold AS passed FROM w")
def gate_results(spark, d):
    return _gates(spark, d).select("project", "gate", F.round("score", 4).alias("score"), "passed")


for _name, _sql in {
    "policy_all": "bool_and(score >= threshold)",
    "policy_any": "bool_or(score >= threshold)",
    "policy_weighted": "sum(weight * score) / sum(weight) >= 72.0",
    "policy_threshold": "avg(score) >= 70.0",
}.items():

    def _policy(spark, d, mode=_name.removeprefix("policy_")):
        return K.policy(_gates(spark, d), "project", mode)

    _policy.__name__ = _name
    query("violations", f"WITH {_GATES} SELECT project, {_sql} AS passed FROM w GROUP BY 1")(_policy)


@query(
    "violations",
    """WITH v AS (SELECT file, count(*) FILTER (WHERE severity <> 'warning') AS locations, count(*) FILTER (WHERE severity = 'warning') AS outliers, max(severity = 'error' AND NOT suppressed) AS errors, avg(CASE WHEN is_new THEN 0.6 ELSE 1.0 END) AS confidence FROM violations GROUP BY 1)
    SELECT CASE WHEN confidence >= 0.9 AND outliers <= locations AND locations >= 3 AND NOT errors THEN 'approve' WHEN confidence >= 0.7 THEN 'review' ELSE 'likely_false_positive' END AS verdict, count(*) AS files FROM v GROUP BY 1""",
)
def auto_approve(spark, d):
    """Confidence .90, outliers at most half, three locations and no errors; .70 for a review."""
    warn = F.col("severity") == "warning"
    v = relation(spark, d, "violations").groupBy("file").agg(
        F.count_if(~warn).alias("locations"), F.count_if(warn).alias("outliers"), F.bool_or((F.col("severity") == "error") & ~F.col("suppressed")).alias("errors"),
        F.sum(F.when(F.col("is_new"), 6).otherwise(10)).alias("tenths"),
    )
    n = F.col("locations") + F.col("outliers")
    # Whole tenths: a mean of doubles misses thresholds that it should meet.
    verdict = S.auto_approve(F.col("tenths") / (10 * n), F.col("outliers") / n, F.col("locations"), F.col("errors"))
    return v.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("files"))


@query(
    "",
    """WITH x AS (SELECT order_id, seq, comment, next_line FROM (SELECT l_orderkey AS order_id, l_linenumber AS seq, CASE WHEN l_orderkey % 7 = l_linenumber THEN 'x = 1  # noqa' WHEN l_orderkey % 5 = l_linenumber THEN '// eslint-disable-next-line' ELSE 'x = 1' END AS comment FROM lineitem) AS t,
        LATERAL (SELECT comment LIKE '%next-line%' AS next_line) AS u WHERE regexp_matches(comment, 'noqa|eslint-disable'))
    SELECT count(*) AS directives, count(*) FILTER (WHERE next_line) AS next_line FROM x""",
)
def suppression_scan(spark, d):
    """Suppression directives in source lines, and how many speak of the line after them."""
    from orrery.sources.facts import table

    text = F.when(F.col("l_orderkey") % 7 == F.col("l_linenumber"), "x = 1  # noqa").when(F.col("l_orderkey") % 5 == F.col("l_linenumber"), "// eslint-disable-next-line").otherwise("x = 1")
    found = table(spark, d, "lineitem").select(text.alias("text")).where(F.col("text").rlike("noqa|eslint-disable"))
    return found.agg(F.count("*").alias("directives"), F.count_if(F.col("text").contains("next-line")).alias("next_line"))


@query("violations", "SELECT 'error_' || severity AS rule, string_agg(DISTINCT CAST(project AS VARCHAR), ',' ORDER BY CAST(project AS VARCHAR)) AS projects, count(*) AS results FROM violations WHERE NOT suppressed GROUP BY severity")
def sarif_rules(spark, d):
    g = relation(spark, d, "violations").where("not suppressed").groupBy("severity").agg(F.array_join(F.array_sort(F.collect_set(F.col("project").cast("string"))), ",").alias("projects"), F.count("*").alias("results"))
    return g.select(F.concat(F.lit("error_"), "severity").alias("rule"), "projects", "results")
