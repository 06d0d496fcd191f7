"""Pattern intelligence: grouping, confidence, outliers, similarity, learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import outliers as O
from orrery.operators import similarity as M
from orrery.sources.facts import relation, table

from .registry import query

r6 = lambda c: F.round(c, 6)


def _locations(spark, d):
    """Detections with one row per location: the best confidence of repeats."""
    return relation(spark, d, "detections").groupBy("pattern_id", "category", "file", "line").agg(F.max("confidence").alias("confidence"))


_LOC = "loc AS (SELECT pattern_id, category, file, line, max(confidence) AS confidence FROM detections GROUP BY 1, 2, 3, 4)"


@query("detections", f"WITH {_LOC} SELECT pattern_id, category, count(*) AS location_count, count(DISTINCT file) AS file_spread, round(avg(confidence), 6) AS mean, round(coalesce(stddev_samp(confidence), 0), 6) AS stddev FROM loc GROUP BY 1, 2")
def pattern_group(spark, d):
    g = _locations(spark, d).groupBy("pattern_id", "category")
    return g.agg(F.count("*").alias("location_count"), F.countDistinct("file").alias("file_spread"), r6(F.avg("confidence")).alias("mean"), r6(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0))).alias("stddev"))


@query("detections", f"WITH {_LOC} SELECT category, count(*) AS locations, count(DISTINCT pattern_id) AS patterns, round(count(*) * 1.0 / (SELECT count(*) FROM detections), 6) AS kept_ratio FROM loc GROUP BY 1")
def pattern_stats(spark, d):
    total = F.broadcast(relation(spark, d, "detections").agg(F.count("*").alias("all")))  # one row
    g = _locations(spark, d).groupBy("category").agg(F.count("*").alias("locations"), F.countDistinct("pattern_id").alias("patterns"))
    return g.join(total).select("category", "locations", "patterns", r6(F.col("locations") / F.col("all")).alias("kept_ratio"))


@query("detections", "WITH p AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.5) AS k FROM detections GROUP BY 1) SELECT file, k, n, round((1.0 + k) / (2.0 + n), 6) AS mean, round((1.0 + k) * (1.0 + n - k) / ((2.0 + n) * (2.0 + n) * (3.0 + n)), 9) AS variance FROM p")
def beta_posterior(spark, d):
    p = relation(spark, d, "detections").groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("k"))
    a, b = S.beta_alpha(F.col("k")), S.beta_beta(F.col("k"), F.col("n"))
    return p.select("file", "k", "n", r6(S.beta_mean(a, b)).alias("mean"), F.round(S.beta_variance(a, b), 9).alias("variance"))


@query()
def credible_interval(spark, d):
    """95 % interval of each file's Beta posterior; SQL has no inverse incomplete beta."""
    p = relation(spark, d, "detections").groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("k"))
    return M.credible_intervals(p, "k", "n").select("file", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


_FACTORS = """a AS (SELECT max(created_at) AS now FROM detections), p AS (SELECT pattern_id, detection_method, count(*) AS n, count(DISTINCT file) AS spread, avg(confidence) AS quality, coalesce(stddev_samp(confidence), 0) AS sd,
    date_diff('day', CAST(min(created_at) AS DATE), CAST(max(now) AS DATE)) AS age FROM detections, a GROUP BY 1, 2), t AS (SELECT count(*) AS all_n, count(DISTINCT file) AS all_files FROM detections),
    s AS (SELECT pattern_id, detection_method, n, round(0.25 * n / all_n + 0.20 * greatest(0.0, 1 - sd) + 0.10 * CASE WHEN age <= 0 THEN 0.1 WHEN age >= 30 THEN 1.0 ELSE 0.1 + 0.9 * age / 30.0 END + 0.15 * spread / all_files + 0.15 * 0.5 + 0.15 * quality, 6) AS score FROM p, t)"""


def _factors(spark, d):
    x = relation(spark, d, "detections")
    t = F.broadcast(x.agg(F.count("*").alias("all_n"), F.countDistinct("file").alias("all_files"), F.max("created_at").alias("now")))  # one row
    p = x.groupBy("pattern_id", "detection_method").agg(F.count("*").alias("n"), F.countDistinct("file").alias("spread"), F.avg("confidence").alias("quality"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("sd"), F.min("created_at").alias("first"))
    age = F.date_diff(F.to_date("now"), F.to_date("first"))
    score = S.factor_score(F.col("n") / F.col("all_n"), F.greatest(F.lit(0.0), 1 - F.col("sd")), S.age_factor(age), F.col("spread") / F.col("all_files"), F.lit(0.5), F.col("quality"))
    return p.join(t).select("pattern_id", "detection_method", "n", r6(score).alias("score"))


@query("detections", f"WITH {_FACTORS} SELECT pattern_id, detection_method, score, round(0.5 * (1 - n / (n + 10.0)) + score * n / (n + 10.0), 5) AS blended FROM s")
def confidence_factors(spark, d):
    s = _factors(spark, d)
    return s.select("pattern_id", "detection_method", "score", F.round(S.evidence_blend(F.lit(0.5), F.col("score"), F.col("n")), 5).alias("blended"))


@query("detections", "SELECT CASE WHEN confidence >= 0.85 THEN 'established' WHEN confidence >= 0.70 THEN 'emerging' WHEN confidence >= 0.50 THEN 'tentative' ELSE 'uncertain' END AS tier, count(*) AS n FROM detections GROUP BY 1")
def confidence_tier(spark, d):
    return relation(spark, d, "detections").groupBy(S.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


_DAYS = "days AS (SELECT pattern_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM detections GROUP BY 1, 2)"


@query(
    "detections",
    f"""WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY day DESC) AS k FROM days), s AS (SELECT pattern_id, regr_slope(n, -k) AS slope, avg(n) AS mean FROM r WHERE k <= 10 GROUP BY 1)
    SELECT pattern_id, round(slope / mean, 6) AS momentum, CASE WHEN slope / mean > 0.1 THEN 'rising' WHEN slope / mean < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM s""",
)
def momentum(spark, d):
    # The last ten days by date arithmetic on a small daily table.
    days = relation(spark, d, "detections").groupBy("pattern_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("day")))
    s = days.withColumn("k", k).where("k <= 10").groupBy("pattern_id").agg(F.regr_slope(F.col("n"), -F.col("k")).alias("slope"), F.avg("n").alias("mean"))
    m = F.col("slope") / F.col("mean")
    return s.select("pattern_id", r6(m).alias("momentum"), F.when(m > 0.1, "rising").when(m < -0.1, "falling").otherwise("stable").alias("trend"))


@query(
    "detections",
    """WITH a AS (SELECT max(created_at) AS now FROM detections), f AS (SELECT file, date_diff('day', CAST(max(created_at) AS DATE), CAST(max(now) AS DATE)) AS age FROM detections, a GROUP BY 1)
    SELECT file, age, round(CASE WHEN age <= 7 THEN 1.0 WHEN age >= 90 THEN 0.1 ELSE 1.0 - 0.9 * (age - 7) / 83.0 END, 6) AS weight FROM f""",
)
def temporal_decay(spark, d):
    x = relation(spark, d, "detections")
    now = F.broadcast(x.agg(F.max("created_at").alias("now")))  # one row
    f = x.groupBy("file").agg(F.max("created_at").alias("last")).join(now).select("file", F.date_diff(F.to_date("now"), F.to_date("last")).cast("bigint").alias("age"))
    return f.withColumn("weight", r6(S.staleness_decay(F.col("age"))))


def _z_sql(rounds: int) -> str:
    out, last = [], "v0"
    for k in range(rounds):
        nxt = f"v{k + 1}"
        out.append(f"m{k} AS (SELECT file, avg(confidence) AS m, coalesce(stddev_samp(confidence), 0) AS s FROM {last} WHERE NOT o GROUP BY 1), {nxt} AS (SELECT v.id, v.file, v.confidence, v.o OR coalesce(m.s > 0 AND abs(v.confidence - m.m) / CASE WHEN m.s > 0 THEN m.s END > 2.5, false) AS o FROM {last} AS v LEFT JOIN m{k} AS m USING (file))")
        last = nxt
    return "WITH v0 AS (SELECT id, file, confidence, false AS o FROM detections), " + ", ".join(out) + f" SELECT id, file, round(confidence, 6) AS confidence FROM {last} WHERE o"


@query("detections", _z_sql(3))
def outlier_zscore(spark, d):
    out = O.zscore(relation(spark, d, "detections").select("id", "file", "confidence"), "file", "confidence")
    return out.where("is_outlier").select("id", "file", r6(F.col("confidence")).alias("confidence"))


@query(
    "detections",
    """WITH q AS (SELECT pattern_id, quantile_cont(confidence, 0.25) AS lo, quantile_cont(confidence, 0.75) AS hi, quantile_cont(confidence, 0.5) AS med FROM detections GROUP BY 1)
    SELECT id, pattern_id, round(confidence, 6) AS confidence FROM detections JOIN q USING (pattern_id) WHERE CASE WHEN hi = lo THEN confidence <> med ELSE confidence < lo - 1.5 * (hi - lo) OR confidence > hi + 1.5 * (hi - lo) END""",
)
def outlier_iqr(spark, d):
    out = O.iqr(relation(spark, d, "detections").select("id", "pattern_id", "confidence"), "pattern_id", "confidence")
    return out.where("is_outlier").select("id", "pattern_id", r6(F.col("confidence")).alias("confidence"))


@query(
    "detections",
    """WITH m AS (SELECT file, median(confidence) AS med FROM detections GROUP BY 1), a AS (SELECT d.id, d.file, d.confidence, m.med, abs(d.confidence - m.med) AS dev FROM detections AS d JOIN m USING (file)), s AS (SELECT file, median(dev) AS mad FROM a GROUP BY 1)
    SELECT id, file, round(confidence, 6) AS confidence FROM a JOIN s USING (file) WHERE CASE WHEN mad = 0 THEN confidence <> med ELSE 0.6745 * dev / mad > 3.5 END""",
)
def outlier_mad(spark, d):
    out = O.mad(relation(spark, d, "detections").select("id", "file", "confidence"), "file", "confidence")
    return out.where("is_outlier").select("id", "file", r6(F.col("confidence")).alias("confidence"))


@query()
def outlier_grubbs(spark, d):
    """Needs t quantiles, which SQL lacks."""
    out = O.grubbs(relation(spark, d, "detections").select("id", "file", "confidence"), "file", "id", "confidence")
    return out.select("file", "id", "n", r6(F.col("g")).alias("g"), r6(F.col("critical")).alias("critical"), "is_outlier")


@query()
def outlier_esd(spark, d):
    """Needs t quantiles, which SQL lacks."""
    out = O.esd(relation(spark, d, "detections").select("id", "pattern_id", "confidence"), "pattern_id", "id", "confidence")
    return out.select("pattern_id", "id", r6(F.col("v")).alias("confidence"))


@query(
    "detections",
    """WITH m AS (SELECT file, count(confidence) AS n, avg(confidence) AS mu, var_pop(confidence) AS v FROM detections GROUP BY 1),
    k AS (SELECT d.file, max(m.n) AS n, avg(power(d.confidence - m.mu, 3)) / CASE WHEN max(m.v) > 0 THEN power(max(m.v), 1.5) END AS skew, avg(power(d.confidence - m.mu, 4)) / CASE WHEN max(m.v) > 0 THEN power(max(m.v), 2) END - 3 AS kurt FROM detections AS d JOIN m USING (file) GROUP BY 1)
    SELECT file, n, CASE WHEN n >= 30 THEN CASE WHEN abs(skew) <= 2 AND abs(kurt) <= 7 THEN 'zscore' ELSE 'iqr' END WHEN n >= 25 THEN CASE WHEN abs(skew) <= 2 AND abs(kurt) <= 7 THEN 'esd' ELSE 'mad' END
    WHEN n >= 10 THEN CASE WHEN abs(skew) <= 2 AND abs(kurt) <= 7 THEN 'grubbs' ELSE 'mad' END ELSE 'rules' END AS method FROM k""",
)
def outlier_method_select(spark, d):
    return O.method_for(relation(spark, d, "detections"), "file", "confidence").select("file", "n", "method")


@query()
def outlier_ensemble(spark, d):
    """Union of three tests per file, boosted where they agree."""
    x = relation(spark, d, "detections").select("id", "file", "confidence")
    flags = {"zscore": O.zscore(x, "file", "confidence"), "iqr": O.iqr(x, "file", "confidence"), "mad": O.mad(x, "file", "confidence")}
    return O.ensemble(flags, ["id", "file"], "confidence").select("id", "file", "methods", r6(F.col("score")).alias("score"))


_SETS = "sets AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS t FROM lineitem), n AS (SELECT a, count(*) AS n FROM sets GROUP BY 1)"


@query(
    "",
    f"""WITH {_SETS}, i AS (SELECT x.a AS a, y.a AS b, count(*) AS k FROM sets AS x JOIN sets AS y ON x.t = y.t AND x.a < y.a GROUP BY 1, 2)
    SELECT i.a, i.b, round(k * 1.0 / (p.n + q.n - k), 6) AS jaccard FROM i JOIN n AS p ON p.a = i.a JOIN n AS q ON q.a = i.b WHERE k * 10 >= 3 * (p.n + q.n - k)""",
)
def jaccard_pairs(spark, d):
    sets = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("t"))
    return M.jaccard_pairs(sets, "a", "t", 0.3).select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


@query()
def minhash_pairs(spark, d):
    """128 hashes in 64 bands of 2, as the threshold needs; hash values are this engine's own, so no SQL."""
    sets = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("t"))
    return M.minhash_pairs(sets, "a", "t", 0.3).select("a", "b", r6(F.col("estimate")).alias("estimate"))


@query(
    "",
    f"""WITH {_SETS}, i AS (SELECT x.a AS a, y.a AS b, count(*) AS k FROM sets AS x JOIN sets AS y ON x.t = y.t AND x.a < y.a GROUP BY 1, 2), j AS (SELECT k * 1.0 / (p.n + q.n - k) AS s FROM i JOIN n AS p ON p.a = i.a JOIN n AS q ON q.a = i.b)
    SELECT CASE WHEN s >= 0.95 THEN 'auto_merge' WHEN s >= 0.85 THEN 'flag_for_review' ELSE 'separate' END AS decision, count(*) AS n FROM j WHERE s >= 0.05 GROUP BY 1""",
)
def merge_decision(spark, d):
    sets = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("t"))
    return M.jaccard_pairs(sets, "a", "t", 0.05).groupBy(S.merge_decision(F.col("jaccard")).alias("decision")).agg(F.count("*").alias("n"))


_CONV = """c AS (SELECT category, pattern_id, count(*) AS n, count(DISTINCT file) AS files, max(created_at) AS last FROM detections GROUP BY 1, 2), t AS (SELECT detection_method, pattern_id, count(*) AS n, count(DISTINCT file) AS files FROM detections GROUP BY 1, 2)"""


@query(
    "detections",
    f"""WITH {_CONV}, s AS (SELECT detection_method, pattern_id, n, files, n * 1.0 / sum(n) OVER (PARTITION BY detection_method) AS share FROM t)
    SELECT detection_method, pattern_id, n, round(share, 6) AS share, CASE WHEN n < 3 OR files < 2 THEN 'rejected' WHEN share >= 0.8 THEN 'universal' WHEN share >= 0.6 THEN 'dominant' ELSE 'contested' END AS status FROM s""",
)
def convention_dominance(spark, d):
    t = relation(spark, d, "detections").groupBy("detection_method", "pattern_id").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("detection_method"))
    status = F.when((F.col("n") < 3) | (F.col("files") < 2), "rejected").when(share >= 0.8, "universal").when(share >= 0.6, "dominant").otherwise("contested")
    return t.select("detection_method", "pattern_id", "n", r6(share).alias("share"), status.alias("status"))


@query("detections", f"WITH {_CONV} SELECT detection_method, pattern_id, round((1.0 + n) / (count(*) OVER (PARTITION BY detection_method) + sum(n) OVER (PARTITION BY detection_method)), 6) AS posterior FROM t")
def dirichlet_posterior(spark, d):
    t = relation(spark, d, "detections").groupBy("detection_method", "pattern_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("detection_method")
    return t.select("detection_method", "pattern_id", r6((1.0 + F.col("n")) / (F.count("*").over(w) + F.sum("n").over(w))).alias("posterior"))


@query(
    "detections",
    f"""WITH {_CONV}, p AS (SELECT detection_method, pattern_id, (1.0 + n) / (count(*) OVER (PARTITION BY detection_method) + sum(n) OVER (PARTITION BY detection_method)) AS m FROM t),
    q AS (SELECT *, lead(m) OVER (PARTITION BY detection_method ORDER BY m DESC, pattern_id) AS nxt, row_number() OVER (PARTITION BY detection_method ORDER BY m DESC, pattern_id) AS k FROM p)
    SELECT detection_method, pattern_id, round(m - coalesce(nxt, 0), 6) AS gap, m - coalesce(nxt, 0) <= 0.15 AS contested FROM q WHERE k = 1""",
)
def contested(spark, d):
    t = relation(spark, d, "detections").groupBy("detection_method", "pattern_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("detection_method")
    p = t.withColumn("m", (1.0 + F.col("n")) / (F.count("*").over(w) + F.sum("n").over(w)))
    o = w.orderBy(F.desc("m"), "pattern_id")
    q = p.withColumn("gap", F.col("m") - F.coalesce(F.lead("m").over(o), F.lit(0.0))).withColumn("k", F.row_number().over(o)).where("k = 1")
    return q.select("detection_method", "pattern_id", r6(F.col("gap")).alias("gap"), (F.col("gap") <= 0.15).alias("contested"))


@query("detections", "SELECT pattern_id, line % 40 AS variant, count(*) AS n, count(DISTINCT file) AS spread, round((1.0 + count(*) FILTER (WHERE confidence >= 0.01)) / (2.0 + count(*)), 6) AS mean FROM detections GROUP BY 1, 2 HAVING (1.0 + count(*) FILTER (WHERE confidence >= 0.01)) / (2.0 + count(*)) >= 0.85 AND count(DISTINCT file) >= 5")
def promotion(spark, d):
    """Discovered conventions that are established (posterior mean of .85) in five files or more."""
    g = relation(spark, d, "detections").groupBy("pattern_id", (F.col("line") % 40).alias("variant"))
    g = g.agg(F.count("*").alias("n"), F.countDistinct("file").alias("spread"), ((1.0 + F.count_if(F.col("confidence") >= 0.01)) / (2.0 + F.count("*"))).alias("mean"))
    return g.where(S.promotable(F.col("mean"), F.col("spread"))).withColumn("mean", r6(F.col("mean")))


@query("memories", "WITH a AS (SELECT max(transaction_time) AS now FROM memories) SELECT entity, max(transaction_time) AS last FROM memories, a GROUP BY 1 HAVING max(transaction_time) < max(now) - INTERVAL 90 DAY")
def expiry(spark, d):
    m = relation(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("transaction_time").alias("now")))  # one row
    return m.groupBy("entity").agg(F.max("transaction_time").alias("last")).join(now).where(F.col("last") < F.col("now") - F.make_dt_interval(F.lit(90))).select("entity", "last")


@query("detections", f"WITH {_LOC}, g AS (SELECT pattern_id, file, count(*) AS n FROM loc GROUP BY 1, 2), h AS (SELECT *, max(n) OVER (PARTITION BY pattern_id) AS top FROM g) SELECT pattern_id, count(*) AS parents, sum(n) AS locations FROM h WHERE n = top GROUP BY 1")
def gold_layer(spark, d):
    """Children merged into the file with most locations are dropped; ties stay."""
    g = _locations(spark, d).groupBy("pattern_id", "file").agg(F.count("*").alias("n"))
    top = g.groupBy("pattern_id").agg(F.max("n").alias("top"))
    return g.join(top, "pattern_id").where("n = top").groupBy("pattern_id").agg(F.count("*").alias("parents"), F.sum("n").alias("locations"))
