"""Structural analysers, reports and causal edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import gates as K
from orrery.operators import reports as P
from orrery.operators import structural as T
from orrery.sources.facts import relation, table

from .registry import query

r6 = lambda c: F.round(c, 6)

# A few rules of the kind that user pattern files hold.
RULES = [
    ("env_reference", "config", r"\b[A-Z][A-Z0-9]+_[A-Z0-9_]+\b", 0.7),
    ("magic_number", "constants", r"\b[0-9]{4,}\b", 0.5),
    ("url_literal", "network", r"https?://[A-Za-z0-9./_-]+", 0.6),
    ("hex_secret", "security", r"\b[0-9A-F]{32,}\b", 0.9),
]


@query("", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS pattern_id, '{c}' AS category, coalesce(sum(len(regexp_extract_all(text, '{x}'))), 0)::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(text, '{x}')) AS docs FROM documents" for i, c, x, _ in RULES) + ") WHERE n > 0")
def rule_matches(spark, d):
    m = T.match_rules(table(spark, d, "documents"), "doc_id", "text", RULES)
    return m.groupBy("pattern_id", "category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


_NAMES = "x AS (SELECT p_name AS name FROM part UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT upper(p_type) FROM part UNION SELECT p_type FROM part)"


@query("", f"WITH {_NAMES} SELECT lower(replace(replace(name, '_', ''), '-', '')) AS normal, array_to_string(list_sort(list(DISTINCT name)), '|') AS spellings FROM x GROUP BY 1 HAVING count(DISTINCT name) > 1")
def name_inconsistency(spark, d):
    p = table(spark, d, "part")
    x = p.select(F.explode(F.array("p_name", F.translate("p_name", " ", "_"), F.upper("p_type"), "p_type")).alias("name"))
    return T.inconsistent_names(x, "name").select("normal", F.array_join("spellings", "|").alias("spellings"))


@query("", "WITH g AS (SELECT o_custkey AS gene, o_orderpriority AS allele, count(*) AS n FROM orders GROUP BY 1, 2) SELECT gene, arg_min(allele, (-n, allele)) AS dominant, round(max(n) * 1.0 / sum(n), 6) AS share, count(*) AS alleles FROM g GROUP BY 1")
def dominant_alleles(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderpriority").alias("allele"))
    return T.dominant_alleles(o, "gene", "allele").select("gene", "dominant", r6(F.col("share")).alias("share"), "alleles")


@query(
    "",
    """WITH g AS (SELECT o_custkey AS gene, o_orderstatus AS allele, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT gene, arg_min(allele, (-n, allele)) AS dominant, max(n) * 1.0 / sum(n) AS share FROM g GROUP BY 1)
    SELECT o_orderkey AS id, gene, o_orderstatus AS allele, dominant FROM orders JOIN b ON gene = o_custkey WHERE share >= 0.6 AND o_orderstatus <> dominant""",
)
def allele_mutations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gene"), F.col("o_orderstatus").alias("allele"))
    return T.mutations(o, "id", "gene", "allele")


@query(
    "",
    """WITH a AS (SELECT l_partkey AS endpoint, min(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), b AS (SELECT l_partkey AS endpoint, min(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT endpoint, CASE WHEN b.v IS NULL THEN 'removed' WHEN a.v IS NULL THEN 'added' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS change, b.v IS NULL OR (a.v IS NOT NULL AND a.v <> b.v) AS breaking FROM a FULL OUTER JOIN b USING (endpoint)""",
)
def breaking_changes(spark, d):
    side = lambda c: table(spark, d, "lineitem").where(c).groupBy(F.col("l_partkey").alias("endpoint")).agg(F.min("l_quantity").alias("v"))
    return T.breaking_changes(side("l_returnflag <> 'A'"), side("l_returnflag <> 'R'"), ["endpoint"], "v")


@query("detections", "SELECT file, round(greatest(0.0, 100 - sum(CASE WHEN detection_method >= 4 THEN 10.0 WHEN detection_method = 3 THEN 5.0 WHEN detection_method = 2 THEN 2.0 ELSE 0.5 END * confidence)), 5) AS posture, count(*) AS n FROM detections GROUP BY 1")
def posture_score(spark, d):
    x = relation(spark, d, "detections").withColumn("severity", F.col("detection_method"))
    return T.posture(x, "file").select("file", F.round("posture", 5).alias("posture"), "n")


@query(
    "memories",
    """WITH b AS (SELECT entity, memory_id, memory_type, epoch(transaction_time) / 3600 AS h FROM memories), j AS (SELECT a.memory_id AS source, c.memory_id AS target, 0.6 * exp(-(c.h - a.h) / 8.0) + CASE WHEN a.memory_type = c.memory_type THEN 0.4 ELSE 0 END AS s
    FROM b AS a JOIN b AS c ON a.entity = c.entity AND a.memory_id <> c.memory_id AND c.h >= a.h AND c.h - a.h < 240) SELECT source, target, round(s, 6) AS strength FROM j WHERE s >= 0.3""",
)
def causal_edges(spark, d):
    return T.causal_edges(relation(spark, d, "memories"), 0.3, 240.0).select("source", "target", r6(F.col("strength")).alias("strength"))


@query("violations", "SELECT level, count(*) AS n FROM (SELECT CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level FROM violations WHERE NOT suppressed) GROUP BY 1")
def sarif_report(spark, d):
    v = P.sarif_results(relation(spark, d, "violations").where("not suppressed"))
    return v.groupBy(F.get_json_object("value", "$.level").alias("level")).agg(F.count("*").alias("n"))


@query("violations", "SELECT md5(rule_id || ':' || file || ':' || line) AS fingerprint, count(*) AS n FROM violations GROUP BY 1")
def gitlab_report(spark, d):
    v = P.gitlab_issues(relation(spark, d, "violations"))
    return v.groupBy(F.get_json_object("value", "$.fingerprint").alias("fingerprint")).agg(F.count("*").alias("n"))


@query()
def junit_report(spark, d):
    """XML text; the gate rows behind it are checked by ``gate_results``."""
    return P.junit_cases(K.gate_rows(relation(spark, d, "violations"), "project"))
