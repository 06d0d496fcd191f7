"""Call-graph, coupling and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import graph as G
from orrery.sources.facts import relation, table

from .registry import query

r6 = lambda c: F.round(c, 6)


def _edges(spark, d):
    return G.clean_edges(relation(spark, d, "call_edges"), "caller", "callee")


_E = "e AS (SELECT DISTINCT caller AS src, callee AS dst FROM call_edges WHERE caller <> callee)"
_CLOSE = "r(start, node) AS (SELECT src, dst FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node)"


@query("call_edges functions", f"WITH {_E}, s AS (SELECT id AS start FROM functions WHERE is_entry), r(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 20) SELECT start, node, min(depth) AS depth FROM r WHERE node <> start GROUP BY 1, 2")
def bfs_forward(spark, d):
    starts = relation(spark, d, "functions").where("is_entry").select(F.col("id").alias("start"))
    return G.reach(_edges(spark, d), starts, 20)


@query("call_edges functions", f"WITH {_E}, s AS (SELECT DISTINCT id AS start FROM functions), r(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3) SELECT start, node, min(depth) AS depth FROM r WHERE node <> start GROUP BY 1, 2")
def bfs_inverse(spark, d):
    """Callers of every function, up to three hops away."""
    starts = relation(spark, d, "functions").select(F.col("id").alias("start"))
    return G.reach(_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, 3)


@query("call_edges", f"WITH {_E}, r(start, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.start, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5) SELECT start, count(DISTINCT node) AS reached FROM r WHERE node <> start GROUP BY 1")
def reach_depth5(spark, d):
    e = _edges(spark, d)
    return G.reach(e, e.select(F.col("src").alias("start")), 5).groupBy("start").agg(F.count("*").alias("reached"))


_BLAST = f"{_E}, {_CLOSE}, b AS (SELECT node, count(DISTINCT start) FILTER (WHERE start <> node) AS callers FROM r GROUP BY 1)"


def _blast(spark, d):
    e = _edges(spark, d)
    return G.reach_counts(e, e.select(F.col("src").alias("start")))


@query("call_edges functions", f"WITH {_BLAST} SELECT node, callers, round(callers * 1.0 / ((SELECT count(*) FROM functions) - 1), 8) AS blast FROM b WHERE callers > 0")
def blast_radius(spark, d):
    n = F.broadcast(relation(spark, d, "functions").agg(F.count("*").alias("nodes")))  # one row
    return _blast(spark, d).join(n).select("node", "callers", F.round(G.risk_columns(F.col("callers"), F.col("nodes")), 8).alias("blast"))


@query(
    "call_edges functions",
    f"""WITH {_BLAST}, x AS (SELECT f.id, coalesce(b.callers, 0) * 1.0 / ((SELECT count(*) FROM functions) - 1) AS blast, CASE WHEN f.is_exported THEN 0.3 ELSE 0.0 END AS sens, CASE WHEN f.is_test THEN 1.0 ELSE 0.0 END AS cov,
    CASE WHEN lines <= 10 THEN 0.1 WHEN lines <= 30 THEN 0.3 WHEN lines <= 60 THEN 0.5 WHEN lines <= 100 THEN 0.7 ELSE 1.0 END AS cx FROM functions AS f LEFT JOIN b ON b.node = f.id)
    SELECT id, round(0.30 * blast + 0.25 * sens + 0.20 * (1 - cov) + 0.15 * cx, 6) AS risk FROM x""",
)
def risk_score(spark, d):
    f = relation(spark, d, "functions")
    n = F.broadcast(f.agg(F.count("*").alias("nodes")))  # one row
    x = f.join(_blast(spark, d), F.col("id") == F.col("node"), "left").join(n)
    blast = G.risk_columns(F.coalesce("callers", F.lit(0)), F.col("nodes"))
    risk = S.risk_score(blast, F.when(F.col("is_exported"), 0.3).otherwise(0.0), F.when(F.col("is_test"), 1.0).otherwise(0.0), S.complexity_from_lines(F.col("lines")), F.lit(0.0))
    return x.select("id", r6(risk).alias("risk"))


@query(
    "call_edges functions",
    """WITH f AS (SELECT *, lower(name) AS n FROM functions WHERE id NOT IN (SELECT callee FROM call_edges WHERE caller <> callee)), x AS (SELECT id, name, path, CASE
        WHEN is_entry OR is_exported OR name IN ('main', 'index', 'default', 'run', 'start', 'init') THEN 'entry_point' WHEN n LIKE 'on%' OR n LIKE 'handle%' OR n LIKE '%callback%' THEN 'event_handler'
        WHEN n LIKE '%invoke%' OR n LIKE '%proxy%' THEN 'reflection' WHEN n LIKE '%repository%' OR n LIKE '%service%' THEN 'dependency_injection' WHEN n LIKE 'test%' OR n LIKE '%mock%' OR path LIKE '%test%' THEN 'test_utility'
        WHEN name = 'ngOnInit' THEN 'framework_hook' WHEN n LIKE '%api%' THEN 'decorator' WHEN name LIKE '%::%' THEN 'interface_impl' WHEN n LIKE '%cfg%' OR path LIKE '%platform%' THEN 'conditional_compilation' WHEN n LIKE '%lazy%' THEN 'dynamic_import' END AS exclusion FROM f)
    SELECT id, coalesce(exclusion, 'dead') AS verdict, CASE WHEN exclusion IS NOT NULL THEN 0.0 ELSE round(0.9 - CASE WHEN name LIKE '%hook%' THEN 0.2 ELSE 0 END - CASE WHEN length(name) <= 3 THEN 0.15 ELSE 0 END - CASE WHEN path LIKE '%test%' THEN 0.1 ELSE 0 END, 4) END AS confidence FROM x""",
)
def dead_code(spark, d):
    """Functions nobody calls: why they may be alive, or how surely they are dead."""
    f = relation(spark, d, "functions").join(_edges(spark, d).select(F.col("dst").alias("id")), "id", "left_anti")
    why = S.dead_code_exclusion(F.col("name"), F.col("path"), F.col("is_entry"), F.col("is_exported"))
    sure = F.when(why.isNotNull(), 0.0).otherwise(F.round(S.dead_code_confidence(F.col("name"), F.col("path")), 4))
    return f.select("id", F.coalesce(why, F.lit("dead")).alias("verdict"), sure.alias("confidence"))


@query("call_edges functions", f"WITH {_E}, r(node) AS (SELECT id FROM functions WHERE is_entry UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT id FROM functions WHERE id NOT IN (SELECT node FROM r)")
def unreachable(spark, d):
    f = relation(spark, d, "functions")
    seen = G.reachable_set(_edges(spark, d), f.where("is_entry").select(F.col("id").alias("start")))
    return f.select("id").join(seen.withColumnRenamed("node", "id"), "id", "left_anti")


def _weighted(spark, d):
    return relation(spark, d, "call_edges").where("caller <> callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.round(1 - F.col("confidence"), 4).alias("weight"))


@query()
def shortest_path(spark, d):
    """Cheapest paths from every function; SQL keeps every walk, which is too slow for all starts."""
    starts = relation(spark, d, "functions").select(F.col("id").alias("start")).distinct()
    return G.shortest_paths(_weighted(spark, d), starts, "weight").select("start", "node", r6(F.col("cost")).alias("cost"))


@query()
def k_paths(spark, d):
    """Loopless alternatives between two nodes of the nation graph by trade volume."""
    li, c, s = table(spark, d, "lineitem"), table(spark, d, "customer"), table(spark, d, "supplier")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    flow = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = flow.groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.count("*").alias("n")).where("src <> dst")
    return G.k_paths(e.withColumn("weight", 1.0 / F.col("n")), 0, 1, 5).select("path", r6(F.col("cost")).alias("cost"))


@query("call_edges", f"WITH {_E}, {_CLOSE}, m AS (SELECT a.start AS node, least(a.start, min(a.node)) AS component FROM r AS a JOIN r AS b ON b.start = a.node AND b.node = a.start WHERE a.start <> a.node GROUP BY a.start) SELECT node, component FROM m")
def scc_cycles(spark, d):
    return G.strong_components(_edges(spark, d))


_MOD = "me AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM call_edges AS e JOIN functions AS a ON a.id = e.caller JOIN functions AS b ON b.id = e.callee WHERE a.module <> b.module), ab AS (SELECT module, avg(CASE WHEN is_exported THEN 1.0 ELSE 0.0 END) AS abstractness FROM functions GROUP BY 1)"
_MARTIN = f"{_MOD}, c AS (SELECT module, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca FROM (SELECT src AS module, count(*) AS ce FROM me GROUP BY 1) FULL OUTER JOIN (SELECT dst AS module, count(*) AS ca FROM me GROUP BY 1) USING (module)), m AS (SELECT module, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, CASE WHEN coalesce(ce + ca, 0) = 0 THEN 0.0 ELSE ce * 1.0 / (ce + ca) END AS i, abstractness AS a FROM ab LEFT JOIN c USING (module))"


def _coupling(spark, d):
    f = relation(spark, d, "functions")
    share = f.groupBy("module").agg(F.avg(F.when(F.col("is_exported"), 1.0).otherwise(0.0)).alias("abstractness"))
    return G.coupling(G.module_edges(_edges(spark, d), f, "id", "module"), share)


@query("call_edges functions", f"WITH {_MARTIN} SELECT module, ce, ca, round(i, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6) AS distance FROM m")
def martin_metrics(spark, d):
    return _coupling(spark, d).select("module", "ce", "ca", *(r6(F.col(c)).alias(c) for c in ("instability", "abstractness", "distance")))


@query("call_edges functions", f"WITH {_MARTIN} SELECT module, CASE WHEN abs(a + i - 1) <= 0.3 THEN 'main_sequence' WHEN a < 0.5 AND i < 0.5 THEN 'pain' WHEN a > 0.5 AND i > 0.5 THEN 'useless' ELSE 'main_sequence' END AS zone FROM m")
def coupling_zone(spark, d):
    return _coupling(spark, d).select("module", S.coupling_zone(F.col("instability"), F.col("abstractness")).alias("zone"))


_COVER = f"WITH {_E}, s AS (SELECT id AS start FROM functions WHERE is_test), r(start, node) AS (SELECT start, start FROM s UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node)"


@query("call_edges functions", f"{_COVER} SELECT f.module, count(DISTINCT r.node) AS covered, count(DISTINCT f.id) AS functions FROM functions AS f LEFT JOIN r ON r.node = f.id AND r.start <> r.node GROUP BY 1")
def test_coverage_map(spark, d):
    f = relation(spark, d, "functions")
    hit = G.reach(_edges(spark, d), f.where("is_test").select(F.col("id").alias("start"))).select("node").distinct()
    return f.join(hit, F.col("id") == F.col("node"), "left").groupBy("module").agg(F.count("node").alias("covered"), F.count("*").alias("functions"))


@query()
def min_test_set(spark, d):
    """Greedy cover of categories by files: rounds depend on earlier choices, which SQL can't loop over."""
    x = relation(spark, d, "detections").select("detection_method", F.concat_ws(":", "pattern_id", (F.col("file") % 30).cast("string")).alias("target"))
    return G.greedy_cover(x, "detection_method", "target")


@query(
    "call_edges functions",
    f"""WITH {_E}, s AS (SELECT id AS start FROM functions WHERE is_entry), r(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 6)
    SELECT r.start AS source, r.node AS sink, min(r.depth) AS hops, CASE WHEN k.lines > 90 THEN 'CWE-89' ELSE 'CWE-79' END AS cwe FROM r JOIN functions AS k ON k.id = r.node WHERE r.depth > 0 AND r.node <> r.start AND k.is_exported AND NOT k.is_test GROUP BY r.start, r.node, k.lines""",
)
def taint_flows(spark, d):
    """Entry points are sources, exported non-test functions sinks, tests count as sanitised."""
    f = relation(spark, d, "functions")
    hops = G.reach(_edges(spark, d), f.where("is_entry").select(F.col("id").alias("start")), 6)
    sinks = f.where("is_exported and not is_test").select(F.col("id").alias("node"), F.when(F.col("lines") > 90, "CWE-89").otherwise("CWE-79").alias("cwe"))
    return hops.join(sinks, "node").select(F.col("start").alias("source"), F.col("node").alias("sink"), F.col("depth").alias("hops"), "cwe")


@query(
    "call_edges functions",
    f"""WITH {_E}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT id AS start, CAST(lines AS DOUBLE) AS delta FROM functions), r(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, u.dst, depth + 1 FROM r JOIN u ON u.src = r.node WHERE depth < 5),
    m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2), p AS (SELECT m.node, s.delta * power(0.5, depth) AS delta FROM m JOIN s USING (start) WHERE depth > 0)
    SELECT node, round(sum(delta) / 100, 8) AS delta, count(*) AS sources FROM p WHERE abs(delta) >= 1 GROUP BY 1""",
)
def contradiction_propagation(spark, d):
    """Damped influence of every function on those within five hops, either way.

    Summed in hundredths, whose halves are exact, so that no order of rows shows.
    """
    s = relation(spark, d, "functions").select(F.col("id").alias("start"), F.col("lines").cast("double").alias("delta"))
    return G.damped_propagation(_edges(spark, d), s, least=1.0).select("node", F.round(F.col("delta") / 100, 8).alias("delta"), "sources")


@query(
    "call_edges",
    """WITH c AS (SELECT a.caller, a.confidence AS c1, b.confidence AS c2, c.confidence AS c3 FROM call_edges AS a JOIN call_edges AS b ON b.caller = a.callee AND b.callee <> a.caller JOIN call_edges AS c ON c.caller = b.callee AND c.callee <> b.caller)
    SELECT caller, round((0.6 * least(c1, c2, c3) + 0.4 * (c1 + c2 + c3) / 3) * power(0.95, 3), 9) AS confidence FROM c""",
)
def chain_confidence(spark, d):
    e = relation(spark, d, "call_edges").select("caller", "callee", "confidence")
    a, b, c = (e.select(*(F.col(x).alias(f"{p}_{x}") for x in e.columns)) for p in "abc")
    chain = a.join(b, (F.col("b_caller") == F.col("a_callee")) & (F.col("b_callee") != F.col("a_caller"))).join(c, (F.col("c_caller") == F.col("b_callee")) & (F.col("c_callee") != F.col("b_caller")))
    return chain.select(F.col("a_caller").alias("caller"), F.round(S.chain_confidence(F.array("a_confidence", "b_confidence", "c_confidence")), 9).alias("confidence"))


@query("call_edges functions", "SELECT a.module AS from_module, b.module AS to_module, count(*) AS calls, round(avg(e.confidence), 6) AS confidence FROM call_edges AS e JOIN functions AS a ON a.id = e.caller JOIN functions AS b ON b.id = e.callee WHERE a.module <> b.module GROUP BY 1, 2")
def cross_service_edges(spark, d):
    e, f = relation(spark, d, "call_edges"), relation(spark, d, "functions")
    a, b = f.select(F.col("id").alias("caller"), F.col("module").alias("from_module")), f.select(F.col("id").alias("callee"), F.col("module").alias("to_module"))
    x = e.join(a, "caller").join(b, "callee").where("from_module <> to_module")
    return x.groupBy("from_module", "to_module").agg(F.count("*").alias("calls"), r6(F.avg("confidence")).alias("confidence"))


@query(
    "detections functions",
    """SELECT f.id AS function, count(*) AS hits FROM detections AS t JOIN functions AS f ON f.module = t.file % 25 AND t.line BETWEEN f.id % 150 AND f.id % 150 + f.lines % 12 GROUP BY 1""",
)
def line_containment(spark, d):
    t = relation(spark, d, "detections").select((F.col("file") % 25).alias("m"), "line")
    f = relation(spark, d, "functions").select("id", "module", (F.col("id") % 150).alias("first"), (F.col("id") % 150 + F.col("lines") % 12).alias("last"))
    # Both sides repeat keys thousands of times: lines are counted before the join.
    t = t.groupBy("m", "line").agg(F.count("*").alias("n"))
    hits = G.contained_in(t, f, 16, ("m", "module"), "line", "first", "last")
    return hits.groupBy(F.col("id").alias("function")).agg(F.sum("n").alias("hits"))


@query(
    "call_edges functions",
    """WITH t AS (SELECT e.caller, f.id, f.is_exported, f.is_entry FROM call_edges AS e LEFT JOIN functions AS f ON f.id = e.callee)
    SELECT CASE WHEN id IS NULL THEN 'unresolved' WHEN is_exported THEN 'export' WHEN is_entry THEN 'entry' ELSE 'fuzzy' END AS resolution, count(*) AS n FROM t GROUP BY 1""",
)
def resolution_cascade(spark, d):
    calls = relation(spark, d, "call_edges").select("caller", "callee")
    f = relation(spark, d, "functions")
    steps = (("export", 0.9, f.where("is_exported")), ("entry", 0.8, f.where("is_entry")), ("fuzzy", 0.4, f))
    out = G.resolve_calls(calls.select("caller", F.col("callee").alias("target")), [(n, c, t.select("id", F.col("id").alias("k")), [("target", "k")]) for n, c, t in steps], "caller")
    return out.groupBy("resolution").agg(F.count("*").alias("n"))
