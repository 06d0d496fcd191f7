"""Entry points, tests, loops with queries, error gaps, labelled taint, all six gates, prediction and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import code as C
from orrery.functions import scores as S
from orrery.operators import gates as K
from orrery.operators import graph as G
from orrery.operators import relational as R
from orrery.sources.facts import relation, table
from orrery.sources.files import read_shard, write_shards

from .registry import query

r6 = lambda c: F.round(c, 6)


@query("functions", "SELECT id, CASE WHEN is_exported THEN 'exported' WHEN name = 'main' THEN 'main' ELSE 'test' END AS why FROM functions WHERE is_exported OR name = 'main' OR lower(name) LIKE 'test%' OR lower(name) LIKE 'it\\_%' ESCAPE '\\' OR lower(name) LIKE 'spec\\_%' ESCAPE '\\'")
def entry_points(spark, d):
    f = relation(spark, d, "functions")
    return f.select("id", C.entry_point(F.col("name"), F.col("path"), F.col("is_exported")).alias("why")).where("why is not null")


_TESTS = "t AS (SELECT id, lines, id % 8 AS assertions, id % 14 AS sources, id % 9 AS mocks, id % 17 = 0 AS sleeps, id % 6 = 0 AS branches FROM functions WHERE is_test)"


def _tests(spark, d):
    i = F.col("id")
    return relation(spark, d, "functions").where("is_test").select("id", "module", "lines", (i % 8).alias("assertions"), (i % 14).alias("sources"), (i % 9).alias("mocks"), (i % 17 == 0).alias("sleeps"), (i % 6 == 0).alias("branches"))


@query(
    "functions",
    f"""WITH {_TESTS}, s AS (SELECT unnest(list_filter([CASE WHEN lines <= 1 THEN 'empty' END, CASE WHEN assertions = 0 THEN 'no_assertion' END, CASE WHEN sleeps THEN 'sleep' END, CASE WHEN branches THEN 'conditional' END, CASE WHEN lines > 50 THEN 'too_long' END,
    CASE WHEN assertions > 5 THEN 'many_assertions' END, CASE WHEN sources > 10 THEN 'eager' END, CASE WHEN sources = 0 THEN 'no_source_call' END, CASE WHEN mocks > 5 THEN 'many_mocks' END], lambda x: x IS NOT NULL)) AS smell FROM t) SELECT smell, count(*) AS n FROM s GROUP BY 1""",
)
def test_smells(spark, d):
    smells = C.test_smells(*(F.col(c) for c in ("lines", "assertions", "sources", "mocks", "sleeps", "branches")))
    return _tests(spark, d).select(F.explode(smells).alias("smell")).groupBy("smell").agg(F.count("*").alias("n"))


@query(
    "functions",
    """WITH t AS (SELECT module, avg(CASE WHEN is_test THEN 1.0 ELSE 0.0 END) AS breadth, avg(CASE WHEN is_test THEN least(1.0, lines / 50.0) END) AS depth, avg(CASE WHEN is_test THEN id % 8 END) AS a, avg(CASE WHEN is_test THEN id % 9 END) / 10 AS m, avg(CASE WHEN is_test AND id % 5 <> 0 THEN 1.0 WHEN is_test THEN 0.0 END) AS iso, avg(CASE WHEN is_test AND id % 3 = 0 THEN 1.0 WHEN is_test THEN 0.0 END) AS fresh FROM functions GROUP BY 1)
    SELECT module, round(least(1.0, greatest(0.0, 0.25 * breadth + 0.15 * depth + 0.15 * least(1.0, a / 3) + 0.10 * greatest(0.0, 1 - abs(m - 0.3) * 2) + 0.15 * iso + 0.10 * fresh + 0.10)), 6) AS quality FROM t""",
)
def test_quality(spark, d):
    t, i = F.col("is_test"), F.col("id")
    share = lambda c: F.avg(F.when(t, F.when(c, 1.0).otherwise(0.0)))
    g = relation(spark, d, "functions").groupBy("module").agg(
        F.avg(F.when(t, 1.0).otherwise(0.0)).alias("breadth"), F.avg(F.when(t, F.least(F.lit(1.0), F.col("lines") / 50.0))).alias("depth"), F.avg(F.when(t, i % 8)).alias("assertions"),
        (F.avg(F.when(t, i % 9)) / 10).alias("mocks"), share(i % 5 != 0).alias("isolation"), share(i % 3 == 0).alias("freshness"),
    )
    dims = [F.col(c) for c in ("breadth", "depth", "assertions", "mocks", "isolation", "freshness")]
    return g.select("module", r6(C.test_quality(*dims, F.lit(1.0))).alias("quality"))


_LOOPS = "l AS (SELECT l_orderkey AS function, l_suppkey % 50 AS first, l_suppkey % 50 + 20 AS last FROM lineitem WHERE l_linenumber = 1), c AS (SELECT l_orderkey AS function, l_partkey % 90 AS line, CASE WHEN l_suppkey % 3 = 0 THEN 'select' WHEN l_suppkey % 3 = 1 THEN 'batch' ELSE 'call' END AS kind FROM lineitem WHERE l_linenumber > 1)"


@query("", f"WITH {_LOOPS} SELECT c.function, count(*) AS queries FROM l JOIN c ON c.function = l.function AND c.line BETWEEN l.first AND l.last WHERE c.kind = 'select' GROUP BY 1")
def queries_in_loops(spark, d):
    """Queries inside a loop of their function, batch calls left out: containment within an equi-join."""
    x = table(spark, d, "lineitem")
    loops = x.where("l_linenumber = 1").select(F.col("l_orderkey").alias("function"), (F.col("l_suppkey") % 50).alias("first"))
    calls = x.where("l_linenumber > 1 and l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("function"), (F.col("l_partkey") % 90).alias("line"))
    inside = F.col("line").between(F.col("first"), F.col("first") + 20)
    return calls.join(loops, "function").where(inside).groupBy("function").agg(F.count("*").alias("queries"))


@query("functions", "WITH x AS (SELECT module, CASE id % 9 WHEN 0 THEN 'empty_catch' WHEN 1 THEN 'generic_catch' WHEN 2 THEN 'unhandled' WHEN 3 THEN 'swallowed' WHEN 4 THEN 'unhandled_async' END AS kind FROM functions) SELECT kind, CASE kind WHEN 'generic_catch' THEN 396 WHEN 'unhandled' THEN 248 WHEN 'unhandled_async' THEN 248 ELSE 390 END AS cwe, CASE WHEN kind IN ('generic_catch', 'swallowed') THEN 'medium' ELSE 'high' END AS severity, count(*) AS n, count(DISTINCT module) AS modules FROM x WHERE kind IS NOT NULL GROUP BY 1")
def error_gaps(spark, d):
    """Gaps in error handling with their CWE."""
    kinds = list(C.ERROR_GAPS)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 9 + 1).cast("int"))
    facts = F.create_map(*(x for k, (cwe, severity) in C.ERROR_GAPS.items() for x in (F.lit(k), F.struct(F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity")))))
    x = relation(spark, d, "functions").where(f"id % 9 < {len(kinds)}").select("module", kind.alias("kind"))
    g = x.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("module").alias("modules"))
    return g.select("kind", facts[F.col("kind")]["cwe"].alias("cwe"), facts[F.col("kind")]["severity"].alias("severity"), "n", "modules")


_TAINT = """e AS (SELECT DISTINCT caller AS src, callee AS dst FROM call_edges WHERE caller <> callee), s AS (SELECT id, CASE id % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'network' ELSE 'file' END AS label FROM functions WHERE is_entry),
    san AS (SELECT id, CASE name WHEN 'mock_db' THEN 'input' WHEN 'cfg_unix' THEN 'network' WHEN 'fn' THEN 'file' END AS label FROM functions WHERE name IN ('mock_db', 'cfg_unix', 'fn')),
    r(label, node) AS (SELECT label, id FROM s UNION SELECT r.label, e.dst FROM r JOIN e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM san WHERE san.id = e.dst AND san.label = r.label))"""


@query("call_edges functions", f"WITH RECURSIVE {_TAINT} SELECT node, string_agg(label, ',' ORDER BY label) AS labels FROM r GROUP BY 1")
def taint_labels(spark, d):
    """Labels that reach each function from entry points, unless a sanitiser of that label stands before it."""
    f = relation(spark, d, "functions").select("id", "name", "is_entry")
    e = G.clean_edges(relation(spark, d, "call_edges"), "caller", "callee")
    out = None
    for k, (label, sanitiser) in enumerate((("input", "mock_db"), ("network", "cfg_unix"), ("file", "fn"))):
        clean = e.join(f.where(F.col("name") == sanitiser).select(F.col("id").alias("dst")), "dst", "left_anti")
        part = G.reachable_set(clean, f.where(f"is_entry and id % 3 = {k}").select(F.col("id").alias("start"))).select("node", F.lit(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


_SERVICES = "sv AS (SELECT DISTINCT a.module // 5 AS src, b.module // 5 AS dst FROM call_edges AS c JOIN functions AS a ON a.id = c.caller JOIN functions AS b ON b.id = c.callee WHERE a.module // 5 <> b.module // 5 AND c.confidence >= 0.9)"


@query("call_edges functions", f"WITH RECURSIVE {_SERVICES}, r(start, node) AS (SELECT src, dst FROM sv UNION SELECT r.start, sv.dst FROM r JOIN sv ON sv.src = r.node) SELECT start AS service, count(DISTINCT node) AS reaches FROM r WHERE start <> node GROUP BY 1")
def service_reach(spark, d):
    """Services that each service reaches over any number of calls between services."""
    f = relation(spark, d, "functions").select("id", F.floor(F.col("module") / 5).alias("service"))
    e = relation(spark, d, "call_edges").where("confidence >= 0.9").join(f.select(F.col("id").alias("caller"), F.col("service").alias("a")), "caller").join(f.select(F.col("id").alias("callee"), F.col("service").alias("b")), "callee")
    e = G.clean_edges(e, "a", "b")
    return G.reach(e, e.select(F.col("src").alias("start"))).groupBy(F.col("start").alias("service")).agg(F.count("*").alias("reaches"))


_SIX = """m AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE severity = 'warning') AS outliers, count(*) FILTER (WHERE seq % 4 <> 0) AS passing, count(*) FILTER (WHERE severity = 'error' AND is_new) AS secure_errors, count(*) FILTER (WHERE severity = 'error' AND suppressed) AS gaps, avg(CASE WHEN seq <= 3 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN year(created_at) >= 1996 AND severity = 'error' THEN 1.0 WHEN year(created_at) >= 1996 THEN 0.0 END) - avg(CASE WHEN year(created_at) < 1996 AND severity = 'error' THEN 1.0 WHEN year(created_at) < 1996 THEN 0.0 END) AS drop FROM violations GROUP BY 1),
    g AS (SELECT project, 'pattern_compliance' AS gate, 100.0 * (n - outliers) / n AS score, 100.0 * (n - outliers) / n >= 74.5 AS ok FROM m UNION ALL SELECT project, 'constraints', 100.0 * passing / n, 100.0 * passing / n >= 75 FROM m UNION ALL SELECT project, 'security', 100.0 * (n - secure_errors) / n, secure_errors = 0 FROM m
    UNION ALL SELECT project, 'coverage', 100.0 * coverage, coverage >= 0.6 FROM m UNION ALL SELECT project, 'error_handling', 100.0 * (n - gaps) / n, gaps = 0 FROM m UNION ALL SELECT project, 'regression', -100.0 * drop, -100.0 * drop > -15 FROM m)"""


@query("violations", f"WITH {_SIX}, p AS (SELECT project, ok AS base FROM g WHERE gate = 'pattern_compliance') SELECT project, gate, round(score, 4) AS score, CASE WHEN gate IN ('constraints', 'security') AND NOT base THEN 'skipped' WHEN ok THEN 'passed' ELSE 'failed' END AS state FROM g JOIN p USING (project)")
def gates_in_order(spark, d):
    """All six gates; constraints and security wait for compliance and are skipped where it fails."""
    error, new = F.col("severity") == "error", F.year("created_at") >= 1996
    share = lambda c: F.avg(F.when(c, F.when(error, 1.0).otherwise(0.0)))
    m = relation(spark, d, "violations").groupBy("project").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "warning").alias("outliers"), F.count_if(F.col("seq") % 4 != 0).alias("passing"), F.count_if(error & F.col("is_new")).alias("secure_errors"),
        F.count_if(error & F.col("suppressed")).alias("gaps"), F.avg(F.when(F.col("seq") <= 3, 1.0).otherwise(0.0)).alias("coverage"), (share(new) - share(~new)).alias("drop"),
    )
    return K.gates_in_order(m, "project", compliance=74.5, constraints=75.0, coverage=0.6)


@query("violations", f"WITH {_SIX}, w AS (SELECT project, bool_and(ok) FILTER (WHERE gate IN ('pattern_compliance', 'coverage')) AS required, avg(score) AS mean FROM g GROUP BY 1) SELECT project, required AND mean >= 60 AS passed FROM w")
def policy_required(spark, d):
    """Required gates have to pass whatever the mean of all says."""
    g = gates_in_order(spark, d)
    required = F.bool_and(F.when(F.col("gate").isin("pattern_compliance", "coverage"), F.col("state") == "passed"))
    return g.groupBy("project").agg((required & (F.avg("score") >= 60)).alias("passed"))


@query("detections", "WITH old AS (SELECT * FROM detections WHERE id % 4 <> 0), fresh AS (SELECT * FROM detections WHERE file % 10 = 3), changed AS (SELECT DISTINCT file FROM fresh), merged AS (SELECT * FROM old WHERE file NOT IN (SELECT file FROM changed) UNION ALL SELECT * FROM fresh) SELECT pattern_id, count(*) AS locations, count(DISTINCT file) AS files, round(avg(confidence), 6) AS mean FROM merged WHERE pattern_id IN (SELECT pattern_id FROM fresh UNION SELECT pattern_id FROM old WHERE file IN (SELECT file FROM changed)) GROUP BY 1")
def incremental_aggregate(spark, d):
    """Locations of changed files are replaced, and only patterns that they touch are aggregated anew."""
    x = relation(spark, d, "detections")
    old, fresh = x.where("id % 4 <> 0"), x.where("file % 10 = 3")
    changed = fresh.select("file").distinct()
    dirty = fresh.select("pattern_id").union(old.join(changed, "file", "left_semi").select("pattern_id")).distinct()
    merged = old.join(changed, "file", "left_anti").select(x.columns).unionByName(fresh).join(dirty, "pattern_id", "left_semi")
    return merged.groupBy("pattern_id").agg(F.count("*").alias("locations"), F.countDistinct("file").alias("files"), r6(F.avg("confidence")).alias("mean"))


@query("memories", "WITH a AS (SELECT max(transaction_time) AS now FROM memories) SELECT memory_type, count(*) AS candidates FROM memories, a WHERE NOT archived AND confidence > 0.3 AND transaction_time < now - INTERVAL 7 DAY GROUP BY 1")
def consolidation_candidates(spark, d):
    """Memories older than a week and sure enough to be consolidated."""
    m = relation(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("transaction_time").alias("now")))  # one row
    return m.where("not archived and confidence > 0.3").join(now).where(F.col("transaction_time") < F.col("now") - F.make_dt_interval(F.lit(7))).groupBy("memory_type").agg(F.count("*").alias("candidates"))


@query("", "SELECT role, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(always|never|must|all|none|every)\\b')) AS absolute, count(*) AS n FROM conversations GROUP BY 1")
def absolute_statements(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count_if(F.lower("text").rlike(r"\b(always|never|must|all|none|every)\b")).alias("absolute"), F.count("*").alias("n"))


@query(
    "memories",
    """WITH p AS (SELECT memory_id, 'file' AS strategy, 0.9 - (entity % 10) / 20.0 AS score FROM memories WHERE entity % 3 = 0 UNION ALL SELECT memory_id, 'pattern', confidence * 0.8 FROM memories WHERE memory_type <> '5-LOW' UNION ALL SELECT memory_id, 'temporal', 0.5 FROM memories WHERE month(transaction_time) = 3 UNION ALL SELECT memory_id, 'behaviour', least(1.0, access_count / 40.0) FROM memories)
    SELECT memory_id, round(max(score), 6) AS score, count(*) AS strategies FROM p GROUP BY 1 HAVING max(score) >= 0.5""",
)
def predicted_memories(spark, d):
    """Four strategies' candidates, each memory once with its best score."""
    m = relation(spark, d, "memories")
    found = F.array_compact(F.array(
        F.when(F.col("entity") % 3 == 0, 0.9 - (F.col("entity") % 10) / 20.0), F.when(F.col("memory_type") != "5-LOW", F.col("confidence") * 0.8),
        F.when(F.month("transaction_time") == 3, F.lit(0.5)), F.least(F.lit(1.0), F.col("access_count") / 40.0),
    ))
    return m.select("memory_id", r6(F.array_max(found)).alias("score"), F.size(found).cast("bigint").alias("strategies"), F.array_max(found).alias("s")).where("s >= 0.5").drop("s")


@query("", "WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, list_distinct(regexp_extract_all(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z]+')) AS p FROM conversations) SELECT conv_id, turn, len(list_filter(w, lambda x: NOT list_contains(p, x)))::BIGINT AS added, len(list_filter(p, lambda x: NOT list_contains(w, x)))::BIGINT AS removed FROM w WHERE p IS NOT NULL")
def diff_analysis(spark, d):
    """Words that a turn adds to and drops from the turn before."""
    from pyspark.sql import Window

    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = table(spark, d, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w"), words(before).alias("p")).where("p is not null")
    return x.select("conv_id", "turn", F.size(F.array_except("w", "p")).cast("bigint").alias("added"), F.size(F.array_except("p", "w")).cast("bigint").alias("removed"))


@query("", "SELECT event_type, CAST(sum(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events WHERE props LIKE '%\"k\"%' GROUP BY 1")
def json_field(spark, d):
    """A field of the JSON payload, summed."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("", "SELECT a.vec_id, round(list_dot_product(a.embedding[1:16]::DOUBLE[], b.embedding[1:16]::DOUBLE[]), 4) AS dot FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL")
def truncated_dot(spark, d):
    """Dot product of neighbours' first sixteen components, as they are."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.slice("embedding", 1, 16).alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").select("vec_id", F.round(S.dot(F.col("x"), F.col("y")), 4).alias("dot"))


@query("memories", "SELECT entity, round(exp(sum(ln(CASE memory_type WHEN '1-URGENT' THEN CASE WHEN archived THEN 0.5 ELSE 1.0 END WHEN '2-HIGH' THEN CASE WHEN archived THEN 0.3 ELSE 1.0 END ELSE exp(-0.693 * (memory_id % 60) / 90.0) END))), 6) AS freshness FROM memories GROUP BY 1")
def evidence_product(spark, d):
    """Freshness as the product over evidence: a stale file halves it, a gone pattern leaves .3, a user's word fades in ninety days."""
    fresh = F.when(F.col("memory_type") == "1-URGENT", F.when(F.col("archived"), 0.5).otherwise(1.0)).when(F.col("memory_type") == "2-HIGH", F.when(F.col("archived"), 0.3).otherwise(1.0)).otherwise(F.exp(-0.693 * (F.col("memory_id") % 60) / 90.0))
    return relation(spark, d, "memories").groupBy("entity").agg(r6(F.exp(F.sum(F.log(fresh)))).alias("freshness"))


@query("detections", "SELECT category, count(*) AS n, count(DISTINCT file) AS files FROM detections WHERE category = 'api' GROUP BY 1")
def lake_shard(spark, d):
    """One category's shard of the lake: written by category, and only that folder is read."""
    path = write_shards(relation(spark, d, "detections").select("category", "file", "id"), "category")
    return read_shard(spark, path, "category", "api").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query("memories", "SELECT memory_id, to_base64(encode('{\"id\":' || memory_id || ',\"sort\":' || access_count || '}')) AS cursor FROM memories WHERE memory_type = '1-URGENT'")
def page_cursors(spark, d):
    m = relation(spark, d, "memories").where("memory_type = '1-URGENT'")
    return m.select("memory_id", R.cursor_of(id=F.col("memory_id"), sort=F.col("access_count")).alias("cursor"))
