"""Edge cases that the tables don't hold, on literal rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import crdt, gates, graph, outliers, relational, similarity, temporal, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_cursor_round_trip():
    assert relational.decode_cursor(relational.encode_cursor(id=5, sort=0.25)) == {"id": 5, "sort": 0.25}


def test_keyset_has_more(spark):
    df = spark.range(1, 6)
    assert [(r.id, r.has_more) for r in relational.keyset_page(df, "id", 2, 2).collect()] == [(3, True), (4, True)]
    assert [(r.id, r.has_more) for r in relational.keyset_page(df, "id", 3, 2).collect()] == [(4, False), (5, False)]


def test_suppression(spark):
    rows = [("f", 1, "x = 1  # noqa: E1, E2"), ("f", 2, "y"), ("f", 3, "z"), ("f", 4, "@SuppressWarnings")]
    got = {r.n: r.suppressed_rules for r in relational.suppressed_lines(spark.createDataFrame(rows, "f string, n int, t string"), "f", "n", "t").collect()}
    assert got == {1: ["E1", "E2"], 2: ["E1", "E2"], 3: None, 4: ["*"]}


def test_scan_diff_prefers_stamps(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c")], "k int, s int, d string")
    b = spark.createDataFrame([(1, 5, "zz"), (2, 6, "b"), (4, 1, "n")], "k int, s int, d string")
    assert {r.k: r.status for r in relational.scan_diff(a, b, "k", "s", "d").collect()} == {1: "unchanged", 2: "unchanged", 3: "removed", 4: "added"}


def test_beta_and_t_quantiles():
    assert abs(outliers.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6
    assert abs(outliers.beta_quantile(0.975, 1, 1) - 0.975) < 1e-9
    assert abs(outliers.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(outliers.grubbs_limit(10) - 2.2900) < 1e-3


def test_constant_values_have_no_outliers(spark):
    df = spark.createDataFrame([("g", k, 3.0) for k in range(12)], "g string, k int, v double")
    assert outliers.zscore(df, "g", "v").where("is_outlier").count() == 0
    assert outliers.iqr(df, "g", "v").where("is_outlier").count() == 0
    assert outliers.mad(df, "g", "v").where("is_outlier").count() == 0
    assert not outliers.esd_flags(np.full(12, 3.0)).any()


def test_grouped_esd_equals_plain(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=60), [9.0, -8.0, 8.5]])
    df = spark.createDataFrame([("g", k, float(x)) for k, x in enumerate(v)], "g string, k int, v double").repartition(4)
    assert {r.k for r in outliers.esd(df, "g", "k", "v").collect()} == set(np.flatnonzero(outliers.esd_flags(v)).tolist())


def test_jaccard_and_cosine_edges(spark):
    empty = F.array().cast("array<string>")
    assert value(spark, S.jaccard(empty, empty)) == 0 and value(spark, S.jaccard(empty, empty, 1.0)) == 1
    vec = lambda *x: F.array(*(F.lit(float(a)) for a in x))
    assert value(spark, S.cosine(vec(0, 0), vec(1, 1))) == 0 and value(spark, S.cosine(vec(1), vec(1, 1))) == 0
    assert abs(value(spark, S.cosine(vec(2, 2), vec(1, 1))) - 1) < 1e-12


def test_jaccard_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = {k: set(rng.choice(25, size=rng.integers(1, 15), replace=False).tolist()) for k in range(40)}
    df = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "o int, t int")
    for limit in (0.2, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit}
        assert {(r.a, r.b) for r in similarity.jaccard_pairs(df, "o", "t", limit).collect()} == want


def test_minhash_finds_close_sets(spark):
    df = spark.createDataFrame([(o, t) for o in (1, 2) for t in range(100)] + [(3, t) for t in range(500, 600)], "o int, t int")
    assert [(r.a, r.b, r.estimate) for r in similarity.minhash_pairs(df, "o", "t", 0.5).collect()] == [(1, 2, 1.0)]


def test_minhash_recall_at_its_threshold(spark):
    sets = {}
    for k in range(60):  # pairs of Jaccard 30 / 90, 40 / 80 ... that share nothing with other pairs
        common = (30, 40, 50)[k % 3]
        sets[2 * k] = [1000 * k + t for t in range(60)]
        sets[2 * k + 1] = [1000 * k + 60 - common + t for t in range(60)]
    df = spark.createDataFrame([(o, t) for o, s in sets.items() for t in s], "o int, t int")
    want = {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df, "o", "t", 0.3).collect()}
    got = {(r.a, r.b): r.jaccard for r in similarity.minhash_pairs(df, "o", "t", 0.3).collect()}
    assert len(want) == 60 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(math.isclose(got[p], want[p]) for p in got)
    assert similarity.band_rows(0.3, 128) == 2


def test_thresholds(spark):
    assert [value(spark, S.merge_decision(F.lit(x))) for x in (0.95, 0.85, 0.8499)] == ["auto_merge", "flag_for_review", "separate"]
    assert [value(spark, S.audit_duplicate_tier(F.lit(x))) for x in (0.951, 0.95, 0.90, 0.84)] == ["auto_merge", "merge", "review", "none"]
    assert value(spark, S.provenance_confidence(F.array().cast("array<double>"))) == 1
    assert value(spark, S.staleness_decay(F.lit(7))) == 1 and value(spark, S.staleness_decay(F.lit(90))) == 0.1


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def test_reach_leaves_out_the_start_of_a_cycle(spark):
    got = graph.reach(edges(spark, (1, 2), (2, 3), (3, 1), (8, 9)), spark.createDataFrame([(1,)], "start bigint"))
    assert {(r.node, r.depth) for r in got.collect()} == {(2, 1), (3, 2)}


def test_strong_components_equal_tarjan(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (55, 2)) if a != b]
    reachable = {a: {a} for a in range(40)}
    for _ in range(40):
        for a, b in pairs:
            for s in reachable.values():
                if a in s:
                    s.add(b)
    want = {}
    for a in range(40):
        comp = [b for b in range(40) if b in reachable[a] and a in reachable[b]]
        if len(comp) > 1:
            want[a] = min(comp)
    assert {r.node: r.component for r in graph.strong_components(edges(spark, *pairs)).collect()} == want


def test_k_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.0), (3, 4, 2.0), (1, 4, 9.0)], "src bigint, dst bigint, weight double")
    assert [(r.path, r.cost) for r in graph.k_paths(e, 1, 4, 2).collect()] == [("1>2>4", 2.0), ("1>3>4", 3.0)]


def test_k_paths_have_no_edge_bound(spark):
    chain = [(k, k + 1, 0.1) for k in range(1, 10)]
    e = spark.createDataFrame([*chain, (1, 10, 5.0), (1, 9, 3.0), (10, 2, 0.1)], "src bigint, dst bigint, weight double")
    got = [(r.path, round(r.cost, 6)) for r in graph.k_paths(e, 1, 10, 3).collect()]
    assert got == [("1>2>3>4>5>6>7>8>9>10", 0.9), ("1>9>10", 3.1), ("1>10", 5.0)]


def test_greedy_cover(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2), ("a", 2), ("a", 3), ("c", 3)], "c string, i int")
    assert [(r.c, r.newly_covered) for r in graph.greedy_cover(df, "c", "i").collect()] == [("a", 2), ("b", 1)]


def test_gate_order():
    assert gates.run_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        gates.run_order({"a": ["b"], "b": ["a"]})


def test_merges_are_idempotent(spark):
    df = spark.createDataFrame([("k", "x", 3), ("k", "x", 5), ("k", "y", 2)], "k string, a string, v int")
    assert crdt.gcounter(df, "k", "a", "v").first().total == crdt.gcounter(df.union(df), "k", "a", "v").first().total == 7
    tied = spark.createDataFrame([("k", 1, 10, "a"), ("k", 2, 10, "b")], "k string, v int, t int, agent string")
    assert crdt.lww(tied, "k", "v", "t", "agent").first().v == 2


def test_type_two_correction(spark):
    h = spark.createDataFrame([(1, 10, None, "a")], "k int, valid_time int, valid_until int, v string")
    f = spark.createDataFrame([(1, 20, "b")], "k int, valid_time int, v string")
    assert sorted(tuple(r) for r in temporal.close_and_insert(h, f, "k").collect()) == [(1, 10, 20, "a"), (1, 20, None, "b")]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("s", 1, 9, 60), ("s", 2, 8, 50), ("s", 3, 7, 40), ("s", 4, 6, 500)], "s string, k int, p int, t int")
    assert [r.k for r in text.pack_budget(df, "s", "k", "p", "t", 100).collect()] == [1, 3]


def test_redaction_and_textrank(spark):
    t = F.lit("mail a.b@c.de from 10.0.0.1")
    assert value(spark, text.redact(t)) == "mail [EMAIL] from [IPV4]"
    scores = similarity.textrank_scores([["a", "b"], ["a", "b"], ["q"]])
    assert math.isclose(scores[0], scores[1]) and scores[2] < scores[0]


def test_textrank_ranks_the_whole_document(spark):
    rng = np.random.default_rng(4)
    parts = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 9))) for _ in range(430)]
    parts[7] = "lonely"
    counts = np.array([[s.split().count(w) for w in sorted({w for p in parts for w in p.split()})] for s in parts], float)
    unit = counts / np.linalg.norm(counts, axis=1, keepdims=True)
    weight = unit @ unit.T
    np.fill_diagonal(weight, 0)
    weight[7] = weight[:, 7] = 0
    total = weight.sum(1)
    want = np.full(430, 1 / 430)
    for _ in range(100):
        new = 0.15 / 430 + 0.85 * weight @ np.divide(want, total, out=np.zeros(430), where=total > 0)
        done, want = np.abs(new - want).max() < 1e-6, new
        if done:
            break
    assert np.allclose(similarity.textrank_scores([p.split() for p in parts]), want, atol=1e-9)
    df = spark.createDataFrame([(1, ". ".join(parts)), (2, "a b. a b. q"), (3, ""), (4, None)], "k int, t string")
    got = [(r.k, r.position) for r in text.textrank(df, "k", "t", 2).collect()]
    best = sorted(range(430), key=lambda i: (-round(want[i], 9), i))[:2]
    assert sorted(got) == [(1, i) for i in sorted(best)] + [(2, 0), (2, 1)]


def test_packages_import_without_llm():
    """Nothing outside the folder imports it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "orrery"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "orrery.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


def test_loops_have_no_round_limit():
    """A bound would end them silently; a chain of that many rounds takes minutes."""
    import inspect

    assert "rounds" not in inspect.signature(graph.shortest_paths).parameters
    assert "rounds" not in inspect.signature(graph.greedy_cover).parameters


def test_jaccard_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "RUN", 3)
    rng = np.random.default_rng(5)
    sets = {o: set(rng.choice(40, size=rng.integers(1, 25), replace=False).tolist()) for o in range(40)}
    sets |= {100 + o: sets[o] | {77} for o in range(10)}
    df = spark.createDataFrame([(o, t) for o, s in sets.items() for t in s], "o int, t int")
    for least in (0.3, 0.6):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        assert {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df, "o", "t", least).collect()} == pytest.approx(want)


@pytest.mark.parametrize("pairs", [8_000_000, 20])
def test_blocked_search_equals_joins(spark, monkeypatch, pairs):
    """Graphs that fit one task and those that don't give the same, halved blocks included."""
    from orrery.operators import blocked

    monkeypatch.setattr(blocked, "MOST_PAIRS", pairs)
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(int(a), int(b), round(float(w), 3)) for a, b, w in zip(rng.integers(0, 60, 110), rng.integers(0, 60, 110), rng.uniform(0, 1, 110)) if a != b], "src bigint, dst bigint, w double")
    starts = spark.range(0, 70).withColumnRenamed("id", "start")

    def run():
        near = {tuple(r) for r in graph.reach(edges, starts).collect()}
        two = {tuple(r) for r in graph.reach(edges, starts, 2).collect()}
        counts = {tuple(r) for r in graph.reach_counts(edges, starts).collect()}
        costs = {(r.start, r.node): round(r.cost, 9) for r in graph.shortest_paths(edges, starts, "w").collect()}
        return near, two, counts, costs

    fast = run()
    monkeypatch.setattr(blocked, "MOST_EDGES", 0)
    assert fast == run()


def test_pattern_guards_lose_nothing(spark):
    texts = ["mail a.b@c.de", "123-45-6789", "4111 1111 1111 1111", "DE89370400440532013000", "00:1A:2b:3c:4d:5e", "1:2:3:4:5:6:7:8", "10.0.0.255", "call 555-123-4567 now", "12/31/1999", "123-456-789", "A12345678", "B1234567",
             "1HGCM82633A004352", "12 Long Hill Road", "12345678", "postgres://u:p@h/d", "MYSQL://u:p@h", "mongodb+srv://u:p@h", "redis://h", "Server=s;x=1;Pwd=p", "jdbc:pg://u:p@h", "Driver=d;PWD=p", "key: " + "A" * 44, "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----", 'token = "abcdefghijklmnop"']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", *text.counts(F.col("t"))).collect()
    import re

    for r, t in zip(sorted(got), texts):
        assert {p.name: r[p.name] for p in text.PATTERNS} == {p.name: len(re.findall(p.regex, t)) for p in text.PATTERNS}
    assert all(any(r[p.name] for r in got) for p in text.PATTERNS)


def test_top_k_cosine_of_many_queries(spark):
    """Against brute force, with copies, unusable vectors and runs that differ from the partitions."""
    rng = np.random.default_rng(4)
    x = {k: [float(v) for v in rng.normal(size=6)] for k in range(120)}
    x |= {120: x[3], 121: [v * 1e200 for v in x[3]], 122: [v * 1e-200 for v in x[50]]}
    bad = [(130, None), (131, [0.0] * 6), (132, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (133, [float("nan")] * 6), (150, [float("inf")] * 6)]
    df = spark.createDataFrame([*x.items(), *bad], "vec_id bigint, embedding array<double>").repartition(5)
    unit = {k: np.array(v) / np.abs(v).max() for k, v in x.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    want = set()
    for q in (0, 50, 100):
        best = sorted((-round(float(unit[q] @ v), 9), k) for k, v in unit.items())
        want |= {(q, k, -s) for s, k in best[:10] if s < 0}
    got = similarity.top_k_cosine(df, df.where("vec_id % 50 = 0"), 10).collect()
    assert {(r.query, r.vec_id, round(r.score, 8)) for r in got} == {(q, k, round(s, 8)) for q, k, s in want}
    assert similarity.top_k_cosine(df.where("false"), df, 10).count() == 0


def test_reached_pairs_equal_brute_force(spark, monkeypatch):
    """With cycles and without, chains beyond the ranks, halved blocks, unknown ids; by blocks and by joins, which send nothing to every worker."""
    from orrery.operators import blocked

    rng = np.random.default_rng(9)
    drawn = [(int(a), int(b)) for a, b in rng.integers(0, 50, (75, 2)) if a != b]
    chain = [(100 + k, 101 + k) for k in range(12)]
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 52, (500, 2))} | {(100, k) for k in range(90, 113)} | {(112, 100), (7, 7)})
    by_blocks, by_joins = [(4_000_000, 1000, 8_000_000), (4_000_000, 5, 20)], [(-1, 5, 20)]
    for given, ways in (([(a, b) for a, b in drawn if a < b and b % 3], by_blocks + by_joins), (drawn + chain + [(112, 100)], by_blocks + by_joins), (drawn + chain, by_blocks), ([], by_blocks)):
        out = {a: {y for x, y in given if x == a} for a, _ in given}
        want = {}
        for a in {a for a, _ in pairs}:
            below, todo = set(), [a]
            while todo:
                new = out.get(todo.pop(), set()) - below
                below |= new
                todo += new
            want |= {(a, b): b in below and a != b for x, b in pairs if x == a}
        e, p = spark.createDataFrame(given, "src bigint, dst bigint"), spark.createDataFrame(pairs + pairs[:9], "start bigint, node bigint")
        for edges_sent, ranks, most_pairs in ways:
            monkeypatch.setattr(blocked, "MOST_EDGES", edges_sent)
            monkeypatch.setattr(blocked, "MOST_RANKS", ranks)
            monkeypatch.setattr(blocked, "MOST_PAIRS", most_pairs)
            df = graph.reached_pairs(e, p)
            got = df.collect()
            assert len(got) == len(want) and {(r.start, r.node): r.reached for r in got} == want
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
