"""Every query against its SQL on the smallest tables; those without SQL for shape."""

from __future__ import annotations

import os

import oracle
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")

from orrery.plans import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.differences(df, con, ORACLES[name]) == ""
    else:
        assert df.columns and df.count() >= 0


def test_graph_queries_start_everywhere(spark, tmp_path):
    """Inverse reach, cheapest paths and propagation from all functions, by brute force."""
    import heapq
    from collections import defaultdict

    rank = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    keys = [k for k in range(1, 140) if k % 7]
    rows = [(k, k % 40, "F", float(900 * k), rank[k * k % 5]) for k in keys]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    edges = {(k, k * 3 if k % 11 == 0 else k // 3): round(1 - [0.95, 0.9, 0.8, 0.75, 0.6][k * k % 5], 4) for k in keys}
    back, both, out = defaultdict(set), defaultdict(set), defaultdict(dict)
    for (a, b), w in edges.items():
        back[b].add(a)
        both[a].add(b)
        both[b].add(a)
        out[a][b] = w

    def hops(near, start, most):
        seen, level = {start: 0}, [start]
        for depth in range(1, most + 1):
            level = [y for y in {y for x in level for y in near[x]} if y not in seen]
            seen |= dict.fromkeys(level, depth)
        return {n: k for n, k in seen.items() if k}

    inverse = {(k, n, depth) for k in keys for n, depth in hops(back, k, 3).items()}
    assert {(r.start, r.node, r.depth) for r in QUERIES["bfs_inverse"](spark, str(tmp_path)).collect()} == inverse

    cheapest = {}
    for k in keys:
        heap = [(0.0, k)]
        while heap:
            cost, n = heapq.heappop(heap)
            if (k, n) not in cheapest:
                cheapest[k, n] = round(cost, 6)
                for m, w in out[n].items():
                    heapq.heappush(heap, (cost + w, m))
    assert {(r.start, r.node): r.cost for r in QUERIES["shortest_path"](spark, str(tmp_path)).collect()} == pytest.approx(cheapest)

    want, far = defaultdict(list), 0
    for k in keys:
        for n, depth in hops(both, k, 5).items():
            delta = 900 * k // 4000 / 100 * 0.5**depth
            if delta >= 0.01:
                want[n].append(delta)
                far += depth > 3
    got = {r.node: (r.delta, r.sources) for r in QUERIES["contradiction_propagation"](spark, str(tmp_path)).collect()}
    assert far and set(got) == set(want)
    assert all(got[n] == (pytest.approx(sum(x), abs=1e-6), len(x)) for n, x in want.items())


def test_auto_approve_at_its_thresholds(spark, tmp_path):
    """Files whose confidence is .90 or .70 exactly, whatever their number of lines."""
    rows = []
    for file, (n, new) in enumerate([(n, part * n // 4) for n in range(4, 84, 4) for part in (1, 3)]):
        rows += [(file, k, file, 1, "N", "O", 0.06 if k < new else 0.01, 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string, l_discount double, l_extendedprice double")
    df.selectExpr("*", "timestamp '2024-01-01' as l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/out")
    next(tmp_path.glob("out/*.parquet")).rename(tmp_path / "lineitem.parquet")
    got = QUERIES["auto_approve"](spark, str(tmp_path))
    assert {r.verdict: r.files for r in got.collect()} == {"approve": 20, "review": 20}
    assert oracle.differences(got, oracle.connect(str(tmp_path)), ORACLES["auto_approve"]) == ""


def test_cycle_safe_insert_sends_no_closure_to_all(spark):
    """The planner takes the rows of a search for few; none of them is broadcast."""
    assert "Broadcast" not in QUERIES["cycle_safe_insert"](spark, SF)._jdf.queryExecution().executedPlan().toString()
