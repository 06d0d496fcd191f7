"""Vectors, URLs and archives against brute force, and the pipeline on a small table."""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import near_vectors, url_filter, warc
from orrery.llm.common import work_dir


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        base = rng.normal(size=32)
        for j in range(5):
            other = rng.normal(size=32)
            c = rng.uniform(0.85, 0.99)
            other -= other @ base / (base @ base) * base
            other *= np.linalg.norm(base) / np.linalg.norm(other)
            rows.append((k * 10 + j, (c * base + math.sqrt(1 - c * c) * other).tolist(), j))
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] + [1.0] * 31, 0), (1003, [None] + [1.0] * 31, 0), (1004, [], 0), (1005, [1.0, 2.0, 3.0], 0), (1006, [2.0, 4.0, 6.0], 0), (None, rows[0][1], 0), (1007, rows[0][1], 0), (1008, rows[0][1], 1), (1009, [float("inf")] + [1.0] * 31, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, weight int").repartition(3)
    for chunk in (512, 2):
        got = {r.vec_id: r for r in near_vectors.near_vectors(df, chunk=chunk).collect()}
        ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
        links = defaultdict(set)
        for a, x in ok:
            for b, y in ok:
                if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links[a].add(b)
                    links[b].add(a)
        want, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
        assert found >= 0.97 * want and all(got[i].n_links <= len(links[i]) for i, _ in ok)
        assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1009, None))
        assert got[1006].component_id == 1005 and got[1007].component_id == got[0].component_id and not got[1008].kept
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_float_vectors_link_as_their_doubles(spark):
    """A float column is compared in double precision, whatever width its vectors travel in."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 24))
    x = np.concatenate([x, x + 0.45 * rng.standard_normal(x.shape), x[:5]]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df).collect()}
    wide = near_vectors.near_vectors(df.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding"))
    assert got == {r.vec_id: r.n_links for r in wide.collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    assert true.sum() > 40 and all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum()


def test_vectors_of_any_magnitude_and_rare_sizes(spark, monkeypatch):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2e200, -1e200]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    links = lambda: {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df, chunk=2).collect()}
    want = {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
    assert links() == want
    monkeypatch.setattr(near_vectors, "MEASURED_SIZES", 1)
    assert links() == want


def test_hadamard():
    x = np.eye(8)
    h = near_vectors.hadamard(x)
    assert np.allclose(h @ h.T, 8 * np.eye(8))


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute_urls(urls, rules, weight=4.0, least=8):
    """Rule, verdict by the same models in plain Python."""
    alphabet = url_filter.ALPHABET
    out, ruled = {}, {}
    for u in set(urls):
        host, path = brute_host(u)
        best = None
        for r in sorted(rules, key=lambda r: -len(r.pattern)):
            h, _, p = r.pattern.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                best = r
                break
        out[u] = (host, path, best)
        if best and u is not None:
            ruled[u] = best.verdict

    def grams(u):
        import re

        s = re.sub(r"^[^:/]*://", "", "".join(c.lower() if "A" <= c <= "Z" else c for c in u))
        s = "~~" + re.sub(r"[^a-z0-9./-]", "~", s)
        return [s[k : k + 3] for k in range(len(s) - 2)]

    n3 = {v: Counter() for v in ("allow", "block")}
    held = lambda u: hashlib.md5(u.encode()).hexdigest() < "3"
    for u, v in ruled.items():
        if not held(u):
            n3[v].update(grams(u))

    def logp(v, g):
        c = n3[v]
        total = sum(c.values())
        one = lambda f: sum(k for x, k in c.items() if f(x))
        p1 = (one(lambda x: x[2] == g[2]) + 1) / (total + len(alphabet))
        near, far = one(lambda x: x[1] == g[1]), one(lambda x: x[:2] == g[:2])
        p2 = p1 if near < least else (one(lambda x: x[1:] == g[1:]) + weight * p1) / (near + weight)
        return math.log(p2 if far < least else (c[g] + weight * p2) / (far + weight))

    score = lambda u: (lambda gs: sum(logp("allow", g) - logp("block", g) for g in gs) / len(gs) if gs else None)(grams(u))
    return out, ruled, score


def test_urls(spark):
    rng = np.random.default_rng(6)
    hosts = ["a.example.org", "example.org", "b.example.com", "notorg", "x.net", "EXAMPLE.ORG", "u:p@c.com:80"]
    paths = ["", "/", "/es/1", "/en/17", "/fr/2", "/de/3?x=1", "#t", "?q", "/EN/1"]
    rows = [(k, f"http://{hosts[rng.integers(len(hosts))]}{paths[rng.integers(len(paths))]}{'' if k % 3 else k}", "z") for k in range(150)]
    rows += [(200, None, "z"), (201, "", "z"), (202, "no scheme", "z"), (203, "a://", "z"), (None, "http://q.net/1", "z"), (3, rows[3][1], "z"), (204, "http://a://b.org/x", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, score string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows)
    want, ruled, score = brute_urls([u for _, u, _ in rows], url_filter.RULES)
    url_of = dict((i, u) for i, u, _ in rows)
    open_scores = {}
    for r in got:
        host, path, rule = want[url_of[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        if rule:
            assert r.verdict == rule.verdict
        elif r.score is not None:
            assert abs(r.score - score(url_of[r.page_id])) < 1e-9
            open_scores[r.score] = r.verdict
        else:
            assert r.verdict == "allow"
    allowed, blocked = [s for s, v in open_scores.items() if v == "allow"], [s for s, v in open_scores.items() if v == "block"]
    assert not allowed or not blocked or min(allowed) > max(blocked)
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_archive_round_trip(spark):
    rows = [(1, "http://a", "same", 1), (2, "http://b\r\nX: y", "same", 1), (3, None, None, 1), (4, "u", "", 1), (5, "u", "é" * 5000, 1), (6, "u", "one", 1), (None, "u", "same", 1), (6, "u", "one", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(3)
    for least in (0, 4):
        path = f"{work_dir(spark)}/warc-test-{uuid.uuid4().hex}"
        warc.write_archive(df, path, least_bytes=least)
        got = warc.read_archive(spark, path).collect()
        assert len(got) == len(rows)
        top = {}
        for i, _, h, _ in rows:
            top[h or ""] = max(top.get(h or "", -1), i if i is not None else -1)
        html = {i: (h or "") for i, _, h, _ in rows}
        for r in got:
            body = html[r.page_id].encode()
            first = r.page_id == top[html[r.page_id]] or len(body) < least
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", top[html[r.page_id]]))
        for r in warc.rebuild_records(spark, path).collect():
            head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
            assert rest[:-4] in (b"", html[r.page_id].encode())
        # Bytes are stored once.
        assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h, _ in rows})
    path = f"{work_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_archive(df.where("false"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_pipeline_stages(spark, docs, no_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    from orrery.llm.common import keep

    names = [n for n, _ in pipeline.STAGES]
    assert len(names) in (4, 5)
    for start in (docs, no_docs):
        rows = start
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = keep(stage(spark, rows, ""), "pipeline-test")
            if k < len(names) - 1:
                assert out.columns == start.columns, name
            rows = out
        if start is no_docs:
            assert rows.count() == 0
        else:
            assert rows.count() > 0
