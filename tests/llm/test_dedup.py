"""N-gram join and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from orrery.llm import ngram_join, suffix_dedup
from orrery.llm.components import components, local_roots


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_join(rows, width, num, den):
    sets = []
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, s))
    links = [(i, j) for x, (i, s) in enumerate(sets) for j, u in sets[:x] if s and u and den * len(s & u) >= num * len(s | u)]
    r = roots(links, {i for i, _ in sets})
    many = Counter(x for link in ((k, j) for k, (_, s) in enumerate(sets) for j, (_, u) in enumerate(sets[:k]) if s and u and den * len(s & u) >= num * len(s | u)) for x in link)
    return Counter((i, len(s), r[i], many[k]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_join_equals_brute_force(docs, width, num, den):
    got = ngram_join.ngram_jaccard_classes(docs, width=width, num=num, den=den, batch_bytes=4000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.where("doc_id is not null").collect())
    assert found == brute_join(rows, width, num, den)
    assert got.where("doc_id is null").count() == 1


@pytest.mark.parametrize("most_chunks,num", [(100, 90), (1, 90), (1, 70)])
def test_join_split_groups(docs, most_chunks, num):
    """Chunk pairs, or a join of postings in runs, cover what one task would."""
    small = ngram_join.ngram_jaccard_classes(docs, width=3, num=num, den=100, chunk_entries=60, most_chunks=most_chunks, posting_run=4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in small.where("doc_id is not null").collect()) == brute_join(rows, 3, num, 100)


def test_repeated_ids_with_other_texts(spark):
    """A text of a repeated id is kept or dropped on its own."""
    words = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(3, words[0]), (5, words[0] + " end"), (5, words[1]), (6, words[1]), (7, words[2]), (7, words[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = ngram_join.ngram_jaccard_classes(docs)
    assert Counter((r.doc_id, r.component_id, r.n_links) for r in classes.collect()) == Counter({(3, 3, 1): 1, (5, 3, 1): 1, (5, 5, 1): 1, (6, 5, 1): 1, (7, 7, 1): 2})
    assert Counter(map(tuple, ngram_join.keep_one_per_class(docs, classes).collect())) == Counter([rows[0], rows[2], rows[4]])


def test_verify_group_large_equals_small():
    rng = np.random.default_rng(0)
    base = np.arange(1000, 1080, dtype=np.uint64)
    sets, n = [], []
    for _ in range(70):
        s = np.sort(rng.choice(base, size=rng.integers(60, 80), replace=False))
        sets.append(s)
        n.append(len(s))
    n = np.array(n)
    links, linked = ngram_join.verify_group(n, sets, np.zeros(70, int), np.full(70, 2), 80, 100)
    brute = [(i, j) for i in range(70) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert roots(links, range(70)) == roots(brute, range(70))
    assert linked.tolist() == [2 * sum(k in pair for pair in brute) for k in range(70)]


def test_keep_one(docs, no_docs):
    classes = ngram_join.ngram_jaccard_classes(docs, width=5, num=80, den=100)
    kept = ngram_join.keep_one_per_class(docs, classes)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in classes.where("doc_id is not null").collect()})
    assert ids.count(None) == 1
    assert ngram_join.ngram_jaccard_classes(no_docs).count() == 0


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        cover = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if w in seen:
                cover[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.setdefault(i, []).append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot,batch", [(1024, 1 << 20), (1, 3000)])
def test_suffix_equals_brute_force(docs, monkeypatch, hot, batch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    one = docs.dropDuplicates(["doc_id"])
    got = {}
    for r in suffix_dedup.suffix_dedup_report(one, batch_bytes=batch).where("doc_id is not null").collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_suffix(rows)


def test_suffix_repeated_rows_and_text(docs, no_docs):
    out = suffix_dedup.suffix_dedup_texts(docs)
    assert out.schema == docs.schema
    assert out.count() == docs.count()
    twice = [r.text for r in out.where("doc_id = 12").collect()]
    assert len(twice) == 2 and min(map(len, twice)) == 0  # of equal rows one stays
    assert suffix_dedup.suffix_dedup_report(no_docs).count() == 0
    assert suffix_dedup.suffix_dedup_texts(no_docs).columns == no_docs.columns


def test_suffix_texts_equal_brute_force(docs):
    one = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, (r.text or "").encode()) for r in one.collect()):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        want[i] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in suffix_dedup.suffix_dedup_texts(one, batch_bytes=2000).collect()} == want


@pytest.mark.parametrize("hot", [1024, 0])
def test_suffix_ties_do_not_depend_on_files(docs, spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    more = spark.createDataFrame([(11, docs.where("doc_id = 45").first().text), (11, docs.where("doc_id = 46").first().text)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    report = lambda n: Counter(map(tuple, suffix_dedup.suffix_dedup_report(both.repartition(n, "text"), batch_bytes=3000).collect()))
    assert report(1) == report(7)


def test_equal_suffixes_compares_bytes():
    """Runs with one sample but other bytes around it are told apart, padding included."""
    sample = bytes(range(65, 97))
    body = [b"ab" + sample + b"c" * 66, b"xb" + sample + b"c" * 66, b"ab" + sample + b"c" * 65 + b"d", b"ab" + sample + b"c" * 66]
    data = np.frombuffer(b"".join(body), np.uint8)
    at = np.arange(4) * 100
    run, number = suffix_dedup.equal_suffixes(data, at, np.ones(4, int), np.full(4, 2), 100)
    assert run.tolist() == [3] and number.tolist() == [0]


def test_long_document_spans_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = np.random.default_rng(1)
    part = "".join(map(chr, rng.integers(97, 123, 2500)))
    rows = [(1, part + "Q" * 300 + part[:900]), (2, part[500:1700] + "R")]
    got = {r.doc_id: [tuple(r)[1:]] for r in suffix_dedup.suffix_dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_suffix(rows)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    df = spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a bigint, b bigint").repartition(5)
    want = roots([p for p in pairs if p[0] != p[1]], {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.id: r.component for r in components(df).collect()} == want
    node, root = local_roots(np.array([5, 9, 9]), np.array([7, 7, 2]))
    assert dict(zip(node.tolist(), root.tolist())) == {2: 2, 5: 2, 7: 2, 9: 2}
    assert components(df.where("false")).count() == 0
