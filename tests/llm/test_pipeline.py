"""The pipeline, each stage against a brute-force version on the rows that the one before kept."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import roots
from test_text_ops import brute_mix, brute_quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghijklmé") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    shared = " ".join(words(40))
    rows, base = [], words(150)
    for k in range(8):  # near copies of one text
        w = list(base)
        w[rng.randrange(150)] = f"edit{k}"
        rows.append((k, " ".join(w), "big"))
    for k in range(10, 30):
        rows.append((k, " ".join(words(rng.randint(60, 200))) + (" " + shared if k % 2 else ""), "big" if k < 25 else "small"))
    rows += [(40, "too short", "big"), (41, "again and again " * 60, "big"), (42, " ".join(words(80)) + " ###" * 40, "small"), (43, None, "big"), (44, "", None)]
    rows += [(50, " ".join(words(70)), None), (51, rows[9][1], "small"), (None, " ".join(words(90)), "small")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def brute_stages(rows):
    kept = [r for r in rows if brute_quality(r[1])["kept"]]
    yield kept
    sets = {}
    for i, t, *_ in kept:
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = [i for i in sets if i is not None]
    root = roots([(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], ids)
    kept = [r for r in kept if r[0] is None or root[r[0]] == r[0]]
    yield kept
    seen, out = set(), []
    for r in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        raw = r[1].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    yield out + [r for r in kept if r[0] is None]


def test_stages_equal_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("public_tokenizers")
    from orrery.llm.bpe import WordBpe
    from orrery.llm.common import keep

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for (name, stage), want in zip(pipeline.STAGES[:3], brute_stages(rows)):
        docs = keep(stage(spark, docs, str(tmp_path)), "test")
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        sizes.append(len(want))
    assert len(rows) > sizes[0] > sizes[1] == sizes[2]  # each filter has something to do, and clean documents stay

    before = [tuple(r) for r in docs.collect()]
    passes = brute_mix([(i, t, s) for i, t, _, s, _ in before], pipeline.MIX)
    mixed = keep(pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "test")
    copies = Counter(map(tuple, mixed.collect()))
    assert set(copies) == set(before)
    used, size = Counter(), Counter()
    for r in before:
        n = len(r[1].split())
        used[r[3] or ""] += copies[r] * n
        size[r[3] or ""] += n
        p = passes[r[3] or ""]
        assert int(p + 1e-9) <= copies[r] <= int(p) + 1
    assert all(used[s] <= passes[s] * size[s] + 1 for s in size)

    path = tokenizers.path("word_bpe_49k.json")
    bpe = WordBpe(path)
    want = Counter()
    for r, n in copies.items():
        want[r[0], len(bpe.library.encode(r[1], add_special_tokens=False).ids) + 1] += n
    pieces = pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    got, fill = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        fill[p.sequence_id].append((p.offset, p.length))
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0)

    final = Counter((r.doc_id, r.doc_tokens) for r in pipeline.run(spark, str(tmp_path)).collect() for _ in range(r.length))
    assert final == got
