"""Quality, packing, toxicity, licences, mixing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import license_scan, mixing, packing, quality, toxicity
from orrery.llm.bpe import WordBpe
from orrery.llm.common import text_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(cover)}
    out["base_failed"] = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    bad = out["n_symbols"] > 0.1 * len(w)
    for n, share in ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)):
        s, hit = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in s:
                hit |= set(range(k, k + n))
            s.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(w[k]) for k in hit)
        bad |= out[f"dup_{n}gram_chars"] > share * out["word_chars"]
    seen, out["dup_line_chars"] = set(), 0
    for line in t.split("\n"):
        if line in seen:
            out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
        seen.add(line)
    out["kept"] = not (bad or out["dup_line_chars"] > 0.2 * out["word_chars"] or out["base_failed"])
    return out


def test_quality_equals_brute_force(docs, no_docs):
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text)
    got = quality.repetition_quality(docs, slab=3000).collect()
    assert len(got) == docs.count()
    for r in got:
        want = brute_quality(text[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.kept for r in got)
    assert quality.repetition_quality(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_quality_verdicts(spark):
    """What each rule rejects beyond the base rule, and clean texts that stay."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    long, line = text(60), text(40)
    rows = {"clean": text(300), "symbols": text(100) + " ##" * 20, "passage": text(200) + " " + long + " " + text(30) + " " + long, "lines": f"{line}\n{text(90)}\n{line}\n", "short": text(49), "sentence twice": f"{line[:40]}. {text(300)} {line[:40]}."}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows.values())], "doc_id bigint, Text string")
    got = {name: r for name, r in zip(rows, sorted(quality.repetition_quality(docs.withColumnRenamed("Text", "text")).collect()))}
    assert [n for n in rows if got[n].kept] == ["clean", "sentence twice"]
    assert [n for n in rows if got[n].base_failed] == ["short"]
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [0, 5]


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_library(vocabulary):
    bpe = WordBpe(vocabulary)
    texts = ["", None, "Hello WORLD don't 'S it's", "a <|endoftext|> b", "İstanbul ΣΑΣ café cafe\u0301", "a\x1cb\x85c d", "12 345x6", "!!!'s ''ll ...'t", "y" * 5000, "ß ÿ × ÷ «a» ª µ 日本語", "\x00\x01 a\x7f_b\n\n\tc'"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcÀéÑ .,'!<|0123\n\u0301€") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    ids, per = bpe.encode(*text_buffers(pa.array(texts, pa.string())))
    at = 0
    for t, n in zip(texts, per):
        assert ids[at : at + n].tolist() == bpe.library.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += n


def test_plan_is_whole_and_tight():
    for seed in range(60):
        rng = random.Random(seed)
        cap = rng.choice([8, 16, 64, 128])
        hist = {n: rng.randint(1, 40) for n in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 12)))}
        plan = packing.minimum_bin_slack(hist, cap)
        pieces, fill = defaultdict(list), defaultdict(list)
        for length, a, b, start, size, seq, copies, off, before in plan.rows:
            for r in range(a, b):
                t = r - a + before
                pieces[length, r].append((start, size))
                fill[seq + t // copies].append((off + t % copies * size, size))
        assert set(pieces) == {(n, r) for n, c in hist.items() for r in range(c)}
        for (n, _), p in pieces.items():
            end = 0
            for s, z in sorted(p):
                assert s == end
                end += z
            assert end == n
        assert sorted(fill) == list(range(plan.sequences))
        for p in fill.values():
            end = 0
            for s, z in sorted(p):
                assert s == end
                end += z
            assert end == cap or end & (end - 1) == 0


def test_best_subset():
    assert packing.best_subset(10, [(7, 1), (4, 2), (3, 1)]) == {7: 1, 3: 1}
    assert packing.best_subset(9, [(5, 1), (2, 1)]) == {5: 1, 2: 1}
    assert packing.best_subset(3, [(5, 1)]) == {}


def test_packing_round_trip(docs, no_docs, vocabulary):
    bpe = WordBpe(vocabulary)
    got = packing.pack_sequences(docs, vocabulary, capacity=256).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array(bpe.library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    seqs, by = defaultdict(list), defaultdict(list)
    for p in got:
        seqs[p.sequence_id].append((p.offset, p.length))
        by[p.doc_id].append(p)
        whole = ids[p.doc_id][0]
        assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
    for i, copies in ids.items():
        assert sum(p.length for p in by[i]) == sum(map(len, copies))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 256 and (end == 256 or end & (end - 1) == 0)
    assert packing.pack_sequences(no_docs, vocabulary).count() == 0


def test_toxicity(spark, no_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 8 == 0
        w = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["idiot", "moron", "grobix" + rng.choice("abc")])
        rows.append((k, " ".join(w) + ".", "x"))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "you idiot", "x"), (1002, "w " * 30000 + "idiot", "x"), (3, rows[3][1], "x")]
    labels += [(None, 1, 1), (5, None, None), (77777, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_report(docs, lab).collect()
    assert len(got) == len(rows)
    known = {i: t for i, _, t in labels[:400]}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_report(no_docs.select("doc_id", "text"), lab).count() == 0
    # Without labels the seed words remain.
    assert {r.predicted for r in toxicity.toxicity_report(docs, lab.where("false")).where("doc_id = 1001").collect()} == {0}


def test_grammar():
    score = lambda t: toxicity.features(*text_buffers(pa.array([t])), toxicity.Lexicon.build({}))[0, 1]
    assert score("you idiot") > score("an idiot") > score("he said idiot") > score("not an idiot") > 0
    assert score("this is not so. an idiot") == score("an idiot")
    assert score("I will kill you") > score("you will be killed") > score("kill the process") > 0
    assert score("idiot, someone said") == score("someone said idiot") < score("idiot")
    assert score("don't be an idiot") == score("don’t be an idiot") == score("not an idiot")
    assert score("idiots") == score("idiot") and score("stupid idiot") > 2 * score("idiot")
    assert score("idiot you") > score("an idiot")
    assert score("nothing here") == 0


def test_composition_equals_single_transducers():
    """Composed tables give what each transducer gives on its own, both ways."""
    rng = random.Random(6)
    for _ in range(300):
        symbols = [rng.randrange(1, 7) for _ in range(rng.randint(0, 12))]
        weights = [rng.uniform(1, 5) for _ in symbols]
        factor = [1.0] * len(symbols)
        for parts, order in ((toxicity.FORWARD, range(len(symbols))), (toxicity.BACKWARD, range(len(symbols) - 1, -1, -1))):
            for t in parts:
                state = 0
                for k in order:
                    state, f = t.arcs.get((state, symbols[k]), (state, 1.0))
                    factor[k] *= f
        want = sum(w * f for s, w, f in zip(symbols, weights, factor) if s in (toxicity.INSULT, toxicity.THREAT))
        assert abs(toxicity.read_clause(symbols, weights) - want) < 1e-9


def test_licences(docs, no_docs, spark):
    extra = [(900, "Copyright (c) 2020 A\n" + license_scan.KNOWN[0][1].replace("software", "SOFTWARE"), None), (901, "Text\nReleased  under the MIT Licence!\nmore", None), (902, None, None)]
    both = docs.select("doc_id", "text", "cls").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, cls string"))
    got = {r.doc_id: r for r in license_scan.license_scan(both).collect()}
    assert got[900].license == "MIT" and got[901].license is None and got[901].notices == "MIT" and got[901].n_notices == 1 and got[902].license is None
    assert license_scan.license_scan(no_docs).count() == 0
    documents = both.where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas()  # noqa: F841  read by the SQL
    want = {r[0]: r[1:] for r in duckdb.sql(license_scan.oracle()).fetchall()}
    for i, w in want.items():
        assert (got[i].digest, got[i].license, got[i].n_notices, got[i].notices) == w


def test_whole_licence_files(spark):
    from pathlib import Path

    folder = Path(license_scan.__file__).parent / "licenses"
    owner = "Copyright (c) 2020 X"
    files = {}
    for path in sorted(folder.glob("*.txt")):
        titles, body, *rest = path.read_text().split("\n%%\n")
        head = titles.split("\n%\n")[0]
        files[path.stem] = f"{head}\n\n{owner}\n\n{body}\n" + "".join(rest)
        files[path.stem + "+"] = f"{owner}\nAll rights reserved.\n\n{body}"
        files[path.stem + "-"] = f"{head}\n\n{owner}\n\n" + "\n\n".join(" ".join(p.split()) for p in body.split("\n\n"))  # not wrapped
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0"} <= set(files)
    wrapped = "ISC License\n\nCopyright 2020 X\n\n" + license_scan.KNOWN[1][1].replace("above copyright", "above\ncopyright")
    files |= {"ISC!": wrapped, "My-1.0": "My own licence.\nDo what you like."}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(files.values())], "doc_id bigint, text string")
    mine = license_scan.text_digests(spark.createDataFrame([("My-1.0", "My own license. Do what you like!")], "license string, text string"))
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs, mine).collect()}
    wrong = {name: got[k] for k, name in enumerate(files) if got[k] != name.rstrip("+-!").split("~")[0]}
    assert not wrong
    assert license_scan.license_scan(docs).where("license is null").count() == 1


def brute_mix(rows, mix):
    tok, src = Counter(), {}
    for i, t, s in rows:
        tok[i] = len(WORD.findall(t or ""))
        src[i] = s or ""
    size = Counter()
    for i, t, s in rows:
        size[s or ""] += len(WORD.findall(t or ""))
    total = sum(size.values())
    share = {s: v / total for s, v in size.items() if v}

    def repeats(a):
        w = [p ** (a - 1) for p in share.values()]
        return max(w) / min(w) if mix.keep_all else max(w) / sum(p**a for p in share.values())

    low, high = 0.0, 1.0
    if repeats(0) <= mix.repeats:
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= mix.repeats else (mid, high)
    z = sum(p**high for p in share.values())
    budget = total * z / min(p ** (high - 1) for p in share.values()) if mix.keep_all else total
    return {s: p**high / z * budget / size[s] for s, p in share.items()}


@pytest.mark.parametrize("keep_all", [False, True])
def test_mixing(docs, no_docs, keep_all):
    mix = mixing.Mix(repeats=1.5, keep_all=keep_all)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    passes = brute_mix(rows, mix)
    got = mixing.mix_schedule(docs, mix).collect()
    assert all(0 <= r.position < 1 for r in got)
    size, used = Counter(), Counter()
    for _, t, s in rows:
        size[s or ""] += len(WORD.findall(t or ""))
    for r in got:
        used[r.source] += r.tokens
    biggest = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    for s, p in passes.items():
        assert used[s] <= p * size[s] + 1e-3 + 1 and used[s] > p * size[s] - 2 * biggest
    if keep_all:
        assert {r.doc_id for r in got} == {i for i, t, s in rows}
    out = mixing.mix_documents(docs, mix)
    assert out.columns == docs.columns
    place = {(r.doc_id, r.epoch): r.position for r in got}
    order = sorted(place, key=place.get)
    ids = [r.doc_id for r in out.collect()]
    plain = [i for i in ids if i is not None and i != 12]  # the fixture's repeated id and null id come twice
    assert plain == [i for i, _ in order if i is not None and i != 12]
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got)
    assert mixing.mix_schedule(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def test_mixing_entropy(spark):
    shares = spark.createDataFrame([(0.5,), (0.3,), (0.2,)], "share double")
    a = mixing.exponent(shares, mixing.Mix(entropy=0.97, repeats=None), 1.0)
    p = np.array([0.5, 0.3, 0.2]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.97) < 1e-6


def test_shuffled_key_matches_md5(spark):
    row = spark.range(7, 8).select(mixing._key(F.col("id"), "mix").alias("k")).first()
    assert row.k == int(hashlib.md5(b"mix:7").hexdigest()[:15], 16)
