"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, batch string, cls string, component_id bigint, copies int, tokens string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def make_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[tuple[int | None, str | None]] = [(0, ""), (1, None), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "one TWO"), (6, "One\ttwo"), (7, "x" * 50_000), (8, "a a a a a a a a a a a a")]
    base = words(rng, 120)
    passage = " ".join(words(rng, 60))
    for k in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 9))
        texts.append((10 + k, " ".join(w)))
    for k in range(10):
        texts.append((40 + k, " ".join(words(rng, rng.randint(3, 90))) + " " + passage + "\n" + " ".join(words(rng, 30))))
    texts += [(60, texts[10][1]), (61, texts[10][1]), (62, passage), (63, passage.upper()), (None, passage), (70, "é" * 99 + "ü" * 60), (71, "é" * 99 + "ü" * 60)]
    texts += [(80, " ".join(words(rng, 6000))), (81, "line one\nline one\nline one\n" * 10), (82, "*** $$$ | a | b\n" * 30)]
    out = []
    for k, (i, t) in enumerate(texts):
        out.append((i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if k % 4 == 0 else len(t or ""), k, "b", None, 3, 1, "t"))
    out.append(out[11])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
