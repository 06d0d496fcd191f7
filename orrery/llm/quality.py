"""Quality rules by repetition coverage.

Words and lines of a run of documents are hashed once; n-gram hashes roll over the
word hashes. An n-gram of a document is duplicated if it occurs there twice, and
its coverage is the share of the document's word characters inside any of its
repeats (occurrences after the first). Line coverage counts repeats of whole lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_map, slabs, text_buffers

U = np.uint64


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares that a kept document may have: of word characters inside repeats, by n-gram
    length and in lines (published values), and of symbols to words."""

    grams: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    lines: float = 0.20
    symbols: float = 0.10
    least_words: int = 50
    repeat_percent: int = 50


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first) for each key of a document; doc ascends."""
    order = np.argsort(key ^ grams.mix(doc.astype(np.uint64)), kind="stable")
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    later = np.zeros(len(key), bool)
    twice = np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def _covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside windows of ``width`` that begin at the marked words."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    edge[at] += 1
    np.subtract.at(edge, at + width, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts per document; see ``repetition_quality``."""
    n_docs = len(offs) - 1
    per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
    solid = ~grams.WHITE[data]
    point = solid & ((data & 0xC0) != 0x80)
    out = {"word_chars": per_doc(point), "n_symbols": per_doc(SYMBOLS[data])}
    chars_to = np.concatenate([[0], np.cumsum(point)])

    h, start, end, doc = grams.words(data, offs)
    m = len(h)
    out["n_words"] = np.bincount(doc, minlength=n_docs)
    size = chars_to[end] - chars_to[start]
    rolled, width = h, 1
    for n, _ in ((3, None), *rules.grams):
        while width < n and len(rolled):
            rolled = rolled[:-1] * U(0x9FB21C651E98DF25) + h[width:] if len(rolled) > 1 else rolled[:0]
            width += 1
        k = len(rolled)
        inside = doc[:k] == doc[n - 1 :] if k else np.zeros(0, bool)
        twice, later = _repeats(grams.mix(rolled[inside]), doc[:k][inside])
        marks = np.zeros(k, bool)
        if n == 3:
            marks[inside] = twice
            out["n_repeat_words"] = np.bincount(doc[_covered(marks, n, m)], minlength=n_docs)
        else:
            marks[inside] = later
            hit = _covered(marks, n, m)
            out[f"dup_{n}gram_chars"] = np.bincount(doc[hit], weights=size[hit], minlength=n_docs).astype(np.int64)

    full = np.flatnonzero(np.diff(offs))
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([offs[:-1][full], breaks + 1])
    line_doc = np.concatenate([full, np.searchsorted(offs, breaks, "right") - 1])
    order = np.lexsort((first, line_doc))
    first, line_doc = first[order], line_doc[order]
    last = np.minimum(offs[line_doc + 1], np.append(first[1:] - 1, len(data)) if len(first) else first)
    # The line after a document's last break ends with the document.
    if len(first):
        ends_doc = np.append(line_doc[1:] != line_doc[:-1], True)
        last = np.where(ends_doc, offs[line_doc + 1], last)
    chars = chars_to[last] - chars_to[first]
    has = chars > 0
    first, last, line_doc, chars = first[has], last[has], line_doc[has], chars[has]
    hashes = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # prefix sums over about a megabyte of lines at a time
        stop = max(at + 1, int(np.searchsorted(last, first[at] + (1 << 20), "right")))
        base = int(first[at])
        hashes[at:stop] = grams.slice_hashes(grams.prefix_sums(data[base : int(last[stop - 1])]), first[at:stop] - base, last[at:stop] - base)
        at = stop
    _, later = _repeats(hashes, line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=chars[later], minlength=n_docs).astype(np.int64)

    words, word_chars = out["n_words"], out["word_chars"]
    out["base_failed"] = (words < rules.least_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * words)
    good = (out["dup_line_chars"] <= rules.lines * word_chars) & (out["n_symbols"] <= rules.symbols * words)
    for n, share in rules.grams:
        good &= out[f"dup_{n}gram_chars"] <= share * word_chars
    out["kept"] = good & ~out["base_failed"]
    return out


def _columns(rules: RepetitionRules) -> list[tuple[str, str]]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [*(f"dup_{n}gram_chars" for n, _ in rules.grams), "dup_line_chars"]
    return [*((x, "long") for x in names), ("base_failed", "boolean"), ("kept", "boolean"), *((x, "long") for x in more)]


def _measure_rows(rules: RepetitionRules, slab: int):
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([("doc_id", pa.int64()), *((n, kinds[k]) for n, k in _columns(rules))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offs = text_buffers(rows.column(1))
            for lo, hi, part, at in slabs(data, offs, slab):
                got = measure(part, at, rules)
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(lo, hi - lo), *(pa.array(got[n], kinds[k]) for n, k in _columns(rules))], schema=schema)

    return run


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), slab: int = 2 << 20) -> DataFrame:
    """Repetition measures and verdict of every text.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Returns doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 3-word windows that
    the text has twice or more), base_failed (too few words, or too large a share of
    them repeated), kept, and the characters inside duplicated n-grams and lines that
    the verdict weighs, as it does symbols to words. One row per
    input row, null ids and repeated rows included; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *(f"{n} {k}" for n, k in _columns(rules))])
    return arrow_map(base, _measure_rows(rules, slab), schema)


def _keep_rows(rules: RepetitionRules, text_at: int, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offs = text_buffers(rows.column(text_at))
            verdict = [measure(part, at, rules)["kept"] for _, _, part, at in slabs(data, offs, slab)]
            if verdict:
                yield rows.filter(pa.array(np.concatenate(verdict)))

    return run


def keep_good(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), slab: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns, without a shuffle.

    A null text is empty and goes, as it has too few words. The column of texts is found by
    name as Spark finds it, whatever the case of its letters.
    """
    at = [c.lower() for c in docs.columns].index("text")
    return arrow_map(docs, _keep_rows(rules, at, slab), docs.schema)
