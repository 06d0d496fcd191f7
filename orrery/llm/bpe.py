"""Token ids of a word-level BPE tokenizer file, vectorised over runs of texts.

The file is of the ``tokenizers`` library: NFC, white space to blanks, lower case;
pieces are contractions, letter runs, single digits and runs of other signs; each is
merged by rank, its last byte marked as a word end. Words of ASCII and Latin-1
letters take the vectorised path: equal pieces are merged once per run of texts, all
of a run's pieces side by side. Words with an apostrophe, ``<|`` or any other
character go through the library itself, each distinct word once.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from . import grams

U = np.uint64
_LETTER, _DIGIT, _SIGN, _BLANK, _HIGH = 1, 2, 3, 0, 4


def _byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBpe:
    """Tokenizer of one process; ``path`` is the tokenizer file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        model = json.loads(self.library.to_str())["model"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + model["end_of_word_suffix"]] for c in symbols], np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Open addressing: the slot of a pair is found by a few probes of a sparse table.
        self.bits = 18
        size = 1 << self.bits
        self.slot_key = np.full(size + 64, np.iinfo(np.uint64).max, np.uint64)
        self.slot_rank = np.full(size + 64, 1 << 30, np.int64)
        self.made = made
        self.probes = 1
        for rank, (k, at) in enumerate(zip(key.tolist(), self._slot(key).tolist())):
            step = 1
            while self.slot_key[at] != np.iinfo(np.uint64).max and self.slot_key[at] != k:
                at += 1
                step += 1
            if self.slot_key[at] != k:
                self.slot_key[at], self.slot_rank[at] = k, rank
                self.probes = max(self.probes, step)
        kind = np.full(256, _SIGN, np.uint8)
        kind[grams.WHITE] = _BLANK
        kind[ord("a") : ord("z") + 1] = _LETTER
        kind[ord("0") : ord("9") + 1] = _DIGIT
        kind[128:] = _HIGH
        self.kind = kind

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, 2**30 where there is none; a or b below 0 is no symbol."""
        key = (a.astype(np.uint64) << U(20)) | b.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.slot_key[at] == key, self.slot_rank[at], 1 << 30)
        for _ in range(1, self.probes):
            miss = np.flatnonzero((out == 1 << 30) & (self.slot_key[at] != np.iinfo(np.uint64).max))
            if not len(miss):
                break
            at[miss] += 1
            out[miss] = np.where(self.slot_key[at[miss]] == key[miss], self.slot_rank[at[miss]], 1 << 30)
        out[(a < 0) | (b < 0)] = 1 << 30
        return out

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge equal-length pieces (one per row of bytes): flat ids and their counts."""
        n, m = rows.shape
        sym = self.inner[rows]
        sym[:, -1] = self.final[rows[:, -1]]
        if m > 1:
            rank = np.full((n, m), 1 << 30, np.int64)
            rank[:, :-1] = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, m - 1)
            right = np.tile(np.arange(1, m + 1), (n, 1))
            left = np.tile(np.arange(-1, m - 1), (n, 1))
            live = np.arange(n)
            while len(live):
                at = rank[live].argmin(1)
                best = rank[live, at]
                go = best < 1 << 30
                live, at, best = live[go], at[go], best[go]
                if not len(live):
                    break
                nxt = right[live, at]
                after = right[live, nxt]
                sym[live, at] = self.made[best]
                sym[live, nxt] = -1
                rank[live, nxt] = 1 << 30
                right[live, at] = after
                inside = after < m
                left[live[inside], after[inside]] = at[inside]
                follow = np.where(inside, sym[live, np.minimum(after, m - 1)], -1)
                rank[live, at] = self.ranks(sym[live, at], follow)
                before = left[live, at]
                has = before >= 0
                rank[live[has], before[has]] = self.ranks(sym[live[has], before[has]], sym[live[has], at[has]])
        kept = sym >= 0
        return sym[kept], kept.sum(1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's count."""
        n_docs = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
        low = grams.LOWER[data]
        kind = self.kind[low]
        # Two-byte Latin-1 letters: C3 80..BF but for the signs 97 and B7.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        capital = lead[(data[lead + 1] <= 0x9E)]
        low[capital + 1] += 0x20
        start_of_doc = np.zeros(len(data) + 1, bool)
        start_of_doc[offs] = True
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new |= start_of_doc[:-1]
        piece = np.flatnonzero(new)
        end = np.append(piece[1:], len(data))
        solid = kind[piece] != _BLANK
        # Words (between blanks) that the library has to see.
        odd = (kind == _HIGH) | (data == ord("'")) | ((data >= 0x1C) & (data <= 0x1F))
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        slow_words: list[tuple[int, int]] = []
        if odd.any():
            blank = kind == _BLANK
            word_new = ~blank
            word_new[1:] &= blank[:-1] | start_of_doc[1:-1]
            word = np.cumsum(word_new) - 1
            bad = np.unique(word[odd])
            is_bad = np.zeros(int(word[-1]) + 2, bool)
            is_bad[bad] = True
            inside = is_bad[word[piece]] & solid
            solid &= ~inside
            ws = np.flatnonzero(word_new)
            we = np.flatnonzero(~blank & np.append(blank[1:] | start_of_doc[1:-1], True)) + 1
            slow_words = list(zip(ws[bad].tolist(), we[bad].tolist()))
        p, e = piece[solid], end[solid]
        size = e - p
        sums = grams.prefix_sums(low)
        _, first, inv = np.unique(grams.slice_hashes(sums, p, e), return_index=True, return_inverse=True)
        up, us = p[first], size[first]
        flat: list[np.ndarray] = []
        count = np.zeros(len(first), np.int64)
        place = np.zeros(len(first), np.int64)
        filled = 0
        by = np.argsort(us, kind="stable")
        lengths, at = np.unique(us[by], return_index=True)
        for m, a, b in zip(lengths.tolist(), at.tolist(), [*at[1:].tolist(), len(by)]):
            for lo in range(a, b, max(1, (1 << 21) // max(1, m * 8))):
                who = by[lo : min(b, lo + max(1, (1 << 21) // max(1, m * 8)))]
                if m > 4096:  # a run of letters this long is rare: leave it to the library
                    got = [np.array(self.library.encode(low[s : s + m].tobytes().decode(), add_special_tokens=False).ids, np.int64) for s in up[who].tolist()]
                    ids, c = np.concatenate(got), np.array([len(g) for g in got])
                else:
                    ids, c = self.merge(low[up[who][:, None] + np.arange(m)])
                count[who] = c
                place[who] = filled + np.cumsum(c) - c
                filled += len(ids)
                flat.append(ids)
        where, c, src = p, count[inv], place[inv]
        if slow_words:
            text = {(s, t): data[s:t].tobytes().decode("utf-8", "replace") for s, t in slow_words}
            distinct = sorted(set(text.values()))
            got = {w: x.ids for w, x in zip(distinct, self.library.encode_batch_fast(distinct, add_special_tokens=False))}
            spot = {}
            for w in distinct:
                spot[w] = filled
                flat.append(np.array(got[w], np.int64))
                filled += len(got[w])
            where = np.concatenate([where, [s for s, _ in slow_words]])
            c = np.concatenate([c, [len(got[text[k]]) for k in slow_words]])
            src = np.concatenate([src, [spot[text[k]] for k in slow_words]])
            order = np.argsort(where, kind="stable")
            where, c, src = where[order], c[order], src[order]
        pool = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        total = int(c.sum())
        ids = pool[np.repeat(src - (np.cumsum(c) - c), c) + np.arange(total)] if total else np.zeros(0, np.int64)
        per = np.bincount(np.searchsorted(offs, where, "right") - 1, weights=c, minlength=n_docs).astype(np.int64)
        return ids, per
