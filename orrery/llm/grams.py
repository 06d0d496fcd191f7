"""Vectorised hashing of words, shingles and byte windows over runs of texts.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomial sums over a random
byte table, finished by a bijective mixer; powers of an odd base are invertible
modulo 2**64, so any slice's hash comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


#: Two independent kinds of hash: base, its inverse, and a value for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_UNBASES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_TABLES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * U(x)) for x in (0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD))
_POWERS: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        seed = np.full(size, base, np.uint64)
        seed[0] = 1
        have = np.multiply.accumulate(seed)
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """n + 1 prefix sums of table[byte] * base**position."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLES[kind][data] * powers(_BASES[kind], len(data)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair, equal for equal bytes."""
    inv = powers(_UNBASES[kind], len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * U(0x94D049BB133111EB))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width``-byte window of ``data``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    return mix((sums[width:] - sums[:-width]) * powers(_UNBASES[0], n))


def words(data: np.ndarray, offs: np.ndarray, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document) of each word, in order.

    Byte-level arrays are built for about ``piece`` bytes at a time, so a very
    long text costs memory for its words only.
    """
    n = len(data)
    starts, ends, hashes = [], [], []
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    lo = 0
    while lo < n:
        hi = min(n, lo + piece)
        while hi < n and not (cut[hi] or WHITE[data[hi]]):
            step = min(n, hi + 4096)
            stop = np.flatnonzero(WHITE[data[hi:step]] | cut[hi:step])
            hi = hi + int(stop[0]) if len(stop) else step
        part = data[lo:hi]
        solid = ~WHITE[part]
        edge = cut[lo : hi + 1]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = solid[:-1]
        s = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = solid[1:]
        e = np.flatnonzero(solid & (~after | edge[1:])) + 1
        hashes.append(slice_hashes(prefix_sums(part), s, e))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not starts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    start, end = np.concatenate(starts), np.concatenate(ends)
    return np.concatenate(hashes), start, end, np.searchsorted(offs, start, "right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each ``width``-word shingle; a shorter text is one shingle."""
    m = len(hashes)
    out_h, out_d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m >= width:
        acc = np.zeros(m - width + 1, np.uint64)
        for k in range(width):
            acc = acc * U(0x9FB21C651E98DF25) + hashes[k : m - width + 1 + k]
        same = doc[: m - width + 1] == doc[width - 1 :]
        out_h, out_d = mix(acc[same] + U(width)), doc[: m - width + 1][same]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.empty(len(short), np.uint64)
        for x, (d, at) in enumerate(zip(short, first)):
            acc = U(count[d])
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count[d]]:
                    acc = acc * U(0x9FB21C651E98DF25) + h
            extra[x] = acc
        out_h = np.concatenate([out_h, mix(extra ^ U(0x5851F42D4C957F2D))])
        out_d = np.concatenate([out_d, short])
    return out_h, out_d
