"""Removal of byte strings that occur earlier, by blockwise suffix sorting.

Every suffix is compared on its first ``length`` bytes. Sorting all of them would
hold a row per byte, so the sort is blockwise with a cover sample:

* The cover is content-defined: of each ``length``-byte window, the 32-byte string
  with the least hash (leftmost on ties) is sampled. As with an arithmetic
  difference cover, two suffixes that agree on ``length`` bytes share an offset at
  which both are sampled, but about 3 % of the positions are in it instead of the
  14 % that a difference cover of period 57 takes. Each sample stands for the run
  of suffixes that chose it.
* Sample strings are counted first, over all documents. Suffixes whose sample
  occurs once can't repeat and go no further.
* The rest go to suffix buckets by their sample. One bucket is held and sorted at a
  time: the samples are ranked by the bytes that follow them and by the bytes
  before them, with the lengths that neighbours share. A suffix that starts ``o``
  bytes before its sample equals another if their samples share ``o`` bytes to the
  left and ``length - o`` to the right, so ranks settle every tie, however long,
  and on bytes alone. The first in (doc_id, start) order of each equal run stays.
* A sample with very many contexts is not gathered in its bucket; its suffixes are
  dealt out one by one by a 128-bit digest of their bytes, after each run of
  documents has reduced equal ones to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_map, keep, rows_of, runs_by, settle, shuffle_width, slabs, small_batches, text_buffers

U = np.uint64
GRAM = 32
POS_BITS = 22
SEGMENT = 1 << 18
LEVEL = 3  # of zstd, for texts on their way
#: Context entries of one sample beyond which its suffixes are dealt out one by one.
HOT_CONTEXTS = 1024
#: Input bytes for each suffix bucket and for each task, about.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: Rows of texts or of bucket parts in one Arrow batch: about 20 MB at most.
BATCH_ROWS = 32

_BATCH = "batch long, size long, ids binary, offs binary, body binary, rest binary"
_BATCH_ARROW = pa.schema([("batch", pa.int64()), ("size", pa.int64()), *((x, pa.binary()) for x in ("ids", "offs", "body", "rest"))])
_WIRE = "part long, batch long, block int, a binary, b binary"
_WIRE_ARROW = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _emit(rows: list, schema: pa.Schema = _WIRE_ARROW) -> Iterator[pa.RecordBatch]:
    for x in range(0, len(rows), 128):
        cols = zip(*rows[x : x + 128])
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, its rows) from wire rows in block order; settled spans come one by one."""
    spans = iter(range(-1, -(1 << 62), -1))
    for key, rows in runs_by(rows_of(batches), lambda r: r[2] if r[2] >= 0 else next(spans)):
        yield max(key, -1), rows


def _bundle(batch_bytes: int):
    """Runs of whole documents as rows: ids, offsets, compressed bytes, other columns as Arrow IPC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        press = zstandard.ZstdCompressor(level=LEVEL)
        for rows in batches:
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = text_buffers(rows.column(1))
            rest = rows.select(list(range(2, rows.num_columns)))
            for lo, hi, part, at in slabs(data, offs, batch_bytes):
                number += 1
                sink = pa.BufferOutputStream()
                if rest.num_columns:
                    with pa.ipc.new_stream(sink, rest.schema) as w:
                        w.write_batch(rest.slice(lo, hi - lo))
                yield from _emit([(number, len(part), ids[lo:hi].tobytes(), at.tobytes(), press.compress(part.tobytes()), sink.getvalue().to_pybytes())], _BATCH_ARROW)

    return run


def cover(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover sample: (hash, position, first start, last start, document) per run of suffixes."""
    span = length - GRAM + 1
    parts = []
    for lo in range(0, max(0, len(data) - length + 1), SEGMENT):
        sub = data[lo : lo + SEGMENT + length - 1]
        h = grams.window_hashes(sub, GRAM)
        key = (h & ~U((1 << POS_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        low = key
        while reach * 2 <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        at = (low & U((1 << POS_BITS) - 1)).astype(np.int64)
        start = np.arange(len(at)) + lo
        doc = np.searchsorted(offs, start, "right") - 1
        whole = start + length <= offs[doc + 1]
        at, start, doc = at[whole], start[whole], doc[whole]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(at)) - 1
        parts.append((h[at[new]], at[new] + lo, start[new], start[last], doc[new]))
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Batch:
    """A bundle with its cover sample, in hash order of the samples."""

    def __init__(self, ids: bytes, offs: bytes, body: bytes, length: int):
        self.ids, self.offs = np.frombuffer(ids, np.int64), np.frombuffer(offs, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if self.offs[-1] else np.zeros(0, np.uint8)
        self.length = length

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(tag, rank) of each document: rows that share an id come in the order of a digest of their text, wherever they are stored."""
        sums = grams.prefix_sums(self.data)
        tag = (grams.slice_hashes(sums, self.offs[:-1], self.offs[1:]) >> U(40)).astype(np.int64)
        rank = np.empty(len(tag), np.int64)
        rank[np.lexsort((tag, self.ids))] = np.arange(len(tag))
        return tag, rank

    def sample(self):
        """Distinct samples: hashes, and the numbers of different contexts; keeps the runs."""
        h, pos, first, last, doc = cover(self.data, self.offs, self.length)
        h = grams.mix(h ^ U(0x2545F4914F6CDD1D))  # sampled hashes are small ones: mixed again, they fill the buckets evenly
        self.tag, rank = self.ranks()
        ctx = np.empty(len(h), np.uint64)
        for lo in range(0, len(h), 1 << 13):  # context hashes over about 300 KB at a time
            a, b = first[lo : lo + (1 << 13)], last[lo : lo + (1 << 13)] + self.length
            base = int(a.min())
            sums = grams.prefix_sums(self.data[base : int(b.max())])
            ctx[lo : lo + len(a)] = grams.slice_hashes(sums, a - base, b - base)
        ctx = grams.mix(ctx + (pos - first).astype(np.uint64))
        order = np.lexsort((first, rank[doc], ctx, h)) if len(h) else np.zeros(0, np.int64)
        self.hash, self.ctx, self.pos, self.first, self.last, self.doc = h[order], ctx[order], pos[order], first[order], last[order], doc[order]
        self.new_hash = np.concatenate([[True], self.hash[1:] != self.hash[:-1]]) if len(h) else np.zeros(0, bool)
        # Of equal contexts the first in (doc_id, text, start) order leads.
        self.lead = self.new_hash.copy()
        self.lead[1:] |= self.ctx[1:] != self.ctx[:-1] if len(h) else False
        starts = np.flatnonzero(self.new_hash)
        contexts = np.add.reduceat(self.lead.astype(np.int64), starts) if len(starts) else starts
        occurs = np.diff(np.append(starts, len(h)))
        return self.hash[starts], contexts, occurs

    def confirm(self) -> None:
        """Compare the bytes of runs that follow a leader with its bytes; those that differ lead themselves."""
        lead_of = np.maximum.accumulate(np.where(self.lead, np.arange(len(self.lead)), 0))
        rest = np.flatnonzero(~self.lead)
        for lo in range(0, len(rest), 1 << 13):
            mine = rest[lo : lo + (1 << 13)]
            its = lead_of[mine]
            size = self.last[mine] - self.first[mine] + self.length
            same = (size == self.last[its] - self.first[its] + self.length) & (self.pos[mine] - self.first[mine] == self.pos[its] - self.first[its])
            mine, its, size = mine[same], its[same], size[same]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            bad = self.data[np.repeat(self.first[mine], size) + step] != self.data[np.repeat(self.first[its], size) + step]
            self.lead[rest[lo : lo + (1 << 13)][~same]] = True
            if bad.any():
                self.lead[np.unique(np.repeat(mine, size)[bad])] = True


def _bounds(hashes: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _announce(length: int, bits: int):
    """Each batch's distinct samples with their context counts, to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, offs, body in rows_of(batches):
            h, contexts, _ = _Batch(ids, offs, body, length).sample()
            cut, n = _bounds(h, bits), np.minimum(contexts, 65535).astype("<u2")
            low = h & U((1 << 48) - 1)
            pack = lambda x: (x & U(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> U(32)).astype("<u2").tobytes()
            yield from _emit([(k, batch, k, pack(low[cut[k] : cut[k + 1]]), n[cut[k] : cut[k + 1]].tobytes()) for k in range(1 << bits) if cut[k + 1] > cut[k]])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each announced sample a byte: 0 occurs in this batch only, 1 in others too, 2 has very many contexts."""
    for block, held in _blocks(batches):
        rows = [r[1:2] + r[3:] for r in held]
        h = np.concatenate([np.frombuffer(a, "<u4", len(b) // 2).astype(np.uint64) | (np.frombuffer(a, "<u2", len(b) // 2, 2 * len(b)).astype(np.uint64) << U(32)) for _, a, b in rows])
        n = np.concatenate([np.frombuffer(b, "<u2").astype(np.int64) for _, _, b in rows])
        order = np.argsort(h, kind="stable")
        s = h[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        held = np.diff(np.append(starts, len(s)))
        total = np.add.reduceat(n[order], starts)
        flag = np.empty(len(s), np.uint8)
        flag[order] = np.repeat((held > 1).astype(np.uint8) + (total > HOT_CONTEXTS), held)
        cut = np.concatenate([[0], np.cumsum([len(b) // 2 for _, _, b in rows])])
        yield from _emit([(batch, batch, block, flag[cut[k] : cut[k + 1]].tobytes(), None) for k, (batch, _, _) in enumerate(rows)])


def _suffixes(length: int, bits: int):
    """Suffixes with repeated samples to their buckets; runs repeated inside the batch are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch, ids, offs, body, answers in rows_of(batches):
            x = _Batch(ids, offs, body, length)
            h, contexts, occurs = x.sample()
            x.confirm()
            mark = x.tag << 32  # a document's row number and digest in one number
            cut = _bounds(h, bits)
            flag = np.zeros(len(h), np.uint8)
            for answer in answers or ():
                flag[cut[answer["block"]] : cut[answer["block"] + 1]] = np.frombuffer(answer["a"], np.uint8)
            flag = np.repeat(np.where((flag == 0) & (contexts > 1), 1, flag), occurs)
            out = []
            settled = ~x.lead
            if settled.any():
                hit = np.stack([x.first[settled], x.last[settled] + length, x.doc[settled]], 1)
                out.append((batch, batch, -1, hit.astype("<i8").tobytes(), None))
            go = x.lead & (flag == 1)
            hs, pos, first, last, doc = x.hash[go], x.pos[go], x.first[go], x.last[go], x.doc[go]
            rim = _bounds(hs, bits)
            for k in range(1 << bits):
                a, b = rim[k], rim[k + 1]
                if b > a:
                    d = doc[a:b]
                    # start in the batch, suffixes, distance to the sample, id, row and digest
                    loc = np.stack([first[a:b], last[a:b] - first[a:b] + 1, pos[a:b] - first[a:b], x.ids[d], d | mark[d]], 1).astype("<i8")
                    text = b"".join(x.data[s : e + length].tobytes() for s, e in zip(first[a:b].tolist(), last[a:b].tolist()))
                    out.append((k, batch, k, press.compress(loc.tobytes()), press.compress(text)))
            yield from _emit(out)
            go = x.lead & (flag == 2)
            if go.any():
                first, last, doc = x.first[go], x.last[go], x.doc[go]
                size = last - first + 1
                start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                d = np.repeat(doc, size)
                w = np.empty((2, len(start)), np.uint64)
                by = np.argsort(start)
                for lo in range(0, len(start), 1 << 18):
                    p = start[by[lo : lo + (1 << 18)]]
                    # Positions may be far apart: hash neighbourhoods of at most SEGMENT bytes.
                    u = 0
                    while u < len(p):
                        v = int(np.searchsorted(p, p[u] + SEGMENT))
                        base = int(p[u])
                        near = x.data[base : int(p[v - 1]) + length]
                        for kind in (0, 1):
                            w[kind, by[lo + u : lo + v]] = grams.slice_hashes(grams.prefix_sums(near, kind), p[u:v] - base, p[u:v] - base + length, kind)
                        u = v
                order = np.lexsort((start, d, x.tag[d], x.ids[d], w[1], w[0]))
                w, start, d = w[:, order], start[order], d[order]
                lead = np.concatenate([[True], (w[:, 1:] != w[:, :-1]).any(0)])
                dup = ~lead
                out = []
                if dup.any():
                    out.append((batch, batch, -1, np.stack([start[dup], start[dup] + length, d[dup]], 1).astype("<i8").tobytes(), None))
                w, start, d = w[:, lead], start[lead], d[lead]
                rim = _bounds(w[0], bits)
                for k in range(1 << bits):
                    a, b = rim[k], rim[k + 1]
                    if b > a:
                        loc = np.stack([w[0, a:b].view(np.int64), w[1, a:b].view(np.int64), start[a:b], x.ids[d[a:b]], d[a:b] | mark[d[a:b]]], 1).astype("<i8")
                        out.append((k, batch, k, press.compress(loc.tobytes()), None))
                yield from _emit(out)

    return run


def _shared(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows as strings, bytes that each shares with the one before it in that order; the first shares -1)."""
    n, width = mat.shape
    order = np.argsort(np.ascontiguousarray(mat).view(f"S{width}").ravel(), kind="stable")
    lcp = np.full(n, -1, np.int16)
    for lo in range(1, n, 1 << 14):
        a, b = mat[order[lo - 1 : min(n, lo + (1 << 14)) - 1]], mat[order[lo : min(n, lo + (1 << 14))]]
        diff = a != b
        lcp[lo : lo + len(a)] = np.where(diff.any(1), diff.argmax(1), width)
    return order, lcp


def equal_suffixes(data: np.ndarray, at: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, suffix number in it) of every suffix that equals one of an earlier run on ``length`` bytes.

    Run k holds ``count[k]`` suffixes from ``at[k]`` on and the bytes that they need;
    ``anchor[k]`` is the distance from there to its sample. Runs come in order.
    """
    n = len(at)
    span = length - GRAM + 1
    low = anchor - count + 1  # least distance of a suffix to the sample
    right = np.zeros((n, length), np.uint8)
    left = np.zeros((n, span), np.uint8)
    for lo in range(0, n, 1 << 13):
        part = slice(lo, lo + (1 << 13))
        step = np.arange(length)
        inside = step < (length - low[part])[:, None]
        right[part] = np.where(inside, data[np.minimum((at[part] + anchor[part])[:, None] + step, len(data) - 1)], 0)
        step = np.arange(1, span + 1)
        inside = step <= anchor[part][:, None]
        left[part] = np.where(inside, data[np.maximum((at[part] + anchor[part])[:, None] - step, 0)], 0)
    by_right, lcp_right = _shared(right)
    by_left, lcp_left = _shared(left)
    del right, left
    runs, numbers = [], []
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(span):
        part = np.flatnonzero((low <= o) & (o <= anchor))
        if len(part) < 2:
            continue
        right_class[by_right] = np.cumsum(lcp_right < length - o)
        left_class[by_left] = np.cumsum(lcp_left < o)
        key = left_class[part] * (n + 1) + right_class[part]
        order = np.argsort(key, kind="stable")
        key = key[order]
        dup = part[order[1:][key[1:] == key[:-1]]]
        runs.append(dup)
        numbers.append(anchor[dup] - o)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(runs), np.concatenate(numbers)


def _sort_buckets(length: int):
    """One suffix bucket at a time: every suffix that an earlier equal one precedes, answered to its batch."""

    low = (1 << 32) - 1

    def spans(batch, block, start, doc):
        """Runs of consecutive starts, as rows per batch."""
        by = np.lexsort((start, doc, batch))
        batch, start, doc = batch[by], start[by], doc[by]
        new = np.concatenate([[True], (batch[1:] != batch[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(new)) - 1
        rows, of = np.stack([start[s], start[e] + length, doc[s]], 1).astype("<i8"), batch[s]
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(of))):
            yield (int(of[a]), int(of[a]), block, rows[a:b].tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for block, held in _blocks(batches):
            if block < 0:
                yield from _emit(held)
                continue
            whole = [(r[1], np.frombuffer(open_.decompress(r[3]), "<i8").reshape(-1, 5), r[4]) for r in held if r[4] is not None]
            single = [(r[1], np.frombuffer(open_.decompress(r[3]), "<i8").reshape(-1, 5)) for r in held if r[4] is None]
            held.clear()
            if whole:
                batch = np.concatenate([np.full(len(r[1]), r[0]) for r in whole])
                loc = np.concatenate([r[1] for r in whole])
                data = np.frombuffer(b"".join(open_.decompress(r[2]) for r in whole), np.uint8)
                whole.clear()
                size = loc[:, 1] + length - 1
                at = np.cumsum(size) - size
                order = np.lexsort((loc[:, 0], loc[:, 4] & low, batch, loc[:, 4] >> 32, loc[:, 3]))
                batch, loc, at = batch[order], loc[order], at[order]
                which, number = equal_suffixes(data, at, loc[:, 1], loc[:, 2], length)
                del data
                if len(which):
                    yield from _emit(list(spans(batch[which], block, loc[which, 0] + number, loc[which, 4] & low)))
            if single:
                batch = np.concatenate([np.full(len(r[1]), r[0]) for r in single])
                loc = np.concatenate([r[1] for r in single])
                single.clear()
                order = np.lexsort((loc[:, 2], loc[:, 4] & low, batch, loc[:, 4] >> 32, loc[:, 3], loc[:, 1], loc[:, 0]))
                batch, loc = batch[order], loc[order]
                dup = np.zeros(len(loc), bool)
                dup[1:] = (loc[1:, :2] == loc[:-1, :2]).all(1)
                if dup.any():
                    yield from _emit(list(spans(batch[dup], block, loc[dup, 2], loc[dup, 4] & low)))

    return run


def _apply(length: int, schema: pa.Schema, with_text: bool):
    """Per document what is left; with_text: the rows as they came, with the bytes that stay as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offs, body, rest, answers in rows_of(batches):
            x = _Batch(ids, offs, body, length)
            size = len(x.data)
            edge = np.zeros(size + 1, np.int32)
            for answer in answers or ():
                hit = np.frombuffer(answer, "<i8").reshape(-1, 3)
                np.add.at(edge, hit[:, 0], 1)
                np.add.at(edge, hit[:, 1], -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            del edge, answers
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            rise[x.offs[:-1][x.offs[:-1] < size]] |= gone[x.offs[:-1][x.offs[:-1] < size]]
            total = np.concatenate([[0], np.cumsum(gone)])[x.offs]
            n_spans = np.diff(np.concatenate([[0], np.cumsum(rise)])[x.offs])
            kept = x.data[~gone].tobytes()
            del gone, rise
            at = (x.offs - total).tolist()
            if with_text:
                other = pa.ipc.open_stream(rest).read_all().combine_chunks() if rest else None
                cols = {"doc_id": pa.array(x.ids)} | ({n: other.column(n).combine_chunks() for n in other.column_names} if other is not None else {})
                cols["text"] = pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in zip(at[:-1], at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)
            else:
                sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x.ids), pa.array(np.diff(x.offs)), pa.array(np.diff(total)), pa.array(n_spans), pa.array(sha)], schema=schema)

    return run


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_REPORT_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())])


def _deduplicated(docs: DataFrame, length: int, batch_bytes: int, schema: pa.Schema, kind, with_text: bool) -> DataFrame:
    """What ``_apply`` makes of the rows, as a working table.

    Buckets and tasks are as many as the input's bytes ask for.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        bundles = keep(arrow_map(docs, _bundle(batch_bytes), _BATCH), "suffix-bundles")
    total = bundles.agg(F.sum("size")).first()[0] or 0
    bits = max(8, min(16, (total // BUCKET_BYTES).bit_length()))
    wide = max(shuffle_width(spark), -(-total // TASK_BYTES))
    with small_batches(spark, BATCH_ROWS):
        plain = bundles.select("batch", "ids", "offs", "body")
        told = arrow_map(plain, _announce(length, bits), _WIRE).repartition(wide, "part").sortWithinPartitions("block")
        flags = arrow_map(told, _tally, _WIRE).groupBy("batch").agg(F.collect_list(F.struct("block", "a")).alias("answers"))
        asked = plain.join(flags, "batch", "left").select("batch", "ids", "offs", "body", "answers")
        dealt = arrow_map(asked, _suffixes(length, bits), _WIRE).repartition(wide, "part").sortWithinPartitions("block")
        found = keep(arrow_map(dealt, _sort_buckets(length), _WIRE).select("batch", "a"), "suffix-spans")
        del told, flags, asked, dealt
        settle(spark)
        spans = found.groupBy("batch").agg(F.collect_list("a").alias("answers"))
        answered = bundles.join(spans, "batch", "left").select("ids", "offs", "body", "rest", "answers")
        return keep(arrow_map(answered, _apply(length, schema, with_text), kind), "suffix-done")


def suffix_dedup_report(docs: DataFrame, *, length: int = 100, batch_bytes: int = 1 << 20) -> DataFrame:
    """What removing every byte of a ``length``-byte string that starts earlier leaves of each document.

    Texts are UTF-8 bytes; earlier means a smaller doc_id, or the same document and
    an earlier start; rows that share a doc_id count in the order of a digest of their
    texts. All strings are judged on the input. A null text is empty. A null doc_id is compared with
    nothing and kept whole. Columns other than doc_id and text are not read.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = _deduplicated(base.where("doc_id is not null"), length, batch_bytes, _REPORT_ARROW, _REPORT, False)
    lost = base.where("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return done.unionByName(lost)


def suffix_dedup_texts(docs: DataFrame, *, length: int = 100, batch_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the bytes that occur earlier.

    Bytes of a character that is only partly removed go too. Rows are never dropped;
    a null text comes back empty, a null doc_id's row as it was.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in others))
    schema = base.select(*docs.columns).schema
    done = _deduplicated(base.where("doc_id is not null"), length, batch_bytes, to_arrow_schema(schema), schema, True)
    return done.unionByName(base.where("doc_id is null").select(*docs.columns))
