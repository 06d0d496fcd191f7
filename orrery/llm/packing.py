"""Packing token sequences by minimum bin slack.

Documents are tokenized once; what exceeds the window is cut into full windows, and
the remaining lengths form a multiset of at most ``capacity`` different values. The
plan is made on that histogram alone, whatever the number of documents: the largest
remaining length opens a window, bitset subset-sum dynamic programming picks the
multiset of other lengths that comes closest to the capacity, back-tracking gives
the count of each, and the pattern is repeated as often as the stock allows. Slack
that no subset fills is filled by cutting one more document; the very last window
is cut at powers of two, which need no padding.

Documents of one length are told apart by their rank, from per-task ranks and
per-task counts, so no length's documents are gathered or sorted in one task.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordBpe
from .common import arrow_map, keep, slabs, text_buffers

_LOADED: dict[str, WordBpe] = {}
#: Rows of cut documents up to which their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_CUTS = 50_000


def _tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def best_subset(room: int, stock: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of lengths with the largest sum <= room, as counts by length.

    stock: (length, available) in descending order of length. One bit per reachable
    sum; counts are added in doubling lots, and the walk back over the lots gives
    how many of each were used.
    """
    mask = (1 << (room + 1)) - 1
    reach, lots = 1, []
    for length, count in stock:
        if length > room:
            continue
        left, lot = min(count, room // length), 1
        while left:
            lot = min(lot, left)
            more = (reach | reach << length * lot) & mask
            if more != reach:
                lots.append((length, lot, reach))
                reach = more
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, lot, before in reversed(lots):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + lot
            total -= length * lot
    return used


@dataclass
class Plan:
    """Where each (length, rank) goes, as rows of
    (length, first rank, last rank + 1, start, size, sequence, copies, offset, items before)."""

    rows: list[tuple[int, ...]] = field(default_factory=list)
    sequences: int = 0
    cut: int = 0


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan windows for the counted lengths (1 to capacity)."""
    plan = Plan()
    stock: dict[int, deque] = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c > 0}
    count = {n: c for n, c in histogram.items() if c > 0}

    def take(length: int, items: int, size: int, copies: int, offset: int) -> list[tuple[int, int, int, int]]:
        """Use ``items`` of a length, ``copies`` a window, the first ``size`` ids of each."""
        done, moved = 0, []
        while done < items:
            origin, rank, c, start = stock[length].popleft()
            n = min(c, items - done)
            plan.rows.append((origin, rank, rank + n, start, size, plan.sequences, copies, offset, done))
            if size < length:
                moved.append((origin, rank, n, start + size))
                plan.cut += n
            if n < c:
                stock[length].appendleft((origin, rank + n, c - n, start))
            done += n
        count[length] -= items
        if not count[length]:
            del count[length], stock[length]
        return moved

    def put_back(length: int, moved: list[tuple[int, int, int, int]]) -> None:
        if length:
            stock.setdefault(length, deque()).extend(moved)
            count[length] = count.get(length, 0) + sum(m[2] for m in moved)

    while count:
        top = max(count)
        spare = dict(count)
        spare[top] -= 1
        used = best_subset(capacity - top, sorted(((n, c) for n, c in spare.items() if c), reverse=True))
        used[top] = used.get(top, 0) + 1
        slack = capacity - sum(n * c for n, c in used.items())
        rest = [n for n, c in count.items() if c > used.get(n, 0)]
        if slack and not rest:
            break
        times = min(count[n] // c for n, c in used.items())
        extra = max(rest) if slack else 0
        if slack:
            times = min(times, count[extra] // (used.get(extra, 0) + 1))
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            take(n, times * c, n, c, offset)
            offset += n * c
        if slack:
            put_back(extra - slack, take(extra, times, slack, 1, offset))
        plan.sequences += times
    # What is left fills less than one window: cut it at powers of two.
    left = sum(n * c for n, c in count.items())
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        offset = 0
        while offset < room:
            n = max(count)
            size = min(n, room - offset)
            put_back(n - size, take(n, 1, size, 1, offset))
            offset += size
        plan.sequences += 1
    return plan


_PIECES = "part int, doc_id long, start long, length long, rank long, ids_crc32 long, doc_tokens long, doc_crc long"
_PIECES_ARROW = pa.schema([("part", pa.int32()), *((x, pa.int64()) for x in ("doc_id", "start", "length", "rank", "ids_crc32", "doc_tokens", "doc_crc"))])


def _encoded(rows: pa.RecordBatch, path: str, eos: int, slab: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, ids with the end id) of each row."""
    bpe = _tokenizer(path)
    data, offs = text_buffers(rows.column(1))
    for lo, hi, part, at in slabs(data, offs, slab):
        ids, per = bpe.encode(part, at)
        ids = ids.astype("<u4")
        end = np.cumsum(per)
        for k, (b, n) in enumerate(zip(end.tolist(), per.tolist())):
            yield lo + k, np.append(ids[b - n : b], np.uint32(eos))


def _cut(path: str, capacity: int, eos: int, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = [0] * (capacity + 1)
        for rows in batches:
            names = rows.column(0).to_pylist()
            out: list[tuple] = []
            for k, ids in _encoded(rows, path, eos, slab):
                raw = ids.tobytes()
                whole = zlib.crc32(raw)
                for start in range(0, len(ids), capacity):
                    size = min(capacity, len(ids) - start)
                    crc = whole if size == len(ids) else zlib.crc32(raw[4 * start : 4 * (start + size)])
                    out.append((part, names[k], start, size, seen[size], crc, len(ids), whole))
                    seen[size] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECES_ARROW)], schema=_PIECES_ARROW)

    return run


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_crc long"
_PLACED_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _PLACED.split(", ")])


def _place(plan_rows: np.ndarray):
    """Turn (length, rank) into sequence and offset by the plan, one row per piece."""
    order = np.lexsort((plan_rows[:, 3], plan_rows[:, 1], plan_rows[:, 0]))
    plan_rows = plan_rows[order]
    key = lambda length, rank: length.astype(np.int64) << np.int64(44) | rank.astype(np.int64)
    lo, hi = key(plan_rows[:, 0], plan_rows[:, 1]), key(plan_rows[:, 0], plan_rows[:, 2])
    marks = np.unique(np.concatenate([lo, hi]))
    # The plan's rows over each interval between marks, as one flat list.
    first, last = np.searchsorted(marks, lo), np.searchsorted(marks, hi)
    size = last - first
    slot = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    which = np.repeat(np.arange(len(plan_rows)), size)
    by = np.argsort(slot, kind="stable")
    which = which[by]
    begin = np.searchsorted(slot[by], np.arange(len(marks) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            doc_id, start, length, rank, crc, tokens, whole = (rows.column(k) for k in range(7))
            length, rank = length.to_numpy(), rank.to_numpy()
            at = np.searchsorted(marks, key(length, rank), "right") - 1
            n = begin[at + 1] - begin[at]
            item = np.repeat(np.arange(len(at)), n)
            row = plan_rows[which[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            t = rank[item] - row[:, 1] + row[:, 8]
            copies = row[:, 6]
            cut = row[:, 4] != length[item]
            where = pa.array(item)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id.take(where),
                    pa.array(start.to_numpy()[item] + row[:, 3]),
                    pa.array(row[:, 4]),
                    pa.array(crc.to_numpy()[item], mask=cut),
                    tokens.take(where),
                    pa.array(row[:, 5] + t // copies),
                    pa.array(row[:, 7] + t % copies * row[:, 4]),
                    whole.take(where),
                ],
                schema=_PLACED_ARROW,
            )

    return run


def _recount(path: str, eos: int, slab: int):
    """Digests of given slices of documents that the plan cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, slices = rows.column(0).to_pylist(), rows.column(2).to_pylist()
            out = []
            for k, ids in _encoded(rows, path, eos, slab):
                raw = ids.tobytes()
                whole = zlib.crc32(raw)
                out += [(names[k], whole, s["start"], s["length"], zlib.crc32(raw[4 * s["start"] : 4 * (s["start"] + s["length"])])) for s in slices[k] if s["doc_crc"] == whole]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "doc_crc", "start", "length", "crc"), map(list, zip(*out)))))

    return run


def pack_sequences(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, eos: int = 2, slab: int = 3 << 20) -> DataFrame:
    """Pack the ids of every text, each ended by ``eos``, into sequences of at most ``capacity``.

    tokenizer: path of a word-level BPE file on every executor. A null or empty text
    is its end id alone; repeated rows and null ids are packed like any other; an
    empty table gives no rows. Other columns are not read.

    Returns a row per piece: doc_id, start, length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset. Offsets of
    a sequence are gapless from 0; only a sequence shorter than ``capacity`` and
    not of a power of two needs padding, and the plan makes none such.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keep(arrow_map(texts, _cut(tokenizer, capacity, eos, slab), _PIECES), "pack-pieces")
    counts = keep(pieces.groupBy("part", "length").count(), "pack-counts")
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["count"] for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    plan = minimum_bin_slack(histogram, capacity)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Grows with tasks times lengths, and each piece needs one row of it: joined by shuffle, never broadcast.
    base = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("base")).hint("shuffle_hash")
    ranked = pieces.join(base, (pieces.part == base.p) & (pieces.length == base.l))
    ranked = ranked.select("doc_id", "start", "length", (F.col("rank") + F.col("base")).alias("rank"), "ids_crc32", "doc_tokens", "doc_crc")
    rows = np.array(plan.rows or np.zeros((0, 9)), np.int64).reshape(-1, 9)
    placed = arrow_map(ranked, _place(rows), _PLACED)
    final = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not plan.cut:
        return placed.select(*final)
    placed = keep(placed, "pack-placed")
    cuts = placed.where("ids_crc32 is null")
    wanted = cuts.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length", "doc_crc")).alias("slices"))
    if plan.cut <= BROADCAST_CUTS:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted.withColumnRenamed("doc_id", "cut_id"), F.col("doc_id").eqNullSafe(F.col("cut_id"))).select("doc_id", "text", "slices")
    crcs = arrow_map(found, _recount(tokenizer, eos, slab), "doc_id long, doc_crc long, start long, length long, crc long").distinct()
    crcs = crcs.select(*(F.col(c).alias(f"k_{c}") for c in ("doc_id", "doc_crc", "start", "length")), "crc")
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id"))
    for c in ("doc_crc", "start", "length"):
        same = same & (F.col(c) == F.col(f"k_{c}"))
    fixed = cuts.join(crcs, same, "left").withColumn("ids_crc32", F.col("crc"))
    return placed.where("ids_crc32 is not null").select(*final).unionByName(fixed.select(*final))
