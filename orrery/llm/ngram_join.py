"""N-gram Jaccard self-join by rare-first prefix filtering.

1. Each run of documents ("batch") hashes its distinct shingles and sends them to
   hash blocks. A shingle that many documents of one batch hold is sent once with
   its count, so a shingle of a third of all rows costs one entry per batch.
2. Blocks count every shingle over all documents and answer the ones that at
   least two hold, with a document frequency class.
3. Batches order each document's shared shingles rare first. With threshold t a
   document of n shingles has a partner only if one of its n - ceil(t n) + 1 rarest
   is shared; shingles that nobody else has come first and use up that prefix, so
   most documents end here.
4. Documents that share a prefix shingle within a length class of 1/t are
   connected; equal sets stand as one class. A connected group is where its
   documents' prefixes are joined: an index from prefix shingles to members gives
   the candidates, and each is verified once under the length, positional and
   suffix filters. Groups beyond ``chunk_entries`` are split into chunk pairs, which
   cover all of the group's pairs.
5. Where chance links join very many documents (more than ``most_chunks`` chunks),
   postings are joined by prefix shingle instead: a shingle's postings are dealt
   into runs of at most ``posting_run``, pairs of runs are joined, and the distinct
   pairs that pass the filters are verified.
6. Links go through connected components; each class also gets its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_map, keep, rows_of, runs_by, shuffle_width, slabs, small_batches, text_buffers, text_bytes
from .components import components

U = np.uint64
HASH_BITS = 56  # of a shingle; the top byte of a sort key holds the frequency class
SMALL_GROUP = 16
#: Text bytes for each hash block and for each task, about.
BLOCK_BYTES, TASK_BYTES = 16 << 20, 32 << 20


def required(nx, ny, num: int, den: int):
    """Least intersection at which two sets of nx and ny reach num/den."""
    return -((-num * (nx + ny)) // (den + num))


def prefix_length(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """1 to 255, rising with the document frequency (8 classes per doubling)."""
    return np.minimum(255, (8 * np.log2(df)).astype(np.int64) - 7).clip(1).astype(np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """48 low bits of each value in planes of 4 and 2 bytes."""
    return (values & U(0xFFFFFFFF)).astype("<u4").tobytes() + ((values >> U(32)) & U(0xFFFF)).astype("<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | (np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << U(32))


_WIRE = "part long, batch long, block int, a binary, b binary, c binary, d binary"
_WIRE_ARROW = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("block", pa.int32()), *((x, pa.binary()) for x in "abcd")])
#: In a batch, a shingle of at least this many documents is sent once with its count.
LOCAL_HOT = 24


def _send(width: int, block_bits: int, batch_bytes: int):
    shift = U(HASH_BITS - block_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        for rows in batches:
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text_hash = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = text_buffers(rows.column(1))
            for lo, hi, part, at in slabs(data, offs, batch_bytes):
                h, _, _, doc = grams.words(grams.LOWER[part], at)
                sh, sd = grams.shingles(h, doc, hi - lo, width)
                sh >>= U(64 - HASH_BITS)
                order = np.argsort(sh, kind="stable")
                sh, sd = sh[order], sd[order]
                # Short texts come last in `sd`, so equal hashes may need an order by document too.
                if len(sh) and np.any((sh[1:] == sh[:-1]) & (sd[1:] < sd[:-1])):
                    order = np.lexsort((sd, sh))
                    sh, sd = sh[order], sd[order]
                fresh = np.ones(len(sh), bool)
                fresh[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
                sh, sd = sh[fresh], sd[fresh]
                n = np.bincount(sd, minlength=hi - lo)
                by_doc = np.argsort(sd.astype(np.uint16), kind="stable")
                full = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64)
                d1, d2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(grams.mix(sh[by_doc] + U(0x1234567)), first)
                    d2[full] = np.add.reduceat(grams.mix(sh[by_doc] ^ U(0xABCDEF0123)), first)
                # Equal sets of this batch: only the first sends its shingles.
                _, seen, inv = np.unique(np.stack([d1, d2], 1), axis=0, return_index=True, return_inverse=True)
                lead = seen[inv.ravel()]
                sent = (lead == np.arange(hi - lo))[sd]
                sh, sd = sh[sent], sd[sent]
                new = np.ones(len(sh), bool)
                new[1:] = sh[1:] != sh[:-1]
                starts = np.flatnonzero(new)
                count = np.diff(np.append(starts, len(sh)))
                hot = count >= LOCAL_HOT
                cold = np.repeat(~hot, count)
                hot_docs = sd[~cold].astype("<u2")
                header = np.stack([ids[lo:hi], n, d1.view(np.int64), d2.view(np.int64), lead, text_hash[lo:hi]], 1).astype("<i8")
                number += 1
                blocks = 1 << block_bits
                out = [(number, -1, header.tobytes(), sh[starts[hot]].astype("<u8").tobytes(), count[hot].astype("<u2").tobytes(), hot_docs.tobytes())]
                ch, cd = sh[cold], sd[cold].astype("<u2")
                hh, hc = sh[starts[hot]], count[hot].astype("<u2")
                edges = np.arange(blocks + 1, dtype=np.uint64) << shift
                ca, ha = np.searchsorted(ch, edges), np.searchsorted(hh, edges)
                for k in range(blocks):
                    x, y, v, w = ca[k], ca[k + 1], ha[k], ha[k + 1]
                    if y > x or w > v:
                        low = U((1 << int(shift)) - 1)
                        out.append((number, k, _pack(ch[x:y] & low), cd[x:y].tobytes(), _pack(hh[v:w] & low), hc[v:w].tobytes()))
                for x in range(0, len(out), 128):
                    b, k, *blobs = zip(*out[x : x + 128])
                    at_part = [deal_key(q, r) for q, r in zip(b, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(at_part, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int32()), *(pa.array(z, pa.binary()) for z in blobs)], schema=_WIRE_ARROW)

    return run


def deal_key(batch: int, block: int) -> int:
    """Where a row goes: data to its block, a batch's header anywhere."""
    return block if block >= 0 else batch


def _count(block_bits: int):
    """Per task, the blocks' entries that two documents or more hold, answered to their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = iter(range(-1, -(1 << 62), -1))
        for block, held in runs_by(rows_of(batches), lambda r: r[2] if r[2] >= 0 else next(heads)):
            if block < 0:
                for _, batch, _, *blobs in held:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((batch, batch, -1, *blobs), _WIRE_ARROW)], schema=_WIRE_ARROW)
                continue
            rows = [(r[1], *r[3:]) for r in held]
            held.clear()
            hashes = [_unpack(r[1]) for r in rows]
            hots = [_unpack(r[3]) for r in rows]
            every = np.concatenate(hashes + hots)
            count = np.concatenate([np.ones(sum(map(len, hashes)), np.int64), *(np.frombuffer(r[4], "<u2").astype(np.int64) for r in rows)])
            order = np.argsort(every, kind="stable")
            s = every[order]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            df = np.add.reduceat(count[order], starts) if len(s) else np.zeros(0, np.int64)
            of = np.empty(len(s), np.int64)
            of[order] = np.repeat(df, np.diff(np.append(starts, len(s))))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in hashes + hots])])
            n = len(rows)
            out = []
            for k, (batch, _, docs, _, _) in enumerate(rows):
                cold, hot = of[cut[k] : cut[k + 1]], of[cut[n + k] : cut[n + k + 1]]
                m = cold >= 2
                if m.any() or len(hot):
                    out.append((batch, batch, block, _pack(hashes[k][m]), np.frombuffer(docs, "<u2")[m].tobytes(), _frequency_class(cold[m]).astype(np.uint8).tobytes(), _frequency_class(hot).astype(np.uint8).tobytes()))
            for x in range(0, len(out), 128):
                yield pa.RecordBatch.from_arrays([pa.array(z, t.type) for z, t in zip(zip(*out[x : x + 128]), _WIRE_ARROW)], schema=_WIRE_ARROW)

    return run


_DOCS = "doc_id long, n long, d1 long, d2 long, text_hash long, prefix array<long>, shared binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("text_hash", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])


def _order(num: int, den: int, block_bits: int):
    """Per batch, each document's shared shingles rare first, if its prefix reaches them."""
    shift = U(HASH_BITS - block_bits)

    def finish(header: tuple, answers: list) -> Iterator[pa.RecordBatch]:
        h = np.frombuffer(header[0], "<i8").reshape(-1, 6)
        hot_hash = np.frombuffer(header[1], "<u8")
        hot_count = np.frombuffer(header[2], "<u2").astype(np.int64)
        hot_docs = np.frombuffer(header[3], "<u2").astype(np.int64)
        keys, docs, hot_class = [], [], np.ones(len(hot_hash), np.uint64)
        cut = np.searchsorted(hot_hash, np.arange((1 << block_bits) + 1, dtype=np.uint64) << shift)
        for block, a, b, c, d in answers:
            top = U(block) << shift
            keys.append((_unpack(a) | top) | (np.frombuffer(c, np.uint8).astype(np.uint64) << U(HASH_BITS)))
            docs.append(np.frombuffer(b, "<u2").astype(np.int64))
            if d:
                hot_class[cut[block] : cut[block + 1]] = np.frombuffer(d, np.uint8)
        keys.append(np.repeat(hot_hash | (hot_class << U(HASH_BITS)), hot_count))
        docs.append(hot_docs)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        n = h[:, 1]
        m = np.bincount(doc, minlength=len(h))
        reach = prefix_length(n, num, den) - (n - m)
        live = (reach > 0) & (n > 0) & (h[:, 4] == np.arange(len(h)))
        stay = live[doc]
        key, doc = key[stay], doc[stay]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        at = np.searchsorted(doc, np.arange(len(h) + 1))
        mask = U((1 << HASH_BITS) - 1)
        for lo in range(0, len(h), 2000):
            hi = min(len(h), lo + 2000)
            prefix = [(key[at[i] : at[i] + reach[i]] & mask).astype(np.int64).tolist() if live[i] else None for i in range(lo, hi)]
            shared = [key[at[i] : at[i + 1]].tobytes() if live[i] else None for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([*(pa.array(h[lo:hi, k]) for k in (0, 1, 2, 3, 5)), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary())], schema=_DOCS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs_by(rows_of(batches), lambda r: r[1]):  # a batch's header comes first
            yield from finish(held[0][3:], [r[2:] for r in held[1:]])

    return run


def _suffix_prunes(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """One probe of the suffix filter: split both at y's middle and bound the overlap."""
    if len(x) < 16 or len(y) < 16:
        return False
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    return min(cut, mid) + min(len(x) - cut, len(y) - mid) < need


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))


def verify_group(n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a spanning set of the links among members of one group, weight of the members linked to each).

    n: set sizes; sets: each member's shared shingles as sort keys, rare first;
    side: 0 or 1, and where both occur only pairs across are looked at.
    """
    order = np.argsort(n, kind="stable")
    n, side, weight, sets = n[order], side[order], weight[order], [sets[i] for i in order]
    g, links, linked = len(n), [], np.zeros(len(n), np.int64)
    label = np.arange(g)
    lone = [n[i] - len(sets[i]) for i in range(g)]  # shingles that nobody else has; they come first
    reach = [int(prefix_length(n[i], num, den) - lone[i]) for i in range(g)]
    cross = side.min() != side.max()

    def join(i: int, j: int) -> None:
        linked[i] += weight[j]
        linked[j] += weight[i]
        a, b = label[i], label[j]
        if a != b:
            links.append((int(order[i]), int(order[j])))
            label[label == max(a, b)] = min(a, b)

    def done():
        out = np.empty(g, np.int64)
        out[order] = linked
        return links, out

    if g <= SMALL_GROUP:
        prefixes = [dict(zip(s[:r].tolist(), range(r))) for s, r in zip(sets, reach)]
        for j in range(g):
            for i in range(j - 1, -1, -1):
                if den * n[i] < num * n[j]:  # length filter: shorter ones fail too
                    break
                if cross and side[i] == side[j]:
                    continue
                a, b = prefixes[i], prefixes[j]
                first = min(((p, b[t]) for t, p in a.items() if t in b), default=None)
                if first is None:
                    continue
                need = int(required(n[i], n[j], num, den))
                x, y = sets[i][first[0] :], sets[j][first[1] :]
                if min(len(x), len(y)) < need or _suffix_prunes(x, y, need):  # positional, suffix
                    continue
                if _overlap(x, y) >= need:
                    join(i, j)
        return done()

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(g), sizes)
    token = np.concatenate(sets)
    rank = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pre = rank < np.repeat(np.array(reach), sizes)

    def index(keep: np.ndarray):
        o = np.argsort(token[keep], kind="stable")
        return token[keep][o], owner[keep][o]

    ptok, pown = index(pre)
    ftok, fown = index(np.ones(len(token), bool))

    def owners(tok: np.ndarray, own: np.ndarray, of: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(tok, of), np.searchsorted(tok, of, "right")
        size = hi - lo
        if not size.sum():
            return np.zeros(0, np.int64)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return own[at]

    for j in range(g):
        cand = np.unique(owners(ptok, pown, sets[j][: reach[j]]))
        cand = cand[(cand < j) & (den * n[cand] >= num * n[j])]
        if cross:
            cand = cand[side[cand] != side[j]]
        if not len(cand):
            continue
        need = required(n[cand], n[j], num, den)
        if len(cand) <= 8:
            for i, k in zip(cand.tolist(), need.tolist()):
                if min(sizes[i], sizes[j]) >= k and not _suffix_prunes(sets[i], sets[j], k) and _overlap(sets[i], sets[j]) >= k:
                    join(i, j)
            continue
        both = np.bincount(owners(ftok, fown, sets[j]), minlength=g)[cand]
        hit = cand[both >= need]
        linked[hit] += weight[j]
        linked[j] += weight[hit].sum()
        new = label[hit]
        for i in hit[np.unique(new, return_index=True)[1]].tolist():  # one link to each part not yet joined
            if label[i] != label[j]:
                linked[i] -= weight[j]
                linked[j] -= weight[i]
                join(i, j)
    return done()


#: Output of the verifiers: a link (a, b), or with b null that k more rows are linked to class a.
_LINKS = "a long, b long, k long"
_LINKS_ARROW = pa.schema([(c, pa.int64()) for c in "abk"])


def _link_rows(a: list, b: list, k: list) -> Iterator[pa.RecordBatch]:
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, k)], schema=_LINKS_ARROW)


def _verify(num: int, den: int):
    """Rows (component, i, j, cls, n, weight, chunk, shared) in order of the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in runs_by(rows_of(batches), lambda r: r[:3]):
            side = np.array([int(r[6] == j and i != j) for r in rows])
            if len(rows) < 2 or (i != j and side.min() == side.max()):
                continue  # the other chunk has no member
            cls = [r[3] for r in rows]
            links, linked = verify_group(np.array([r[4] for r in rows]), [np.frombuffer(r[7], "<u8") for r in rows], side, np.array([r[5] for r in rows]), num, den)
            yield from _link_rows([cls[x] for x, _ in links], [cls[y] for _, y in links], [0] * len(links))
            some = np.flatnonzero(linked)
            yield from _link_rows([cls[x] for x in some], [None] * len(some), linked[some].tolist())

    return run


def _verify_pairs(num: int, den: int):
    """Rows (a, b, sizes, weights and shared shingles of both), a pair each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, na, nb, wa, wb, sa, sb in rows_of([batch]):
                need = int(required(na, nb, num, den))
                x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                if min(len(x), len(y)) >= need and not _suffix_prunes(x, y, need) and _overlap(x, y) >= need:
                    out += [(a, b, 0), (a, None, wb), (b, None, wa)]
            if out:
                yield from _link_rows(*map(list, zip(*out)))

    return run


def _join_postings(members: DataFrame, num: int, den: int, posting_run: int) -> DataFrame:
    """Links among ``members`` (cls, n, weight, prefix, shared) by a join on prefix shingles.

    A shingle's postings are dealt into runs, and runs are joined in pairs, so that a
    frequent shingle is many small tasks. Pairs pass the length and positional filters.
    """
    post = members.select("cls", "n", F.size("prefix").alias("reach"), (F.octet_length("shared") / 8).cast("bigint").alias("m"), F.posexplode("prefix").alias("pos", "token"))
    post = keep(post, "ngram-postings")
    held = post.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumn("runs", F.ceil(F.col("df") / posting_run).cast("int"))
    post = post.join(held, "token").withColumn("run", F.pmod(F.xxhash64("cls"), F.col("runs")).cast("int"))
    post = post.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    post = post.withColumns({"i": F.least("run", "other"), "j": F.greatest("run", "other")})
    x, y = (post.select("token", "i", "j", "run", *(F.col(c).alias(f"{c}_{side}") for c in ("cls", "n", "m", "pos"))).withColumnRenamed("run", f"run_{side}") for side in "xy")
    fits = (F.col("cls_x") < F.col("cls_y")) & ((F.col("i") == F.col("j")) | (F.col("run_x") != F.col("run_y")))
    longer, shorter = F.greatest("n_x", "n_y"), F.least("n_x", "n_y")
    need = F.ceil(F.lit(num) * (F.col("n_x") + F.col("n_y")) / F.lit(den + num))
    # Positional: past this shingle both have at most m - pos - 1 left, before it at most min(pos) are common.
    room = F.least("pos_x", "pos_y") + 1 + F.least(F.col("m_x") - F.col("pos_x"), F.col("m_y") - F.col("pos_y")) - 1
    pairs = x.join(y, ["token", "i", "j"]).where(fits & (den * shorter >= num * longer) & (room >= need)).select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct()
    sets = members.select("cls", "n", "weight", "shared")
    of = lambda side: sets.select(*(F.col(c).alias(f"{side}_{c}") for c in sets.columns))
    full = pairs.join(of("l"), F.col("a") == F.col("l_cls")).join(of("r"), F.col("b") == F.col("r_cls"))
    return arrow_map(full.select("a", "b", "l_n", "r_n", "l_weight", "r_weight", "l_shared", "r_shared"), _verify_pairs(num, den), _LINKS)


def ngram_jaccard_classes(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, batch_bytes: int = 4 << 20, chunk_entries: int = 60_000, most_chunks: int = 64, posting_run: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of texts whose ``width``-word shingle sets have Jaccard >= num/den.

    Texts are A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer
    than ``width`` words has its whole sequence as its one shingle; a null, empty or
    white text has none and links with nothing. Repeated rows are kept as rows; a
    null id is kept, alone.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest id reachable through links, itself included), ``n_links`` (other rows
    that this one is linked with), ``set_hash`` (of its shingles; null without any)
    and ``text_hash`` (``xxhash64`` of the text), which tell rows apart that share an
    id: each of their texts has links and a class of its own. Other columns of
    ``docs`` are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    total = text_bytes(texts)
    wide = max(shuffle_width(spark), -(-total // TASK_BYTES))
    bits = max(8, min(16, (total // BLOCK_BYTES).bit_length()))
    nameless = texts.where("doc_id is null")
    texts = texts.where("doc_id is not null")
    sent = arrow_map(texts, _send(width, bits, batch_bytes), _WIRE).repartition(wide, "part").sortWithinPartitions("block")
    counted = arrow_map(sent, _count(bits), _WIRE).repartition(wide, "batch").sortWithinPartitions("batch", "block")
    with small_batches(spark):
        sets = keep(arrow_map(counted, _order(num, den, bits), _DOCS), "ngram-sets")

    full = sets.where("n > 0")
    repeats = _repeats(full)
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count("*").alias("weight"), F.min(F.expr("if(shared is not null, doc_id, null)")).alias("carrier"))
    # A class is known by its least id, where ids repeat by its set's digest.
    classes = keep(classes.withColumn("cls", F.col("d1" if repeats else "low")), "ngram-classes")
    carriers = classes.where("carrier is not null").select(F.col("carrier").alias("doc_id"), "cls", "weight", "d1", "d2")
    led = full.where("shared is not null").join(carriers, ["doc_id", "d1", "d2"])
    if repeats:
        led = led.dropDuplicates(["cls"])
    span = F.lit(math.log(den / num) * 1.0001 if num < den else 1e-9)
    step = F.floor(F.log(F.col("n").cast("double")) / span).cast("bigint")
    node = led.select("cls", F.explode("prefix").alias("token"), step.alias("step")).select("cls", F.explode(F.array(F.xxhash64("token", "step"), F.xxhash64("token", F.col("step") + 1))).alias("node"))
    nodes = keep(node, "ngram-nodes")
    pivots = nodes.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("node", "low")
    groups = components(nodes.join(pivots, "node").where("cls <> low").select("cls", "low"))
    groups = keep(groups, "ngram-groups")

    members = keep(led.select("cls", "n", "weight", "prefix", "shared").join(groups, F.col("cls") == F.col("id")).select("component", "cls", "n", "weight", "prefix", "shared"), "ngram-members")
    size = members.groupBy("component").agg(F.sum(F.octet_length("shared") / 8).alias("entries"))
    size = keep(size.select("component", F.greatest(F.lit(1), F.ceil(F.col("entries") / chunk_entries)).cast("int").alias("parts")), "ngram-sizes")
    chunked = members.join(size.where(F.col("parts") <= most_chunks), "component").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    pairs = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "cls", "n", "weight", "chunk", "shared")
    pairs = pairs.repartition(wide, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = arrow_map(pairs, _verify(num, den), _LINKS)
    wide_groups = size.where(F.col("parts") > most_chunks)
    if wide_groups.limit(1).count():
        found = found.unionByName(_join_postings(members.join(wide_groups.select("component"), "component", "left_semi"), num, den, posting_run))
    found = keep(found, "ngram-links")
    linked = components(found.where("b is not null").select("a", "b"))
    if repeats:
        lows = linked.join(classes.select("cls", "low"), F.col("cls") == F.col("id")).groupBy("component").agg(F.min("low").alias("least"))
        linked = linked.join(lows, "component").select("id", F.col("least").alias("component"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("k").alias("others"))

    named = full.select("doc_id", "n", "d1", "d2", "text_hash").join(classes.select("d1", "d2", "cls", "low", "weight"), ["d1", "d2"])
    named = named.join(linked, F.col("cls") == F.col("id"), "left").join(counts, F.col("cls") == F.col("a"), "left")
    links = (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "low").alias("component_id"), links, F.col("d1").alias("set_hash"), "text_hash")
    nothing = [F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("set_hash"), "text_hash"]
    none = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *nothing)
    lost = nameless.select("doc_id", F.lit(None).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), *nothing)
    return out.unionByName(none).unionByName(lost)


def _repeats(sets: DataFrame) -> bool:
    """Whether an id stands on more than one row with a set."""
    row = sets.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("u")).first()
    return row.n != row.u


def keep_one_per_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, all its columns as they were.

    It is the row whose id is the class's component id. Where rows repeat that id,
    each set of shingles among them keeps one row. A row without an id was compared
    with nothing and stays.
    """
    lead = classes.where("doc_id = component_id").groupBy("doc_id", "set_hash").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("rows"))
    lead = keep(lead.select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash"), "rows"), "ngram-kept")
    same = (docs["doc_id"] == F.col("__kept_id")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("__kept_hash"))
    out = docs.join(lead.select("__kept_id", "__kept_hash"), same, "left_semi")
    if lead.where("rows > 1").limit(1).count():
        out = out.withColumn("__text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
    return out.unionByName(docs.where(docs["doc_id"].isNull()))
