"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform;
its hash is the signed axis it lies nearest to, and ``k`` such hashes make a bucket.
Multiprobe puts it into the next nearest buckets too. ``k`` grows with the number of
vectors, and the number of tables is the least that misses few enough of simulated
pairs at the threshold. Pairs of a bucket are verified in double precision, each in
the first bucket that its two vectors share, so counts are exact over found pairs.
Equal vectors stand as one with a weight. A large bucket is split into chunk pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_map, keep, shuffle_width
from .components import components, local_roots

U = np.uint64
BUCKET_TARGET = 512
#: Vector sizes, the most frequent ones, that get tables of their own; others are compared exactly.
MEASURED_SIZES = 10_000


@lru_cache(maxsize=64)
def _signs(seed: int, table: int, part: int, dim: int) -> np.ndarray:
    bits = grams.mix(np.arange(3 * dim, dtype=np.uint64) + U((seed << 40) + (table << 28) + (part << 20) + 1)) & U(1)
    return np.where(bits.reshape(3, dim) == 1, 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix; the width is a power of two."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int, k: int, probes: int, seed: int) -> np.ndarray:
    """Bucket ids of unit rows, (rows, tables * probes); distinct within a row."""
    n, d = x.shape
    wide = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    take = min(2 * wide, probes if k == 1 else 3)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        codes, costs = [], []
        for part in range(k):
            y = padded
            for s in _signs(seed, t, part, wide):
                y = hadamard(y * s) / np.sqrt(wide)
            both = np.concatenate([y, -y], 1)
            near = np.argpartition(-both, min(take, 2 * wide - 1), axis=1)[:, :take]
            value = np.take_along_axis(both, near, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
            codes.append(near)
            costs.append((value[:, :1] - value) ** 2)
        combos = list(itertools.product(range(take), repeat=k))
        cost = np.stack([sum(costs[p][:, c[p]] for p in range(k)) for c in combos], 1)
        ids = np.zeros((n, len(combos)), np.uint64)
        for p in range(k):
            ids = ids * U(2 * wide + 1) + np.stack([codes[p][:, c[p]] for c in combos], 1).astype(np.uint64)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        picked = np.take_along_axis(ids, best, 1)
        if picked.shape[1] < probes:
            picked = np.concatenate([picked, np.repeat(picked[:, -1:], probes - picked.shape[1], 1)], 1)
        out[:, t] = (grams.mix(picked + U((t + 1) << 44)) ^ U(d)).view(np.int64)
    return out.reshape(n, tables * probes)


def choose_tables(dim: int, k: int, probes: int, cosine: float, seed: int, miss: float = 0.004, most: int = 64) -> int:
    """Tables needed so that at most ``miss`` of simulated pairs at ``cosine`` share no bucket."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(1500, dim))
    b = rng.normal(size=(1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.where(norm > 0, norm, 1)
    missed = np.ones(len(a), bool)
    for lo in range(0, most, 4):
        x, y = (buckets(v, lo + 4, k, probes, seed).reshape(len(a), lo + 4, probes) for v in (a, b))
        for t in range(lo, lo + 4):
            missed &= ~(x[:, t, :, None] == y[:, t, None, :]).any((1, 2))
            if missed.mean() <= miss:
                return t + 1
    raise ValueError(f"{most} tables of {k} hashes miss {missed.mean():.3f} of pairs at cosine {cosine}: use fewer hashes or more probes")


_VECTORS = "vec_id long, dim int, d1 long, d2 long, vec binary"
_VECTORS_ARROW = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("vec", pa.binary())])


def _read(kind: str):
    """Vectors as bytes of ``kind`` (that of the column, so nothing is lost) with a digest; dim 0 where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for name, values in zip(rows.column(0).to_pylist(), rows.column(1)):
                vec = values.values.to_numpy(zero_copy_only=False).astype(kind) if values.is_valid and values.values.null_count == 0 else np.zeros(0)
                if not len(vec) or not np.isfinite(vec).all() or not np.any(vec) or name is None:
                    out.append((name, 0, None, None, None))
                    continue
                raw = (vec + vec.dtype.type(0)).tobytes()  # one zero
                d = hashlib.blake2b(raw, digest_size=16).digest()
                out.append((name, len(vec), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _VECTORS_ARROW)], schema=_VECTORS_ARROW)

    return run


def _doubles(raw: list[bytes], kind: str) -> np.ndarray:
    """A row per vector, in double precision."""
    return np.frombuffer(b"".join(raw), kind).astype("<f8").reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(shape: dict[int, tuple[int, int, int]], seed: int, kind: str):
    """A row per vector and bucket; shape: dim -> (tables, k, probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, dims, weight, raw = (rows.column(k) for k in range(4))
            dims = dims.to_numpy()
            for dim in np.unique(dims).tolist():
                for who in np.array_split(np.flatnonzero(dims == dim), max(1, int(np.ceil((dims == dim).sum() / 1024)))):
                    at = pa.array(who)
                    vecs = raw.take(at)
                    x = _doubles(vecs.to_pylist(), kind)
                    # A size too rare for tables of its own has one bucket, whose chunk pairs cover all pairs.
                    b = buckets(_unit(x), *shape[dim], seed) if dim in shape else np.full((len(who), 1), int(grams.mix(np.array([dim], np.uint64))[0]) >> 1)
                    order = np.sort(b, 1)
                    fresh = np.ones(b.shape, bool)
                    fresh[:, 1:] = order[:, 1:] != order[:, :-1]
                    row, col = np.nonzero(fresh)
                    lists = pa.array([r.tobytes() for r in order.astype("<i8")], pa.binary())
                    for lo in range(0, len(row), 8192):
                        r, c = pa.array(row[lo : lo + 8192]), col[lo : lo + 8192]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(order[row[lo : lo + 8192], c]), ids.take(at).take(r), weight.take(at).take(r), vecs.take(r), lists.take(r)],
                            names=["bucket", "rep", "weight", "vec", "lists"],
                        )

    return run


def verify_bucket(bucket: int, side: np.ndarray, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, lists: np.ndarray, cosine: float):
    """(id, linked weight, local root) of the members that link within one bucket (or across its two chunks)."""
    if side.min() != side.max():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        a = b = np.arange(len(ids))
    unit = _unit(x)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # exact, and no product overflows
    rows, cols = [], []
    for lo in range(0, len(a), 1024):
        i, j = np.nonzero(unit[a[lo : lo + 1024]] @ unit[b].T >= cosine - 1e-9)
        i, j = a[lo : lo + 1024][i], b[j]
        if a is b or len(a) == len(ids):
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 14):
            p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            dot = np.einsum("ij,ij->i", x[p], x[q])
            near = dot / np.sqrt(np.einsum("ij,ij->i", x[p], x[p]) * np.einsum("ij,ij->i", x[q], x[q])) >= cosine
            p, q = p[near], q[near]
            if len(p):
                shared = np.where((lists[p][:, :, None] == lists[q][:, None, :]).any(2), lists[p], np.iinfo(np.int64).max).min(1)
                rows.append(p[shared == bucket])
                cols.append(q[shared == bucket])
    if not rows:
        return None
    p, q = np.concatenate(rows), np.concatenate(cols)
    if not len(p):
        return None
    linked = np.zeros(len(ids), np.int64)
    np.add.at(linked, p, weight[q])
    np.add.at(linked, q, weight[p])
    node, root = local_roots(ids[p], ids[q])
    order = np.argsort(ids)
    at = order[np.searchsorted(ids[order], node)]
    return node, linked[at], root


def _verify(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush():
            if len(rows) > 1:
                side = np.array([r[0] for r in rows])
                if now[1] != now[2] and side.min() == side.max():
                    return None  # the other chunk has no member: its own task holds these pairs
                x = _doubles([r[3] for r in rows], kind)
                lists = np.frombuffer(b"".join(r[4] for r in rows), "<i8").reshape(len(rows), -1)
                return verify_bucket(now[0], side, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), x, lists, cosine)

        for batch in batches:
            found = []
            for bucket, i, j, chunk, rep, weight, vec, lists in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, i, j) != now:
                    if (got := flush()) is not None:
                        found.append(got)
                    now, rows = (bucket, i, j), []
                rows.append((int(chunk == j and i != j), rep, weight, vec, lists))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["rep", "linked", "root"])
        if (got := flush()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["rep", "linked", "root"])

    return run


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, seed: int = 11, chunk: int = 512) -> DataFrame:
    """Links and components of vectors (vec_id, embedding) with cosine >= ``cosine``.

    A null or zero vector, one with null or non-finite components and one without an
    id link with nothing; vectors of different sizes never link. Returns a row per
    input row: vec_id, n_links (other rows linked directly), component_id (least id
    reachable, itself included), kept. Rows that repeat an id and vector link with
    each other. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    # Vectors travel in the width of their column and are compared in double precision.
    kind = "<f4" if base.schema["embedding"].dataType.typeName() == "array" and base.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = keep(arrow_map(base, _read(kind), _VECTORS), "vec-rows")
    valid = rows.where("dim > 0")
    classes = keep(valid.groupBy("d1", "d2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vec-classes")
    reps = valid.select("vec_id", "d1", "d2", "vec").join(classes, ["d1", "d2"]).where("vec_id = rep").dropDuplicates(["rep", "d1", "d2"])
    reps = keep(reps.select("rep", "dim", "weight", "vec"), "vec-reps")
    shape = {}
    for r in reps.groupBy("dim").count().orderBy(F.desc("count")).limit(MEASURED_SIZES).collect():
        wide = 2 << max(0, (r["dim"] - 1).bit_length())
        k = max(1, int(np.ceil(np.log(max(1, r["count"] / BUCKET_TARGET)) / np.log(max(wide, 4)) - 1e-9)))
        probes = 2 if k == 1 else 4
        shape[r["dim"]] = (choose_tables(r["dim"], k, probes, cosine, seed), k, probes)
    dealt = keep(arrow_map(reps, _deal(shape, seed, kind), "bucket long, rep long, weight long, vec binary, lists binary"), "vec-dealt")
    sizes = dealt.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    split = dealt.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "weight", "vec", "lists")
    pairs = pairs.repartition(shuffle_width(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = keep(arrow_map(pairs, _verify(cosine, kind), "rep long, linked long, root long"), "vec-links")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    linked = components(found.select("rep", "root"))
    named = valid.select("vec_id", "d1", "d2").join(classes.select("d1", "d2", "rep", "weight"), ["d1", "d2"])
    named = named.join(counts.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left").join(linked, F.col("rep") == F.col("id"), "left")
    out = named.select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("dim = 0").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
