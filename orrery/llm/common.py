"""Shared plumbing: working tables in the cluster's checkpoint folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/checkpoints/orrery"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for working tables.

    It is ``spark.checkpoint.dir`` of the session. Only a session that runs in
    one JVM (tests) may go without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FALLBACK


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a working table and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Have the driver forget finished steps, so that Spark deletes their shuffle files now and not at some later collection."""
    for _ in range(2):  # finished steps leave the driver's event queue only after a while
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand texts to Python in small batches: the JVM holds each one outside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of the column ``text`` in all rows."""
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One row at a time, so that only that row's bytes are copied."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def runs_by(rows: Iterator[tuple], key: Callable[[tuple], object]) -> Iterator[tuple[object, list[tuple]]]:
    """(key, rows) of consecutive rows with one key; only one run is held."""
    now, held = None, []
    for row in rows:
        k = key(row)
        if held and k != now:
            yield now, held
            held = []
        now = k
        held.append(row)
    if held:
        yield now, held


def release() -> None:
    """Hand freed memory back: a Python worker outlives its task, and its peak counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers give their memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        # A null slot may hold bytes in theory; rebuild so that it is empty.
        valid = np.asarray(column.is_valid())
        sizes = np.where(valid, np.diff(offs), 0)
        if int(sizes.sum()) != int(offs[-1] - offs[0]):
            body = np.concatenate([body[offs[i] : offs[i + 1]] for i in np.flatnonzero(valid)] or [np.zeros(0, np.uint8)])
            return body, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slabs(data: np.ndarray, offs: np.ndarray, max_bytes: int, max_docs: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``max_bytes``: (first, last + 1, bytes, offsets)."""
    n = len(offs) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = max(lo + 1, min(hi, n, lo + max_docs))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
