"""Filters, paging, upserts and set operations over fact tables."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ordinals of severities and importances, most severe first.
SEVERITY_ORDER = ("error", "warning", "info", "hint")
IMPORTANCE_ORDER = ("low", "normal", "high", "critical")


def rank_of(column: Column, order: Sequence[str], missing: int = 99) -> Column:
    """Position of a text value in ``order``."""
    out = F.when(F.lit(False), F.lit(0))
    for k, value in enumerate(order):
        out = out.when(column == value, F.lit(k))
    return out.otherwise(F.lit(missing))


def ilike_prefix(column: Column, prefix: str) -> Column:
    """Prefix test that ignores ASCII case, as the stores' LIKE does."""
    return F.lower(column).startswith(prefix.lower())


def either_is(a: Column, b: Column, value) -> Column:
    """Rows incident to ``value`` on either of two columns."""
    return (a == value) | (b == value)


def since(ts: Column, anchor, days: int) -> Column:
    """Within ``days`` before an explicit anchor; nothing here reads the clock."""
    return ts >= F.lit(anchor) - F.make_dt_interval(F.lit(days))


@dataclass(frozen=True)
class Projection:
    """A conjunction in which an empty member passes everything."""

    types: tuple[str, ...] = ()
    min_confidence: float = 0.0
    min_importance: str = "low"
    tags: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    max_age_days: int | None = None
    archived: bool | None = None

    def condition(self, columns: Sequence[str], anchor=None) -> Column:
        out = F.lit(True)
        if self.types:
            out = out & F.col("memory_type").isin(*self.types)
        out = out & (F.col("confidence") >= self.min_confidence)
        if "importance" in columns:
            out = out & (rank_of(F.col("importance"), IMPORTANCE_ORDER, -1) >= IMPORTANCE_ORDER.index(self.min_importance))
        if self.tags:
            out = out & F.arrays_overlap("tags", F.array(*map(F.lit, self.tags)))
        if self.files:
            out = out & F.arrays_overlap("files", F.array(*map(F.lit, self.files)))
        if self.max_age_days is not None:
            out = out & since(F.col("transaction_time"), anchor, self.max_age_days)
        if self.archived is not None:
            out = out & (F.col("archived") == self.archived)
        return out


def matches(wanted: dict) -> Column:
    """A filter object as one predicate: a list is one of, a pair is a range, ``any`` one flag of several, ``since`` (column, instant)."""
    out = F.lit(True)
    for name, value in wanted.items():
        if name == "any":
            part = F.lit(False)
            for flag in value:
                part = part | F.col(flag)
        elif name == "since":
            part = F.col(value[0]) >= F.lit(value[1]).cast("timestamp")
        elif isinstance(value, tuple):
            part = F.col(name).between(*value)
        else:
            part = F.col(name).isin(value)
        out = out & part
    return out


def split_by(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, all others): null counts as not met."""
    yes = F.coalesce(gone, F.lit(False))
    return df.where(yes), df.where(~yes)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """``size`` rows after a key, with ``has_more`` told by one row further."""
    page = df.where(F.col(key) > after).orderBy(key).limit(size + 1)
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(key))
    return page.withColumn("has_more", n > size).withColumn("_at", at).where(F.col("_at") <= size).drop("_at")


def composite_page(df: DataFrame, sort: str, key: str, after: tuple, size: int) -> DataFrame:
    """The page after (sort value, key) in descending order of the sort value, keys ascending."""
    value, last = after
    beyond = (F.col(sort) < value) | ((F.col(sort) == value) & (F.col(key) > last))
    return df.where(beyond).orderBy(F.desc(sort), F.asc(key)).limit(size)


def offset_page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def encode_cursor(**fields) -> str:
    return base64.urlsafe_b64encode(json.dumps(fields, sort_keys=True, default=str).encode()).decode()


def cursor_of(**fields: Column) -> Column:
    """``encode_cursor`` of each row: base64 of a compact JSON object with the fields in this order."""
    cells = [F.concat(F.lit(f'"{name}":'), value.cast("string")) for name, value in fields.items()]
    return F.base64(F.encode(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")), "UTF-8"))


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert: the row that comes first in ``order`` stands for its key; partial aggregation, no sort of a hot key."""
    value = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def first_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``incoming`` whose key is new, and all existing ones."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti"))


def cascade_delete(edges: DataFrame, gone: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Edges without those that touch a removed node on any of ``columns``."""
    out = edges
    for c in columns:
        drop = gone.select(F.col(key).alias(c)).distinct()
        out = out.join(drop, c, "left_anti")
    return out.select(*edges.columns)


def scan_diff(before: DataFrame, now: DataFrame, key: str, stamp: str, digest: str) -> DataFrame:
    """added, removed, unchanged or modified per key; equal stamps spare the digest comparison."""
    a = before.select(F.col(key), F.col(stamp).alias("_s0"), F.col(digest).alias("_d0"), F.lit(True).alias("_in0"))
    b = now.select(F.col(key), F.col(stamp).alias("_s1"), F.col(digest).alias("_d1"), F.lit(True).alias("_in1"))
    status = (
        F.when(F.col("_in0").isNull(), "added")
        .when(F.col("_in1").isNull(), "removed")
        .when(F.col("_s0") == F.col("_s1"), "unchanged")
        .when(F.col("_d0") == F.col("_d1"), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def suppressed_lines(lines: DataFrame, partition: str, order: str, text: str) -> DataFrame:
    """Lines silenced by a directive on them or on the line above: rules listed, or all ('*')."""
    found = F.regexp_extract(text, r"(?i)(?:orrery-ignore|#\s*noqa|eslint-disable-next-line|@SuppressWarnings)[:( ]*\"?([A-Za-z0-9_,\- ]*)", 1)
    has = F.col(text).rlike(r"(?i)orrery-ignore|#\s*noqa|eslint-disable-next-line|@SuppressWarnings")
    rules = F.when(has, F.when(F.trim(found) == "", F.array(F.lit("*"))).otherwise(F.transform(F.split(found, ","), lambda x: F.trim(x))))
    above = F.lag("_rules").over(Window.partitionBy(partition).orderBy(order))
    return lines.withColumn("_rules", rules).withColumn("suppressed_rules", F.coalesce("_rules", above)).drop("_rules")
