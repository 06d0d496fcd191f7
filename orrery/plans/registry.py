"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.facts import relation_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(uses: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name.

    uses: relations that ``sql`` reads, by name. sql: a SELECT, or more common table
    expressions and a SELECT after ``WITH``; None where SQL can't express the query.
    """

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            body = sql.strip()
            tables = [relation_sql(n) for n in uses.split()]
            if body[:5].upper() == "WITH ":
                rest = body[5:].strip()
                rest = rest[10:] if rest[:10].upper() == "RECURSIVE " else rest
                body = "WITH RECURSIVE " + ", ".join([*tables, rest])
            elif tables:
                body = "WITH " + ", ".join(tables) + " " + body
            ORACLES[fn.__name__] = body
        return fn

    return register
