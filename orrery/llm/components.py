"""Connected components of a link table by alternating star contraction.

Each round points a node's larger neighbours at its least neighbour and then its
smaller ones. Both halves are a partially aggregated minimum and a join, so a node
with very many links is never gathered in one task. Every round is written to the
shared working folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with edges a[i]-b[i]."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each run of links by a spanning star per local component."""
    for batch in batches:
        node, root = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        moved = node != root
        yield pa.RecordBatch.from_pydict({"u": node[moved], "v": root[moved]})


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Component of every node that has a link.

    links: two bigint columns; direction, repeats, self-links and nulls don't matter.
    Returns ``id`` and ``component`` (its component's least id); no links, no rows.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    edges = keep(arrow_map(pairs, _contract, "u bigint, v bigint").distinct(), "cc")
    last = None
    for _ in range(rounds):
        # Large star: both directions, larger neighbours go to the least of the closed neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself go to the least neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = keep(small.distinct(), "cc")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
