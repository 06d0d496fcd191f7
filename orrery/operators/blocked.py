"""Reachability and cheapest paths from many starts, a block of starts at a time.

A graph whose edges fit one task (``MOST_EDGES``, checked by a count) is handed to the
workers as a compressed adjacency table, and each block of starts is searched there
level by level on sorted arrays, without a shuffle. Larger graphs go the way of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Edges up to which the adjacency table is sent to every worker: 16 bytes each, 24 with weights.
MOST_EDGES = 4_000_000
#: (start, node) pairs that one block may hold before it is halved.
MOST_PAIRS = 8_000_000
#: Ranks that are told apart; nodes beyond are searched without their help.
MOST_RANKS = 1000


class Adjacency:
    """Nodes in ascending order, and each one's targets (and weights) as a slice."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None):
        self.nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = flat[: len(src)], flat[len(src) :]
        order = np.argsort(a, kind="stable")
        self.target = b[order].astype(np.int32)
        self.weight = None if weight is None else weight[order]
        self.at = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))
        self._ranks = None

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Node numbers; -1 for an id without edges."""
        if not len(self.nodes):
            return np.full(len(ids), -1)
        spot = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[spot] == ids, spot, -1)

    def step(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``node``, place of the edge) of every edge out of them."""
        size = self.at[node + 1] - self.at[node]
        which = np.repeat(np.arange(len(node)), size)
        return which, np.repeat(self.at[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def ranks(self) -> tuple[np.ndarray, int, bool]:
        """Each node's rank, the top rank, and whether a node has it; worked out once in a worker.

        Ranks rise along every edge, save between nodes of the top rank: those on or below
        a cycle, or at the end of paths of more than ``MOST_RANKS`` edges.
        """
        if self._ranks is None:
            entering, rank, top = np.bincount(self.target, minlength=len(self.nodes)), np.full(len(self.nodes), -1, np.int32), 0
            frontier = np.flatnonzero(entering == 0)
            while len(frontier) and top < MOST_RANKS:
                rank[frontier] = top
                top += 1
                node, n = np.unique(self.target[self.step(frontier)[1]], return_counts=True)
                entering[node] -= n
                frontier = node[entering[node] == 0]
            rest = rank < 0
            rank[rest] = top
            self._ranks = rank, top, bool(rest.any())
        return self._ranks


def _inside(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    spot = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[spot] == keys


def levels(graph: Adjacency, starts: np.ndarray, depth: int | None) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Per level the (start number, node) pairs first seen there; None where the block holds too many."""
    n = len(graph.nodes)
    frontier = np.arange(len(starts), dtype=np.int64) * n + starts
    seen, out = frontier, []
    while len(frontier) and (depth is None or len(out) < depth):
        which, edge = graph.step(frontier % n)
        keys = np.unique(frontier[which] // n * n + graph.target[edge])
        frontier = keys[~_inside(keys, seen)]
        if len(frontier):
            out.append((frontier // n, frontier % n))
            if len(seen) + len(frontier) > MOST_PAIRS and len(starts) > 1:
                return None
            seen = np.sort(np.concatenate([seen, frontier]), kind="stable")
    return out


def met(graph: Adjacency, starts: np.ndarray, nodes: np.ndarray) -> np.ndarray | None:
    """Whether each start reaches the node beside it, other than itself; None where the block holds too many pairs.

    A search goes on only through nodes that rank below one that its start is asked about, and ends when all of those are found.
    """
    n = len(graph.nodes)
    rank, top, some = graph.ranks()
    who, at = np.unique(starts, return_inverse=True)
    asked, place = np.unique(at * n + nodes, return_inverse=True)
    found, left = np.zeros(len(asked), bool), np.bincount(asked // n, minlength=len(who))
    most = np.zeros(len(who), np.int32)
    np.maximum.at(most, at, rank[nodes])
    seen = np.arange(len(who), dtype=np.int64) * n + who
    frontier = seen[(rank[who] < most) | (most == top)]
    while len(frontier):
        which, edge = graph.step(frontier % n)
        keys = np.unique(frontier[which] // n * n + graph.target[edge])
        if some:  # without cycles a search ends by itself
            keys = keys[~_inside(keys, seen)]
            seen = np.sort(np.concatenate([seen, keys]), kind="stable")
        spot = np.searchsorted(asked, keys[_inside(keys, asked)])
        spot = spot[~found[spot]]
        found[spot] = True
        np.subtract.at(left, asked[spot] // n, 1)
        who_of = keys // n
        frontier = keys[(left[who_of] > 0) & ((rank[keys % n] < most[who_of]) | (most[who_of] == top))]
        if max(len(seen), len(frontier)) > MOST_PAIRS and len(who) > 1:
            return None
    return found[place]


def cheapest(graph: Adjacency, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(start number, node, cost, previous node or -1) of least cost; None where the block holds too many."""
    n = len(graph.nodes)
    keys = np.arange(len(starts), dtype=np.int64) * n + starts
    cost, via = np.zeros(len(keys)), np.full(len(keys), -1)
    active, active_cost = keys, cost
    while len(active):
        which, edge = graph.step(active % n)
        new, spent, source = active[which] // n * n + graph.target[edge], active_cost[which] + graph.weight[edge], (active % n)[which]
        order = np.lexsort((source, spent, new))
        first = np.ones(len(order), bool)
        first[1:] = new[order][1:] != new[order][:-1]
        order = order[first]
        new, spent, source = new[order], spent[order], source[order]
        spot = np.minimum(np.searchsorted(keys, new), len(keys) - 1)
        known = keys[spot] == new
        better = ~known | (spent < cost[spot] - 1e-12)
        fix = better & known
        cost[spot[fix]], via[spot[fix]] = spent[fix], source[fix]
        add = better & ~known
        if add.any():
            if len(keys) + add.sum() > MOST_PAIRS and len(starts) > 1:
                return None
            keys, cost, via = np.concatenate([keys, new[add]]), np.concatenate([cost, spent[add]]), np.concatenate([via, source[add]])
            by = np.argsort(keys, kind="stable")
            keys, cost, via = keys[by], cost[by], via[by]
        active, active_cost = new[better], spent[better]
    return keys // n, keys % n, cost, via


def _blocks(starts: np.ndarray, search, width: int = 2048):
    """(starts of the block, what ``search`` finds) with blocks halved where they hold too many pairs."""
    todo = [starts[k : k + width] for k in range(0, len(starts), width)][::-1]
    while todo:
        block = todo.pop()
        found = search(block)
        if found is None:
            half = len(block) // 2
            todo += [block[half:], block[:half]]
        else:
            yield block, found


def adjacency(edges: DataFrame, weight: str | None = None):
    """The edges as a broadcast ``Adjacency``, or None where they are too many or not numbered."""
    if not all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("src", "dst")):
        return None
    cells = [F.col("src").cast("bigint"), F.col("dst").cast("bigint"), *([F.col(weight).cast("double")] if weight else [])]
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        return None
    got = edges.select(*cells).toArrow()
    return edges.sparkSession.sparkContext.broadcast(Adjacency(*(got.column(k).to_numpy() for k in range(len(cells)))))


def _starts(starts: DataFrame) -> DataFrame:
    spark = starts.sparkSession
    return starts.select(F.col("start").cast("bigint").alias("start")).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start")


def _search(graph, search, give):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = g.find(ids)
            ids, at = ids[at >= 0], at[at >= 0]
            index = np.arange(len(ids))
            for block, found in _blocks(index, lambda b: search(g, at[b])):
                yield from give(g, ids[block], found)

    return run


def reach_pairs(graph, starts: DataFrame, depth: int | None) -> DataFrame:
    """start, node, depth."""

    def give(g, ids, found):
        for k, (who, node) in enumerate(found):
            for lo in range(0, len(who), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[who[lo : lo + 100_000]]), pa.array(g.nodes[node[lo : lo + 100_000]]), pa.array(np.full(len(who[lo : lo + 100_000]), k + 1, np.int32))], names=["start", "node", "depth"])

    return _starts(starts).mapInArrow(_search(graph, lambda g, at: levels(g, at, depth), give), "start long, node long, depth int")


def reached_pairs(graph, pairs: DataFrame) -> DataFrame:
    """start, node, reached: one row for each pair, so no closure leaves a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            at, to = (g.find(batch.column(k).to_numpy()) for k in range(2))
            reached = np.zeros(batch.num_rows, bool)
            for block, found in _blocks(np.flatnonzero((at >= 0) & (to >= 0)), lambda b: met(g, at[b], to[b])):
                reached[block] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reached)], names=["start", "node", "reached"])

    dealt = pairs.select(*(F.col(c).cast("bigint").alias(c) for c in ("start", "node"))).distinct()
    dealt = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start").sortWithinPartitions("start")
    return dealt.mapInArrow(run, "start long, node long, reached boolean")


def reachable(graph, starts: DataFrame) -> DataFrame:
    """node: every start and what any of them reaches. One task searches; it holds a flag per node of the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        seen = np.zeros(len(g.nodes), bool)
        for batch in batches:
            at = g.find(batch.column(0).to_numpy())
            seen[at[at >= 0]] = True
            yield batch
        frontier, given = np.flatnonzero(seen), seen.copy()
        while len(frontier):
            _, edge = g.step(frontier)
            frontier = np.unique(g.target[edge])
            frontier = frontier[~seen[frontier]]
            seen[frontier] = True
        more = g.nodes[seen & ~given]
        for lo in range(0, len(more), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(more[lo : lo + 100_000])], names=["node"])

    return starts.select(F.col("start").cast("bigint").alias("node")).distinct().coalesce(1).mapInArrow(run, "node long")


def reach_counts(graph, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """node, callers (starts that reach it, other than itself), max_depth: counted in the workers, a row per node and block."""

    def give(g, ids, found):
        if not found:
            return
        node = np.concatenate([x for _, x in found])
        level = np.concatenate([np.full(len(x), k + 1) for k, (_, x) in enumerate(found)])
        order = np.lexsort((level, node))
        node, level = node[order], level[order]
        last = np.append(node[1:] != node[:-1], True)
        count = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
        yield pa.RecordBatch.from_arrays([pa.array(g.nodes[node[last]]), pa.array(count), pa.array(level[last])], names=["node", "n", "d"])

    found = _starts(starts).mapInArrow(_search(graph, lambda g, at: levels(g, at, depth), give), "node long, n long, d long")
    return found.groupBy("node").agg(F.sum("n").alias("callers"), F.max("d").cast("int").alias("max_depth"))


def path_costs(graph, starts: DataFrame) -> DataFrame:
    """start, node, cost, via."""

    def give(g, ids, found):
        who, node, cost, via = found
        for lo in range(0, len(who), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[s]]), pa.array(g.nodes[node[s]]), pa.array(cost[s]), pa.array(g.nodes[via[s]], mask=via[s] < 0)], names=["start", "node", "cost", "via"])

    return _starts(starts).mapInArrow(_search(graph, cheapest, give), "start long, node long, cost double, via long")
