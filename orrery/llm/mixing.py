"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to a power. The power comes from halving an
interval until the mix meets a target entropy or a repetition limit; five halvings
go into one aggregate, so only one row of sums reaches the driver each time. A
source's budget is whole passes over its documents and a part of one. A pass takes
documents in the order of a seeded 60-bit key; its upper 12 bits are the block, and
block sums locate the block in which a part ends, so cumulative sums run inside that
block alone. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, shuffle_width, text_bytes

BLOCK_BITS, KEY_BITS = 12, 60
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table of passes is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Text bytes of a range of the mixed order, about.
ORDER_BYTES = 64 << 20


@dataclass(frozen=True)
class Mix:
    """What to meet. ``entropy`` is a share of the largest possible, from 0 to 1; ``repeats`` is the most
    passes over a source. ``budget`` is in words, None for as many as there are. With ``keep_all`` the budget is
    the least that uses every document: the least repeated source gets one pass, and no document is lost."""

    entropy: float | None = None
    repeats: float | None = 2.0
    budget: int | None = None
    keep_all: bool = False
    seed: str = "mix"


def _key(doc_id: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _narrow(docs: DataFrame, seed: str) -> DataFrame:
    key = _key(F.col("doc_id"), seed)
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.alias("tokens"), key.alias("key"), F.shiftright(key, KEY_BITS - BLOCK_BITS).alias("block"))


def exponent(shares: DataFrame, mix: Mix, budget_over_total: float) -> float:
    """The power in [0, 1] for the weights share**power.

    With an entropy target, the one that meets it (entropy falls as the power rises);
    with a repetition limit, the least one that keeps to it; with both, the larger.
    A target out of reach gives the nearest end. shares: a ``share`` per source, > 0.
    """

    def sums(powers: list[float]):
        p = F.col("share")
        cells = []
        for k, a in enumerate(powers):
            cells += [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"r{k}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"m{k}")]
        return shares.agg(F.count("*").alias("n"), *cells).first()

    def search(holds) -> float:
        """Least power for which ``holds(entropy share, repeats)`` is true, if that is monotone."""
        low, high = 0.0, 1.0
        for _ in range(6):
            grid = [low + (high - low) * k / 32 for k in range(33)]
            row = sums(grid)
            if not row["n"]:
                return 1.0
            met = []
            for k, a in enumerate(grid):
                z, log_sum, rep = row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]
                top = math.log(row["n"]) if row["n"] > 1 else 1.0
                entropy = (math.log(z) - a * log_sum / z) / top
                met.append(holds(entropy, rep / row[f"m{k}"] if mix.keep_all else rep / z * budget_over_total))
            if met[0]:
                return grid[0]
            at = next((k for k in range(33) if met[k]), None)
            if at is None:
                return grid[-1]
            low, high = grid[at - 1], grid[at]
        return high

    found = [0.0]
    if mix.entropy is not None:
        found.append(search(lambda entropy, repeats: entropy <= mix.entropy))
    if mix.repeats is not None:
        found.append(search(lambda entropy, repeats: repeats <= mix.repeats))
    return max(found) if mix.entropy is not None or mix.repeats is not None else 1.0


def passes(narrow: DataFrame, mix: Mix) -> DataFrame:
    """Per source: weight, whole passes, and the last key of the part of one more."""
    blocks = keep(narrow.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sizes = blocks.groupBy("source").agg(F.sum("tokens").alias("size")).where("size > 0")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    budget = total if mix.budget is None else mix.budget
    shares = keep(sizes.withColumn("share", F.col("size") / F.lit(float(total or 1))), "mix-shares")
    power = exponent(shares, mix, budget / total if total else 1.0)
    z, least = shares.agg(F.sum(F.pow("share", F.lit(power))), F.min(F.pow("share", F.lit(power - 1)))).first()
    z = z or 1.0
    if mix.keep_all:
        budget = total * z / (least or 1.0)
    goal = shares.select("source", "size", (F.pow("share", F.lit(power)) / F.lit(z)).alias("weight"))
    goal = goal.withColumn("goal", F.floor(F.col("weight") * F.lit(float(budget)) + 1e-3).cast("bigint"))
    goal = goal.select("source", "size", "weight", F.expr("goal div size").alias("whole"), F.expr("goal % size").alias("rest"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))  # 4096 blocks a source at most
    ends = blocks.withColumn("after", running).join(goal, "source").where("after - tokens <= rest and rest < after")
    ends = ends.groupBy("source").agg(F.min_by(F.struct("block", (F.col("after") - F.col("tokens")).alias("before"), "weight", "whole", "rest", "size"), "block").alias("e")).select("source", "e.*")
    inside = narrow.join(ends.select("source", "block", "before", "rest"), ["source", "block"])
    same_key = inside.groupBy("source", "block", "key", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    taken = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    last = same_key.withColumn("taken", taken).where("taken <= rest").groupBy("source").agg(F.max("key").alias("last"))
    floor_key = F.shiftleft("block", KEY_BITS - BLOCK_BITS) - 1
    table = ends.join(last, "source", "left").select("source", "weight", "size", "whole", F.coalesce("last", floor_key).alias("last"))
    wordless = blocks.groupBy("source").agg(F.sum("tokens").alias("size")).where("size = 0")
    return table.unionByName(wordless.select("source", F.lit(0.0).alias("weight"), "size", F.lit(1).cast("bigint").alias("whole"), F.lit(-1).cast("bigint").alias("last")))


def _with_passes(rows: DataFrame, table: DataFrame, on: Column) -> DataFrame:
    table = table.withColumnsRenamed({c: f"__mix_{c}" for c in table.columns})
    small = table.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if small else table, on, "inner")


def _copies(key: Column) -> Column:
    return (F.col("__mix_whole") + F.when(key <= F.col("__mix_last"), 1).otherwise(0)).cast("int")


def _position(epoch: Column, key: Column, seed: str) -> Column:
    """Where a use stands: a pass's blocks, and the keys of a block, are permuted by the pass's own digests."""
    block = F.shiftright(key, KEY_BITS - BLOCK_BITS)
    turn = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, what)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    inside = (turn(block) + turn(key) / float(1 << BLOCK_BITS)) / (1 + 1 / float(1 << BLOCK_BITS))
    span = F.col("__mix_whole") + F.when(F.col("__mix_last") >= 0, F.lit(1)).otherwise(0)
    return (epoch - 1 + inside) / F.greatest(span, F.lit(1))


def mix_schedule(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row per use of a document: doc_id, source, tokens, epoch, block, position.

    docs: doc_id, text, source; tokens are words ``[^\\x20\\x09-\\x0D]+``. Sorting by
    position gives the mixed order: a source's uses spread evenly over [0, 1), each
    pass with its blocks in another order. A null source counts as the source ''; a
    source without any word costs nothing and is used once. Rows that share a doc_id are used alike.
    An empty table gives no rows; other columns are not read.
    """
    narrow = keep(_narrow(docs, mix.seed), "mix-rows")
    table = keep(passes(narrow, mix), "mix-passes")
    rows = _with_passes(narrow, table, F.col("source") == F.col("__mix_source"))
    rows = rows.withColumn("copies", _copies(F.col("key"))).where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    position = _position(F.col("epoch"), F.col("key"), mix.seed)
    return rows.select("doc_id", "source", "tokens", "epoch", "block", position.alias("position"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with every row as often as the mix uses it, in the mixed order, all columns as they were.

    The order is that of ``mix_schedule``'s positions; rows are dealt to ranges of positions and
    sorted there, so copies of a document stand passes apart.
    """
    narrow = keep(_narrow(docs, mix.seed), "mix-rows")
    table = keep(passes(narrow, mix), "mix-passes")
    rows = _with_passes(docs, table, F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col("__mix_source"))
    rows = rows.withColumn("__mix_copies", _copies(_key(docs["doc_id"], mix.seed))).where("__mix_copies > 0")
    rows = rows.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    key = _key(docs["doc_id"], mix.seed)
    rows = rows.withColumn("__mix_position", _position(F.col("__mix_epoch"), key, mix.seed))
    # Positions are even over [0, 1): ranges need no sample of the rows.
    width = max(shuffle_width(docs.sparkSession), -(-text_bytes(docs) // ORDER_BYTES))
    rows = rows.repartitionById(width, F.least(F.floor(F.col("__mix_position") * width), F.lit(width - 1)).cast("int")).sortWithinPartitions("__mix_position")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
