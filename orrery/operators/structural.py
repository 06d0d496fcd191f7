"""Structural analysers: rule tables, naming, health scores, contracts, alleles, causal edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scores import normal_name


def match_rules(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, str, float]], most_chars: int = 200) -> DataFrame:
    """One pass over the texts for all (id, category, regex, confidence) rules: a row per match, its text cut for display."""

    def hits(rule: tuple[str, str, str, float]) -> Column:
        i, category, regex, confidence = rule
        return F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.struct(F.lit(i).alias("pattern_id"), F.lit(category).alias("category"), F.substring(m, 1, most_chars).alias("matched_text"), F.lit(confidence).alias("confidence")))

    return df.select(key, F.explode(F.concat(*map(hits, rules))).alias("m")).select(key, "m.*")


def inconsistent_names(df: DataFrame, name: str) -> DataFrame:
    """Groups of names that differ only in case and separators: normal form and its spellings."""
    g = df.select(F.col(name).alias("name")).distinct().groupBy(normal_name(F.col("name")).alias("normal"))
    return g.agg(F.array_sort(F.collect_set("name")).alias("spellings")).where(F.size("spellings") > 1)


def dominant_alleles(df: DataFrame, gene: str, allele: str) -> DataFrame:
    """Per gene the most frequent allele (least on ties), its share and the number of alleles."""
    g = df.groupBy(gene, allele).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(allele).alias("a")))
    t = g.groupBy(gene).agg(best.alias("b"), F.sum("n").alias("total"), F.count("*").alias("alleles"))
    return t.select(gene, F.col("b.a").alias("dominant"), (-F.col("b.k") / F.col("total")).alias("share"), "alleles")


def mutations(df: DataFrame, key: str, gene: str, allele: str, least_share: float = 0.6) -> DataFrame:
    """Rows whose allele isn't their gene's dominant one, where one dominates."""
    d = dominant_alleles(df, gene, allele).where(F.col("share") >= least_share)
    return df.join(d, gene).where(F.col(allele) != F.col("dominant")).select(key, gene, allele, "dominant")


def breaking_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """removed, added, changed or same per endpoint of two contract versions."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_i")), new.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_j"))
    change = F.when(F.col("_j").isNull(), "removed").when(F.col("_i").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"), F.when(change.isin("removed", "changed"), True).otherwise(False).alias("breaking"))


def posture(findings: DataFrame, by: str) -> DataFrame:
    """100 less weight * confidence per finding (10, 5, 2, 0.5 by severity 4 to 1), at least 0."""
    weight = F.when(F.col("severity") >= 4, 10.0).when(F.col("severity") == 3, 5.0).when(F.col("severity") == 2, 2.0).otherwise(0.5)
    return findings.groupBy(by).agg(F.greatest(F.lit(0.0), 100 - F.sum(weight * F.col("confidence"))).alias("posture"), F.count("*").alias("n"))


def causal_edges(memories: DataFrame, least: float = 0.3, window_hours: float = 24.0) -> DataFrame:
    """Earlier to later memories of one entity within the window, by proximity in time and like type.

    Blocked on the entity and on windows of time, so no pair outside a window is formed.
    """
    hours = F.unix_micros(F.col("transaction_time").cast("timestamp")) / 3_600_000_000
    b = memories.select("entity", "memory_id", "memory_type", hours.alias("h")).withColumn("w", F.floor(F.col("h") / window_hours))
    x = b.select("entity", F.col("memory_id").alias("source"), F.col("memory_type").alias("ta"), F.col("h").alias("ha"), F.explode(F.array(F.col("w"), F.col("w") + 1)).alias("w"))
    y = b.select("entity", F.col("memory_id").alias("target"), F.col("memory_type").alias("tb"), F.col("h").alias("hb"), "w")
    gap = F.col("hb") - F.col("ha")
    s = 0.6 * F.exp(-gap / 8.0) + 0.4 * (F.col("ta") == F.col("tb")).cast("double")
    j = x.join(y, ["entity", "w"]).where((F.col("source") != F.col("target")) & (gap >= 0) & (gap < window_hours))
    return j.withColumn("strength", s).where(F.col("strength") >= least).select("source", "target", "strength")


def latest_rank(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def split_budget(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole shares of a budget by weight; what rounding leaves goes to the largest."""
    scale = sum(weights.values())
    out = {k: int(total * w / scale) for k, w in weights.items()}
    out[max(weights, key=weights.get)] += total - sum(out.values())
    return out
