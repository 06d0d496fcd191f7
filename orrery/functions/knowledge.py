"""Formulas over memories, evidence, contracts and findings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp, weighted

# Importance levels, rules (from, to, score, direction) in the order they are tried, and weights.
RECLASSIFICATION = (
    ("low", "normal", 0.7, "up"), ("normal", "high", 0.85, "up"), ("high", "critical", 0.95, "up"),
    ("critical", "high", 0.5, "down"), ("high", "normal", 0.3, "down"), ("normal", "low", 0.15, "down"),
)
CONTRACT_WEIGHTS = (0.25, 0.20, 0.15, 0.15, 0.10, 0.08, 0.07)
EVIDENCE_WEIGHTS = {
    "pattern_confidence": 0.18, "pattern_occurrence": 0.13, "false_positive_rate": 0.09, "constraint_verification": 0.09, "coupling_metric": 0.07, "dna_health": 0.07,
    "test_coverage": 0.09, "error_handling_gaps": 0.06, "decision_evidence": 0.07, "boundary_data": 0.05, "taint_analysis": 0.05, "call_graph_coverage": 0.05,
}


def adaptive_half_life(base: Column, accesses: Column, confidence: Column, links: Column) -> Column:
    """Base days stretched by use (up to 2), confidence (up to 1.5) and links (up to 1.3)."""
    use = clamp(1.0 + F.log10(accesses + 1.0) / 2.0, 1.0, 2.0)
    return base * use * (1.0 + 0.5 * confidence) * F.least(F.lit(1.3), 1.0 + 0.06 * F.least(links.cast("double"), F.lit(5.0)))


def reclass_composite(accesses: Column, rank: Column, entities: Column, wins: Column, feedback: Column) -> Column:
    ranked = F.when(rank > 0, clamp(1.0 - (rank - 1.0) / 9.0)).otherwise(0.0)
    cap = lambda c, n: F.least(F.lit(1.0), c / n)
    return clamp(weighted((0.35, cap(accesses, 20.0)), (0.25, ranked), (0.15, cap(entities, 3.0)), (0.10, cap(wins, 5.0)), (0.15, clamp(feedback))))


def reclassified(importance: Column, composite: Column) -> Column:
    """The new level, or null where no rule fits."""
    out = F.when(F.lit(False), F.lit(""))
    for old, new, score, way in RECLASSIFICATION:
        out = out.when((importance == old) & (composite > score if way == "up" else composite < score), new)
    return out


def weighted_trust(received: Column, validated: Column, useful: Column, contradicted: Column) -> Column:
    """Half at the start, then bonuses and penalties."""
    return F.when(received == 0, 0.5).otherwise(clamp(0.5 + 0.05 * validated + 0.03 * useful - 0.10 * contradicted))


def entity_overlap(files: Column, functions: Column, patterns: Column) -> Column:
    """From the three Jaccard similarities."""
    return F.least(F.lit(1.0), 0.4 * files + 0.35 * functions + 0.25 * patterns)


def semantic_overlap(tags: Column, same_type: Column, same_content: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * tags + 0.2 * F.when(same_type, 0.3).otherwise(0.0) + 0.3 * F.when(same_content, 1.0).otherwise(0.0))


def contract_confidence(signals: list[Column]) -> Column:
    return clamp(weighted(*((w, clamp(s)) for w, s in zip(CONTRACT_WEIGHTS, signals, strict=True))))


def grounding_verdict(score: Column) -> Column:
    return F.when(score >= 0.7, "validated").when(score >= 0.4, "partial").when(score >= 0.2, "weak").otherwise("invalidated")


def significance(deviation: Column) -> Column:
    return F.when(deviation >= 0.9, "critical").when(deviation >= 0.7, "high").when(deviation >= 0.4, "moderate").otherwise("low")


def violation_severity(tier: Column) -> Column:
    return F.when(tier.isin("critical", "high"), "error").when(tier == "moderate", "warning").otherwise("info")


def rule_outlier(value: Column, mean: Column, stddev: Column, sigmas: float = 3.0) -> Column:
    """Tier by the first rule that fits: no confidence, extreme deviation, a cliff below the mean; null otherwise."""
    return F.when(value <= 0, "high").when((stddev > 0) & (F.abs(value - mean) / stddev > sigmas), "critical").when((mean > 0) & ((mean - value) / mean > 0.5), "high")


def growth(mean_daily: Column) -> Column:
    return F.when(mean_daily > 5, "rapid").when(mean_daily < 0.5, "stagnant").otherwise("healthy")


def learning_mode(changed: Column, total: Column, threshold: float = 0.10) -> Column:
    return F.when(changed == 0, "skip").when((total > 0) & (changed / total > threshold), "full").otherwise("incremental")


def reach_sensitivity(user_input: Column, admin: Column, sql: Column, command: Column, file: Column, network: Column) -> Column:
    return F.when(user_input & (sql | command), "critical").when(user_input & (file | network), "high").when(admin & (sql | command | file), "medium").otherwise("low")
