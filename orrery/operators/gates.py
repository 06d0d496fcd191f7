"""Quality gates, policies, trends and feedback roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.relational import SEVERITY_ORDER, rank_of

# Gate -> (pass mark, weight).
GATES = {"pattern_compliance": (70.0, 0.5), "security": (80.0, 0.3), "suppression": (50.0, 0.2)}


def health(confidence: Column, approval: Column, compliance: Column, cross_validation: Column, duplicate_free: Column) -> Column:
    return 0.30 * confidence + 0.20 * approval + 0.20 * compliance + 0.15 * cross_validation + 0.15 * duplicate_free


def trend(daily: DataFrame, metric: str, day: str, value: str, margin: float = 2.0) -> DataFrame:
    """Mean of the last seven points minus the mean of the seven before."""
    k = F.row_number().over(Window.partitionBy(metric).orderBy(F.desc(day)))
    last, prev = F.avg(F.when(F.col("k") <= 7, F.col(value))), F.avg(F.when(F.col("k").between(8, 14), F.col(value)))
    g = daily.withColumn("k", k).groupBy(metric).agg((last - prev).alias("delta"))
    return g.withColumn("trend", F.when(F.col("delta") > margin, "improving").when(F.col("delta") < -margin, "declining").otherwise("stable"))


def feedback(rows: DataFrame, by: str) -> DataFrame:
    fp = (F.col("action") == "dismiss") & (F.coalesce(F.col("reason"), F.lit("")) == "false_positive")
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "fix").alias("fixes"), F.count_if(F.col("action") == "dismiss").alias("dismissals"), F.count_if(fp).alias("fps"))
    acted = F.col("fixes") + F.col("dismissals")
    return g.select(by, "n", "fixes", "dismissals", F.try_divide("fps", acted).alias("fp_rate"), (F.col("fixes") / F.col("n")).alias("action_rate"), ((F.col("n") >= 10) & (F.col("fps") > 0.2 * acted)).alias("disable"))


def alpha_beta(rows: DataFrame, by: str) -> DataFrame:
    """Evidence for and against a detector from what its readers did."""
    a, reason = F.col("action"), F.coalesce(F.col("reason"), F.lit(""))
    alpha = F.when(a == "fix", 1.0).when(a == "escalate", 0.5).otherwise(0.0)
    beta = F.when((a == "dismiss") & (reason == "false_positive"), 0.5).when((a == "dismiss") & reason.isin("wont_fix", "duplicate"), 0.0).when(a == "dismiss", 0.25).when(a == "suppress", 0.1).otherwise(0.0)
    return rows.groupBy(by).agg(F.sum(alpha).alias("alpha"), F.sum(beta).alias("beta"))


def dedup_highest(violations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its most severe severity and the number merged."""
    g = violations.groupBy(*keys).agg(F.min(rank_of(F.col("severity"), SEVERITY_ORDER)).alias("r"), F.count("*").alias("n"))
    return g.select(*keys, F.element_at(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("r") + 1).alias("severity"), "n")


def gate_rows(violations: DataFrame, by: str) -> DataFrame:
    """A row per group and gate, from one aggregation."""
    s = F.col("severity")
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    g = violations.groupBy(by).agg(share(s != "error").alias("pattern_compliance"), share(~((s == "error") & F.col("is_new"))).alias("security"), share(~F.col("suppressed")).alias("suppression"))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("score"), F.lit(t).alias("threshold"), F.lit(w).alias("weight")) for n, (t, w) in GATES.items()))).alias("x")
    return g.select(by, cells).select(by, "x.*").withColumn("passed", F.col("score") >= F.col("threshold"))


#: What each gate waits for; the others are independent.
GATE_DEPENDENCIES = {"pattern_compliance": [], "constraints": ["pattern_compliance"], "security": ["pattern_compliance"], "coverage": [], "error_handling": [], "regression": []}


def gates_in_order(measures: DataFrame, by: str, *, compliance: float, constraints: float, coverage: float) -> DataFrame:
    """A row per group and gate with score and state: passed, failed, or skipped where a gate it waits for didn't pass.

    measures: n, outliers, passing, secure_errors, gaps, coverage and drop (share of errors
    now less that before) per group. A new security error or an unhandled gap fails its gate.
    """
    part = lambda c: 100.0 * c / F.col("n")
    score = {
        "pattern_compliance": part(F.col("n") - F.col("outliers")), "constraints": part(F.col("passing")), "security": part(F.col("n") - F.col("secure_errors")),
        "coverage": 100.0 * F.col("coverage"), "error_handling": part(F.col("n") - F.col("gaps")), "regression": -100.0 * F.col("drop"),
    }
    passed = {
        "pattern_compliance": score["pattern_compliance"] >= compliance, "constraints": score["constraints"] >= constraints, "security": F.col("secure_errors") == 0,
        "coverage": F.col("coverage") >= coverage, "error_handling": F.col("gaps") == 0, "regression": score["regression"] > -15,
    }
    state: dict[str, Column] = {}
    for gate in run_order(GATE_DEPENDENCIES):
        waits = F.lit(True)
        for other in GATE_DEPENDENCIES[gate]:
            waits = waits & (state[other] == "passed")
        state[gate] = F.when(~waits, "skipped").when(passed[gate], "passed").otherwise("failed")
    cells = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.round(score[g], 4).alias("score"), s.alias("state")) for g, s in state.items()))).alias("x")
    return measures.select(by, cells).select(by, "x.*")


def policy(gates: DataFrame, by: str, mode: str) -> DataFrame:
    """all, any, weighted (mean by weight at least 72) or threshold (plain mean at least 70)."""
    rule = {
        "all": F.bool_and("passed"),
        "any": F.bool_or("passed"),
        "weighted": F.sum(F.col("weight") * F.col("score")) / F.sum("weight") >= 72.0,
        "threshold": F.avg("score") >= 70.0,
    }[mode]
    return gates.groupBy(by).agg(rule.alias("passed"))


def run_order(dependencies: dict[str, list[str]]) -> list[str]:
    """Gates so that each comes after what it depends on; a cycle is an error."""
    order, left = [], {g: set(d) for g, d in dependencies.items()}
    while left:
        ready = sorted(g for g, d in left.items() if not d & left.keys())
        if not ready:
            raise ValueError(f"gates depend on each other: {sorted(left)}")
        order += ready
        for g in ready:
            del left[g]
    return order
