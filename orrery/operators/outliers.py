"""Outlier detection per group: built-in aggregates and windows where they suffice, grouped pandas where a test removes points one by one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, group: str, value: str, limit: float = 2.5, rounds: int = 3) -> DataFrame:
    """Mask |z| > limit by sample deviation, then again over what is left, ``rounds`` times in all.

    The moments are partial aggregates joined back on the group, so a large group isn't sorted.
    """
    out = df.withColumn("is_outlier", F.lit(False))
    for _ in range(rounds):
        m = out.where(~F.col("is_outlier")).groupBy(group).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
        z = F.abs(F.col(value) - F.col("_m")) / F.col("_s")
        out = out.join(m, group, "left").withColumn("is_outlier", F.col("is_outlier") | F.coalesce((F.col("_s") > 0) & (z > limit), F.lit(False))).drop("_m", "_s")
    return out


def iqr(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """Outside the fences at linearly interpolated quartiles; without spread, whatever isn't the median."""
    q = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    low, mid, high = (F.col("_q")[i] for i in range(3))
    v, span = F.col(value), high - low
    out = df.join(q, group)
    return out.withColumn("is_outlier", F.when(span == 0, v != mid).otherwise((v < low - k * span) | (v > high + k * span))).drop("_q")


def mad(df: DataFrame, group: str, value: str, limit: float = 3.5) -> DataFrame:
    """Modified z by the median absolute deviation; without one, whatever isn't the median."""
    med = df.groupBy(group).agg(F.median(value).alias("_med"))
    a = df.join(med, group)
    dev = a.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    a = a.join(dev, group)
    z = 0.6745 * F.abs(F.col(value) - F.col("_med")) / F.col("_mad")
    return a.withColumn("is_outlier", F.when(F.col("_mad") == 0, F.col(value) != F.col("_med")).otherwise(z > limit)).drop("_med", "_mad")


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    """Upper-half quantile of Student's t, by its beta relation."""
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x) if x > 0 else math.inf


def grubbs_limit(n: int, alpha: float = 0.05) -> float:
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def grubbs(df: DataFrame, group: str, key: str, value: str, alpha: float = 0.05, most: int = 100_000) -> DataFrame:
    """The one point farthest from each group's mean, if it exceeds the critical value. One row per group.

    Critical values depend on the group's size alone: the sizes that occur are looked up
    in pandas, ``most`` of them at a time.
    """
    m = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    far = df.join(m, group).groupBy(group, "n", "s").agg(F.max_by(F.struct(F.col(key).alias("k"), F.abs(F.col(value) - F.col("m")).alias("dev")), F.struct(F.abs(F.col(value) - F.col("m")), F.col(key))).alias("x"))

    @F.pandas_udf("double")
    def limit(n: pd.Series) -> pd.Series:
        return n.map({v: grubbs_limit(int(v), alpha) if v >= 3 else math.inf for v in n.unique()})

    g = far.select(group, "n", F.col("x.k").alias(key), (F.col("x.dev") / F.col("s")).alias("g"), limit("n").alias("critical"))
    return g.withColumn("is_outlier", F.coalesce(F.col("g") > F.col("critical"), F.lit(False)))


def esd_flags(values: np.ndarray, alpha: float = 0.05, most: int = 10) -> np.ndarray:
    """Generalised extreme Studentized deviate: up to ceil(sqrt(n)) points, ``most`` at most."""
    n, left = len(values), np.ones(len(values), bool)
    flags = np.zeros(n, bool)
    if n < 3:
        return flags
    removed, last = [], 0
    for i in range(1, min(math.ceil(math.sqrt(n)), most, n - 2) + 1):
        x = values[left]
        s = x.std(ddof=1)
        if not s > 0:
            break
        dev = np.where(left, np.abs(values - x.mean()), -1)
        at = int(dev.argmax())
        p, dof = 1 - alpha / (2 * (n - i + 1)), n - i - 1
        t = t_quantile(p, dof)
        if dev[at] / s > (n - i) * t / math.sqrt((dof + t * t) * (n - i + 1)):
            last = i
        removed.append(at)
        left[at] = False
    flags[removed[:last]] = True
    return flags


def esd(df: DataFrame, group: str, key: str, value: str, alpha: float = 0.05, most: int = 10) -> DataFrame:
    """Generalised ESD per group.

    At most ``most`` points can be removed, always from either end, so only a group's
    ``most`` largest and smallest values and its moments reach pandas, whatever its size.
    """
    cells = df.select(group, key, F.col(value).cast("double").alias("v")).where("v is not null")
    m = cells.groupBy(group).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    low = F.row_number().over(Window.partitionBy(group, "_part").orderBy("v", key))
    high = F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.desc("v"), key))
    parted = cells.withColumn("_part", F.spark_partition_id())
    ends = parted.withColumn("_lo", low).withColumn("_hi", high).where((F.col("_lo") <= most) | (F.col("_hi") <= most)).drop("_part", "_lo", "_hi")
    rows = ends.join(m, group)
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, v double, is_outlier boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, total = int(pdf["n"].iloc[0]), pdf["m"].iloc[0], pdf["var"].iloc[0] * pdf["n"].iloc[0]
        pdf = pdf.sort_values(["v", key], ignore_index=True)
        v, used, flagged, removed, last = pdf["v"].to_numpy(), set(), set(), [], 0
        left, s1, s2 = n, 0.0, total  # sums of deviations from the first mean
        for i in range(1, min(math.ceil(math.sqrt(n)), most, n - 2) + 1):
            mu = s1 / left
            s = math.sqrt(max(0.0, (s2 - left * mu * mu) / (left - 1)))
            if s <= 1e-12:
                break
            dev = [(-1.0 if k in used else abs(x - mean - mu)) for k, x in enumerate(v)]
            at = int(np.argmax(dev))
            t = t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
            if dev[at] / s > (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1)):
                last = i
            used.add(at)
            removed.append(at)
            x = v[at] - mean
            s1, s2, left = s1 - x, s2 - x * x, left - 1
        flagged = set(removed[:last])
        pdf["is_outlier"] = [k in flagged for k in range(len(pdf))]
        return pdf.loc[pdf["is_outlier"], [group, key, "v", "is_outlier"]]

    return rows.groupBy(group).applyInPandas(run, schema)


def method_for(df: DataFrame, group: str, value: str) -> DataFrame:
    """Which test suits a group: by size, and from 30 on by population skewness and excess kurtosis."""
    m = df.groupBy(group).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    normal = (F.abs("skew") <= 2) & (F.abs("kurt") <= 7)
    method = F.when(F.col("n") >= 30, F.when(normal, "zscore").otherwise("iqr")).when(F.col("n") >= 25, F.when(normal, "esd").otherwise("mad")).when(F.col("n") >= 10, F.when(normal, "grubbs").otherwise("mad")).otherwise("rules")
    return m.withColumn("method", method)


def ensemble(flags: dict[str, DataFrame], keys: list[str], score: str) -> DataFrame:
    """Union of methods: each point's methods, its best score boosted by half their number (1.5 at most)."""
    parts = [df.where("is_outlier").select(*keys, F.col(score).alias("score"), F.lit(name).alias("method")) for name, df in flags.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    g = both.groupBy(*keys).agg(F.array_sort(F.collect_set("method")).alias("methods"), F.max("score").alias("score"))
    n = F.size("methods")
    return g.select(*keys, F.array_join("methods", ",").alias("methods"), F.when(n > 1, F.col("score") * F.least(n / 2.0, F.lit(1.5))).otherwise(F.col("score")).alias("score"))
