"""Column formulas: confidence, decay, freshness, trust, calibration and the like.

All are plain expressions, so they stay inside whole-stage code. Weights and
thresholds are fixed values that results depend on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted(*terms: tuple[float, Column]) -> Column:
    return reduce(lambda a, b: a + b, (w * c for w, c in terms))


def steps(c: Column, *marks: tuple[float, object], otherwise) -> Column:
    """The value of the first mark that ``c`` reaches."""
    out = F.when(F.lit(False), F.lit(None))
    for mark, value in marks:
        out = out.when(c >= mark, F.lit(value))
    return out.otherwise(F.lit(otherwise))


# Beta posterior

def beta_alpha(k: Column) -> Column:
    return 1.0 + k


def beta_beta(k: Column, n: Column) -> Column:
    return 1.0 + F.greatest(n - k, F.lit(0))


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def beta_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1.0))


def tier(score: Column) -> Column:
    return steps(score, (0.85, "established"), (0.70, "emerging"), (0.50, "tentative"), otherwise="uncertain")


def age_factor(days: Column) -> Column:
    """0.1 on the first day to 1.0 from 30 days on."""
    return F.when(days <= 0, 0.1).when(days >= 30, 1.0).otherwise(0.1 + 0.9 * days / 30.0)


def staleness_decay(days: Column) -> Column:
    """1 for a week, then linearly down to 0.1 at 90 days."""
    return F.when(days <= 7, 1.0).when(days >= 90, 0.1).otherwise(1.0 - 0.9 * (days - 7) / 83.0)


def factor_score(frequency: Column, consistency: Column, age: Column, spread: Column, momentum: Column, quality: Column) -> Column:
    return weighted((0.25, frequency), (0.20, consistency), (0.10, age), (0.15, spread), (0.15, momentum), (0.15, quality))


def evidence_blend(prior: Column, score: Column, n: Column) -> Column:
    """A prior gives way to the score at the rate n / (n + 10)."""
    w = n / (n + 10.0)
    return prior * (1 - w) + score * w


# Time

def decay_product(confidence: Column, days: Column, half_life: Column, citations: Column, uses: Column, importance: Column, boost: Column) -> Column:
    """Confidence after e-folding decay and its boosts, within [0, 1]."""
    return clamp(confidence * F.exp(-days / half_life) * citations * uses * importance * boost)


def usage_factor(count: Column) -> Column:
    return F.least(F.lit(1.5), 1.0 + F.log1p(count) * 0.1)


def importance_weight(importance: Column) -> Column:
    return F.when(importance == "critical", 2.0).when(importance == "high", 1.5).when(importance == "normal", 1.0).otherwise(0.8)


def half_life_days(memory_type: Column) -> Column:
    return F.when(memory_type == "1-URGENT", 365.0).when(memory_type == "2-HIGH", 180.0).when(memory_type == "3-MEDIUM", 90.0).when(memory_type == "4-NOT SPECIFIED", 60.0).otherwise(30.0)


def user_validation(days: Column) -> Column:
    """True halving every 90 days."""
    return F.exp(-0.693 * days / 90.0)


def temporal_proximity(hours: Column) -> Column:
    """e-folding over 8 hours, nothing from a day on."""
    return F.when(F.abs(hours) >= 24, 0.0).otherwise(F.exp(-F.abs(hours) / 8.0))


def validity(age_days: Column, half_life: Column, expired: Column) -> Column:
    return F.when(expired, 0.0).otherwise(F.pow(F.lit(2.0), -age_days / half_life))


def day_part(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 23), "evening").otherwise("night")


# Trust and review

def trust(positive: Column, negative: Column, n: Column) -> Column:
    return positive / (n + 1.0) * (1.0 - negative / (n + 1.0))


def trust_decay(value: Column, days: Column, rate: float = 0.99) -> Column:
    """Toward 0.5 by 1 - rate**days."""
    return value + (0.5 - value) * (1.0 - F.pow(F.lit(rate), days))


def calibrate(base: Column, evidence: Column, validations: Column, uses: Column, age_days: Column, half_life: float = 90.0) -> Column:
    log10 = lambda c: F.least(F.lit(1.0), F.log1p(c) / F.log(F.lit(11.0)))
    return clamp(weighted((0.30, base), (0.25, log10(evidence)), (0.15, log10(validations)), (0.15, log10(uses)), (0.15, F.pow(F.lit(0.5), age_days / half_life))))


def relevance(similarity: Column, keyword: Column, recency: Column, confidence: Column, importance: Column, usage: Column) -> Column:
    return weighted((0.22, similarity), (0.13, keyword), (0.10, recency), (0.10, confidence), (0.10, importance), (0.08, usage))


def risk_score(blast: Column, sensitivity: Column, coverage: Column, complexity: Column, churn: Column) -> Column:
    return clamp(weighted((0.30, blast), (0.25, sensitivity), (0.20, 1.0 - coverage), (0.15, complexity), (0.10, churn)))


def complexity_from_lines(lines: Column) -> Column:
    return F.when(lines <= 10, 0.1).when(lines <= 30, 0.3).when(lines <= 60, 0.5).when(lines <= 100, 0.7).otherwise(1.0)


def chain_confidence(values: Column) -> Column:
    """(0.6 least + 0.4 mean) * 0.95 ** links of an array."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return (0.6 * F.array_min(values) + 0.4 * mean) * F.pow(F.lit(0.95), F.size(values))


def provenance_confidence(deltas: Column) -> Column:
    """Product of 1 + delta within [0, 1]; an empty chain is 1."""
    return clamp(F.aggregate(deltas, F.lit(1.0), lambda a, x: a * (1.0 + x)))


# Severity and decisions

def progressive_severity(severity: Column, age_days: Column, ramp_days: float, new_file: Column) -> Column:
    """While a project's ramp lasts errors start as info, then warnings, and warnings as info; new files are judged in full."""
    part = age_days / ramp_days
    soft = F.when((severity == "error") & (part < 0.25), "info").when((severity == "error") & (part < 0.5), "warning").when((severity == "warning") & (part < 0.5), "info").otherwise(severity)
    return F.when(new_file | (part >= 1), severity).otherwise(soft)


def promotable(posterior_mean: Column, files: Column, least_files: int = 5) -> Column:
    """Established, and spread over enough files."""
    return (posterior_mean >= 0.85) & (files >= least_files)


def auto_approve(confidence: Column, outlier_ratio: Column, locations: Column, errors: Column) -> Column:
    sure = (confidence >= 0.90) & (outlier_ratio <= 0.50) & (locations >= 3) & ~errors
    return F.when(sure, "approve").when(confidence >= 0.70, "review").otherwise("likely_false_positive")


def merge_decision(similarity: Column) -> Column:
    return steps(similarity, (0.95, "auto_merge"), (0.85, "flag_for_review"), otherwise="separate")


def audit_duplicate_tier(similarity: Column) -> Column:
    return F.when(similarity > 0.95, "auto_merge").when(similarity > 0.90, "merge").when(similarity >= 0.85, "review").otherwise("none")


def coupling_zone(instability: Column, abstractness: Column) -> Column:
    d = F.abs(abstractness + instability - 1.0)
    return F.when(d <= 0.3, "main_sequence").when((abstractness < 0.5) & (instability < 0.5), "pain").when((abstractness > 0.5) & (instability > 0.5), "useless").otherwise("main_sequence")


# Names and paths that callers outside the graph may reach, in the order they are tried.
DEAD_CODE_EXCLUSIONS = (
    ("entry_point", "^(main|index|default|run|start|init)$", None),
    ("event_handler", "(?i)^on|^handle|listener|callback|subscriber|observer", None),
    ("reflection", "(?i)invoke|reflect|dynamic|proxy", None),
    ("dependency_injection", "(?i)inject|provide|factory|service|repository", None),
    ("test_utility", "(?i)^test|^spec_|^it_|mock|stub|fixture|helper", "(?i)test|spec"),
    ("framework_hook", "^(componentDidMount|componentDidUpdate|componentWillUnmount|getDerivedStateFromProps|shouldComponentUpdate|getSnapshotBeforeUpdate|componentDidCatch|render|created|mounted|updated|destroyed|beforeCreate|beforeMount|beforeUpdate|beforeDestroy|setup|onMounted|onUpdated|onUnmounted|ngOnInit|ngOnDestroy|ngOnChanges|ngAfterViewInit|ngAfterContentInit|ngDoCheck|__init__|__del__|__enter__|__exit__|__call__)$", None),
    ("decorator", "(?i)route|api|endpoint|controller|middleware|plugin", None),
    ("interface_impl", "::|^[A-Z][^./]*[.]", None),
    ("conditional_compilation", "(?i)cfg|ifdef|platform", "(?i)platform|arch"),
    ("dynamic_import", "(?i)lazy|dynamic|loadable|async_import", None),
)


def dead_code_exclusion(name: Column, path: Column, entry: Column, exported: Column) -> Column:
    """Why a function without callers may still be called; null where nothing says so."""
    out = F.when(entry | exported, "entry_point")
    for why, pattern, where in DEAD_CODE_EXCLUSIONS:
        out = out.when(name.rlike(pattern) | (path.rlike(where) if where else F.lit(False)), why)
    return out


def dead_code_confidence(name: Column, path: Column) -> Column:
    common = F.when(name.rlike("(?i)handler|callback|listener|hook|middleware|plugin|factory|provider|service"), 0.2).otherwise(0.0)
    brief = F.when(F.length(name) <= 3, 0.15).otherwise(0.0)
    test = F.when(path.rlike("(?i)test"), 0.1).otherwise(0.0)
    return clamp(0.9 - common - brief - test, 0.1, 1.0)


# Text and arrays

def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4.0).cast("bigint")


def naming_style(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake_case").when(name.rlike("^[a-z][a-z0-9]*([A-Z][A-Za-z0-9]*)+$"), "camelCase")
        .when(name.rlike("^[A-Z][a-z0-9]+([A-Z][A-Za-z0-9]*)*$"), "PascalCase").when(name.rlike("^[A-Z][A-Z0-9_]*$"), "SCREAMING").otherwise("other")
    )


def normal_name(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", ""))


def path_similarity(a: Column, b: Column) -> Column:
    """Share of positions with equal segments; ``:x`` and ``{x}`` match anything."""
    wild = lambda s: s.startswith(":") | s.startswith("{")
    x, y = (F.filter(F.split(c, "/"), lambda s: s != "") for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.when(p.isNull() | q.isNull(), 0).when((p == q) | wild(p) | wild(q), 1).otherwise(0))
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest == 0, 1.0).otherwise(F.aggregate(same, F.lit(0), lambda s, v: s + v) / longest)


def types_compatible(a: Column, b: Column) -> Column:
    family = lambda c: F.when(c.isin("int", "integer", "float", "double", "number", "long"), "number").when(c.isin("string", "str", "text", "uuid"), "string").when(c.isin("bool", "boolean"), "boolean").otherwise(c)
    return (a == "any") | (b == "any") | (family(F.lower(a)) == family(F.lower(b)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; ``empty`` for two empty ones (0 among patterns, 1 among notes)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for different sizes or a zero vector, else within [-1, 1]."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(clamp(dot(a, b) / norms, -1.0, 1.0))


def matryoshka(v: Column, dims: int) -> Column:
    """The first ``dims`` components, scaled to unit length."""
    head = F.slice(v, 1, dims)
    norm = F.sqrt(dot(head, head))
    return F.transform(head, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm))


def shannon_entropy(text: Column) -> Column:
    """Bits per character, by the counts of distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, 0.0).otherwise(-F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


def entropy_level(bits: Column) -> Column:
    return steps(bits, (5.0, "very_high"), (3.5, "high"), (2.0, "medium"), otherwise="low")
