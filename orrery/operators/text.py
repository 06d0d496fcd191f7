"""Text rules: personal data, secrets, redaction, sentences, contracts, intents."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.similarity import textrank_scores


@dataclass(frozen=True)
class Pattern:
    """``guard`` is a string, or a class of characters, without which a text can't match."""

    name: str
    regex: str
    confidence: float
    group: str
    guard: str


# Patterns of connection strings, secrets and personal data, in the order in which they are redacted.
PATTERNS = (
    Pattern("postgresql", r"(?i)postgres(?:ql)?://[^:]+:[^@]+@[^\s]+", 0.90, "connection", "://"),
    Pattern("mysql", r"(?i)mysql://[^:]+:[^@]+@[^\s]+", 0.90, "connection", "://"),
    Pattern("mongodb", r"(?i)mongodb(?:\+srv)?://[^:]+:[^@]+@[^\s]+", 0.90, "connection", "://"),
    Pattern("redis", r"(?i)redis://(?:[^:]+:[^@]+@)?[^\s]+", 0.85, "connection", "://"),
    Pattern("mssql", r"(?i)(?:Server|Data Source)=[^;]+;.*(?:Password|Pwd)=[^;]+", 0.85, "connection", ";"),
    Pattern("jdbc", r"(?i)jdbc:[a-z]+://[^:]+:[^@]+@[^\s]+", 0.85, "connection", "://"),
    Pattern("odbc", r"(?i)(?:DSN|Driver)=[^;]+;.*(?:PWD|Password)=[^;]+", 0.80, "connection", ";"),
    Pattern("base64_secret", r"(?i)(?:secret|key|password|token|credential)\s*[=:]\s*['\"]?[A-Za-z0-9+/]{40,}={0,2}['\"]?", 0.70, "connection", "[=:]"),
    Pattern("aws_key", r"\bAKIA[0-9A-Z]{16}\b", 0.95, "secret", "AKIA"),
    Pattern("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0.98, "secret", "-----BEGIN"),
    Pattern("bearer_token", r"\b(?:token|secret|api_key|TOKEN|SECRET|API_KEY) ?= ?\"[0-9A-Za-z_\-]{16,}\"", 0.85, "secret", "\""),
    Pattern("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.95, "pii", "@"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.95, "pii", "[0-9]"),
    Pattern("credit_card", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{3,4}\b", 0.90, "pii", "[0-9]"),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?\d{0,16})\b", 0.85, "pii", "[0-9]"),
    Pattern("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", 0.70, "pii", "[:-]"),
    Pattern("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.75, "pii", ":"),
    Pattern("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.70, "pii", "[0-9]"),
    Pattern("phone", r"(?:^|\s)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:\s|$)", 0.80, "pii", "[0-9]"),
    Pattern("dob", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", 0.75, "pii", "[0-9]"),
    Pattern("medicare", r"\b\d{3}-\d{3}-\d{3}\b", 0.70, "pii", "[0-9]"),
    Pattern("passport", r"\b[A-Z]\d{8}\b", 0.60, "pii", "[0-9]"),
    Pattern("drivers_license", r"\b[A-Z]\d{7,14}\b", 0.50, "pii", "[0-9]"),
    Pattern("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", 0.50, "pii", "[A-Z0-9]{17}"),
    Pattern("address", r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s?){1,4}(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Ln|Lane|Rd|Road|Ct|Court|Pl|Place|Way)\b", 0.65, "pii", "[0-9]"),
    Pattern("national_id", r"\b\d{8,12}\b", 0.30, "pii", "[0-9]"),
)


def _may_match(text: Column, p: Pattern) -> Column:
    return text.rlike(p.guard) if p.guard.startswith("[") else text.contains(p.guard)


# Placeholders that are no finding.
PLACEHOLDERS = r"(?i)example\.(com|org|net)|your[_-]?|placeholder|xxxx|<[a-z_]+>"


def counts(text: Column) -> list[Column]:
    """A count per pattern."""
    return [F.when(text.isNull(), None).when(_may_match(text, p), F.regexp_count(text, F.lit(p.regex))).otherwise(0).cast("bigint").alias(p.name) for p in PATTERNS]


def redact(text: Column, least: float = 0.40) -> Column:
    """Each match becomes [NAME]; patterns run in order, so a replaced span isn't matched again."""
    out = text
    for p in PATTERNS:
        if p.confidence >= least:
            out = F.regexp_replace(out, p.regex, f"[{p.name.upper()}]")
    return out


def findings(df: DataFrame, key: str, text: str, least: float = 0.40) -> DataFrame:
    """(key, name, value, confidence) of every match, after placeholders and context are weighed."""
    def matches(p: Pattern) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), lambda m: F.struct(F.lit(p.name).alias("name"), m.alias("value"), F.lit(p.confidence).alias("base")))

    each = [matches(p) for p in PATTERNS]
    rows = df.select(key, F.explode(F.concat(*each)).alias("m"), F.col(text).rlike(r"(?i)\b(test|mock|fixture)\b").alias("_test"), F.col(text).rlike(r"(?i)process\.env|os\.environ|getenv").alias("_env"))
    score = F.col("m.base") - F.when(F.col("_test"), 0.2).otherwise(0.0) - F.when(F.col("_env"), 0.15).otherwise(0.0)
    out = rows.where(~F.col("m.value").rlike(PLACEHOLDERS)).select(key, "m.name", "m.value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))
    return out.where(F.col("confidence") >= least)


def sentences(text: Column) -> Column:
    """Parts that end with . ! or ?, trimmed, empty ones out."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def textrank(df: DataFrame, key: str, text: str, top: int = 2) -> DataFrame:
    """The ``top`` best sentences of each document in their order, ranked over the whole document."""

    def run(frames):
        for pdf in frames:
            out = []
            for k, parts in zip(pdf[key], pdf["_s"]):
                if parts is None:
                    continue
                score = textrank_scores([s.lower().split() for s in parts])
                best = sorted(range(len(parts)), key=lambda i: (-round(score[i], 9), i))[:top]
                out += [(k, i, parts[i], score[i]) for i in sorted(best)]
            yield pd.DataFrame(out, columns=[key, "position", "sentence", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, sentences(F.col(text)).alias("_s")).mapInPandas(run, f"{key} {kind}, position int, sentence string, score double")


def pack_budget(df: DataFrame, session: str, key: str, priority: str, tokens: str, budget: int) -> DataFrame:
    """Greedy packing per session by priority: an item that doesn't fit is skipped and the next is tried.

    Only items that fit alone are looked at, and of them at most budget / least tokens can
    be chosen; the walk keeps one number a session, so it streams over sorted rows.
    """
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (session, key, tokens)]

    def run(frames):
        now, left = object(), budget
        for pdf in frames:
            taken = []
            for s, t in zip(pdf[session], pdf[tokens]):
                if s != now:
                    now, left = s, budget
                fits = t <= left
                left -= t if fits else 0
                taken.append(bool(fits))
            yield pdf[taken]

    rows = df.select(session, key, tokens, priority).where(F.col(tokens) <= budget)
    rows = rows.repartition(session).sortWithinPartitions(session, F.desc(priority), key).select(session, key, tokens)
    return rows.mapInPandas(run, ", ".join(kinds))


# Sensitivity keywords, first match wins.
SENSITIVE = (("auth", ("password", "token", "secret", "credential")), ("payment", ("card", "iban", "invoice", "payment")), ("personal", ("email", "phone", "address", "birth")))


def sensitivity(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(F.lit(False), "none")
    for label, words in SENSITIVE:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, label)
    return out.otherwise("none")


def endpoints(pages: DataFrame, url: str = "url") -> DataFrame:
    """Host, path and parameterised path of URLs: numeric segments become :id."""
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return pages.select("*", F.regexp_extract(F.col(url), r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_replace(path, r"/[0-9]+", "/:id").alias("route"))


def match_contracts(backend: DataFrame, frontend: DataFrame, least: float = 0.5) -> DataFrame:
    """Backend and frontend routes of one method with path similarity >= least, blocked on the segment count and the first fixed segment."""
    from orrery.functions.scores import path_similarity

    segs = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    block = lambda df, c: df.withColumn("_n", F.size(segs(F.col(c)))).withColumn("_f", F.coalesce(F.get(segs(F.col(c)), F.lit(0)), F.lit("")))
    b, f = block(backend.withColumnRenamed("route", "b_route"), "b_route"), block(frontend.withColumnRenamed("route", "f_route"), "f_route")
    return b.join(f, ["method", "_n", "_f"]).withColumn("similarity", path_similarity(F.col("b_route"), F.col("f_route"))).where(F.col("similarity") >= least).select("method", "b_route", "f_route", "similarity")


# Retrieval intents by keyword, first match wins.
INTENTS = (("fix_bug", "bug|error|fix|crash"), ("understand", "why|how|explain|what"), ("add_feature", "add|implement|create|build"), ("review", "review|check|audit"))


def intent(text: Column) -> Column:
    out = F.when(F.lit(False), "general")
    for name, words in INTENTS:
        out = out.when(F.lower(text).rlike(rf"\b({words})\b"), name)
    return out.otherwise("general")


# Query expansion.
SYNONYMS = {"auth": ["authentication", "login"], "db": ["database", "storage"], "bug": ["error", "defect"], "test": ["spec", "check"]}


def expand_terms(terms: list[str]) -> list[str]:
    out: list[str] = []
    for t in terms:
        out += [t, *SYNONYMS.get(t.lower(), [])]
    return list(dict.fromkeys(out))
