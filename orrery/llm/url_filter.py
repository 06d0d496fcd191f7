"""URL filter: rules first, then a ratio of two character language models.

Models of rule-accepted and rule-rejected URLs are variable-order Markov chains over
a folded alphabet: a model uses the longest context, of two, one or no symbols, that
it has seen often enough, smoothed by the next shorter one. A URL's score is its mean
log-likelihood difference per character. The threshold is the one that best separates
ruled URLs that were not counted: about three in sixteen, told by the digest of the
URL, are held out for it. All of it is DataFrame functions; the table of differences
has one row per three symbols, 40**3 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path; it fits that host and its subdomains where the path starts with it."""

    verdict: str
    pattern: str

    def fits(self) -> Column:
        host, _, path = self.pattern.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, and from there up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.greatest(F.length(rest), F.lit(1))), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def _symbols(url: Column) -> Column:
    """The URL after its scheme in the folded alphabet, with two marks before it."""
    rest = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, UPPER.lower()), r"^[^:/]*://", "")
    return F.concat(F.lit("~~"), F.regexp_replace(rest, r"[^a-z0-9./-]", "~"))


def _grams(urls: DataFrame, *more: str) -> DataFrame:
    """A row per character of each URL with its two predecessors."""
    coded = urls.select("url", *more, _symbols(F.col("url")).alias("s")).where(F.length("s") > 2)
    at = coded.select("url", *more, "s", F.explode(F.sequence(F.lit(1), F.length("s") - 2)).alias("i"))
    return at.select("url", *more, F.substring("s", F.col("i"), F.lit(3)).alias("gram"))


def held_out(url: Column) -> Column:
    """Whether a URL calibrates the threshold instead of being counted."""
    return F.md5(url) < "3"


def _ratios(ruled: DataFrame, weight: float, least: int) -> DataFrame:
    """gram -> log P(accepted) - log P(rejected), for every three symbols.

    A context seen fewer than ``least`` times by a model is pruned from it.
    """
    n = len(ALPHABET)
    letter = lambda k: F.substring(F.lit(ALPHABET), (F.floor(F.col("id") / n**k) % n).cast("int") + 1, F.lit(1))
    cube = ruled.sparkSession.range(n**3).select(F.concat(letter(2), letter(1), letter(0)).alias("gram"))
    seen = _grams(ruled, "label").groupBy("gram").agg(*(F.count(F.when(F.col("label") == v, 1)).cast("double").alias(v) for v in ("allow", "block")))
    cells = cube.join(seen, "gram", "left").fillna(0.0)
    tri = cells.withColumns({"ab": F.substring("gram", 1, 2), "bc": F.substring("gram", 2, 2), "c": F.substring("gram", 3, 1), "b": F.substring("gram", 2, 1)})
    sums = lambda key: tri.groupBy(key).agg(F.sum("allow").alias(f"allow_{key}"), F.sum("block").alias(f"block_{key}"))
    total = tri.agg(F.sum("allow").alias("allow_n"), F.sum("block").alias("block_n")).first()
    # Each of these has at most 40**2 rows.
    wide = tri
    for key in ("ab", "bc", "b", "c"):
        wide = wide.join(F.broadcast(sums(key)), key)
    score = {}
    for v in ("allow", "block"):
        p1 = (F.col(f"{v}_c") + 1) / (float(total[f"{v}_n"]) + n)
        p2 = F.when(F.col(f"{v}_b") < least, p1).otherwise((F.col(f"{v}_bc") + weight * p1) / (F.col(f"{v}_b") + weight))
        score[v] = F.log(F.when(F.col(f"{v}_ab") < least, p2).otherwise((F.col(v) + weight * p2) / (F.col(f"{v}_ab") + weight)))
    return wide.select("gram", (score["allow"] - score["block"]).alias("ratio"))


def _scores(urls: DataFrame, ratios: DataFrame, *more: str) -> DataFrame:
    """Mean ratio per character of each URL; the table of ratios has at most 40**3 rows."""
    return _grams(urls, *more).join(F.broadcast(ratios), "gram").groupBy("url", *more).agg(F.avg("ratio").alias("score"))


def _threshold(scored: DataFrame) -> float:
    """The score, in hundredths, that keeps the most accepted and drops the most rejected URLs."""
    bins = scored.groupBy(F.greatest(F.lit(-800), F.least(F.lit(800), F.floor(F.col("score") * 100))).cast("int").alias("bin"))
    rows = sorted(bins.agg(F.count(F.when(F.col("label") == "allow", 1)).alias("a"), F.count(F.when(F.col("label") == "block", 1)).alias("b")).collect())
    good, bad = sum(r.a for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return 0.0
    best, at, below_a, below_b = -1.0, 0, 0, 0
    edges = {}
    for r in rows:
        edges[r.bin] = (below_a, below_b)
        below_a, below_b = below_a + r.a, below_b + r.b
    edges[rows[-1].bin + 1] = (below_a, below_b)
    for edge, (a, b) in edges.items():
        worth = (good - a) / good + b / bad
        if worth > best + 1e-12 or (abs(worth - best) <= 1e-12 and abs(edge) < abs(at)):
            best, at = max(best, worth), edge
    return at / 100


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, weight: float = 4.0, least: int = 8) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url).

    A fitting rule decides, the longest where several fit; else the models do: allow
    at a score of at least the threshold, which is 0 where no accepted or no rejected
    URL is held out. A URL without characters to score (null,
    empty) is allowed. Rows are returned as often as they occur; other columns are
    not read.

    Returns page_id, host, path, rule (null where none fits), verdict, score (null
    where a rule decides).
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    ranked = sorted(rules, key=lambda r: -len(r.pattern))
    pick = lambda what: F.coalesce(*(F.when(r.fits(), what(r)) for r in ranked), F.lit(None).cast("string"))
    base = base.withColumns({"rule": pick(lambda r: r.pattern), "ruled": pick(lambda r: r.verdict)})
    urls = keep(base.where("url is not null").select("url", F.col("ruled").alias("label")).distinct(), "url-distinct")
    ruled = urls.where("label is not null")
    ratios = keep(_ratios(ruled.where(~held_out(F.col("url"))), weight, least), "url-ratios")
    edge = _threshold(_scores(ruled.where(held_out(F.col("url"))), ratios, "label"))
    scores = _scores(urls.where("label is null").select("url"), ratios)
    judged = base.join(scores, "url", "left")
    verdict = F.coalesce("ruled", F.when(F.col("score") < edge, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
