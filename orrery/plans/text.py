"""Search, vectors, personal data, contracts over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.operators import similarity as M
from orrery.operators import text as X
from orrery.sources.facts import relation, table

from .registry import query

r6 = lambda c: F.round(c, 6)

_COS = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))))"


def _nearest(vectors: str) -> str:
    return f"""WITH e AS ({vectors}), p AS (SELECT vec_id AS query, embedding AS q FROM e WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round({_COS}, 9) AS c FROM e, p)
    SELECT query, vec_id, round(c, 5) AS score FROM s WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) <= 10"""


def _search(vectors):
    """Every row whose id is divisible by 50 is a query, against all rows."""
    return M.top_k_cosine(vectors, vectors.where("vec_id % 50 = 0"), 10).withColumn("score", F.round("score", 5))


@query("", _nearest("SELECT vec_id, embedding FROM embeddings"))
def cosine_topk(spark, d):
    return _search(table(spark, d, "embeddings").select("vec_id", "embedding"))


@query("", _nearest("SELECT vec_id, embedding[1:16] AS embedding FROM embeddings"))
def matryoshka_topk(spark, d):
    return _search(table(spark, d, "embeddings").select("vec_id", S.matryoshka(F.col("embedding"), 16).alias("embedding")))


@query("", "WITH c AS (SELECT label, avg(embedding[1]) AS a, avg(embedding[2]) AS b, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, round(a, 5) AS a, round(b, 5) AS b FROM c")
def vector_centroids(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0]), 5).alias("a"), F.round(F.avg(F.col("embedding")[1]), 5).alias("b"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_TERMS = ["thing", "the", "license"]
_BM25 = f"""b AS (SELECT doc_id, len({_WORDS}) AS length, list_filter({_WORDS}, lambda w: w IN ('thing', 'the', 'license')) AS hits FROM documents), st AS (SELECT count(*) AS n, avg(length) AS al FROM b),
    tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(hits) AS term FROM b) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score FROM tf JOIN df USING (term), st GROUP BY 1)"""


@query("", f"WITH {_BM25} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY round(bm.score, 8) DESC, doc_id LIMIT 20")
def bm25_search(spark, d):
    s = M.bm25(table(spark, d, "documents"), "doc_id", "text", _TERMS)
    return s.orderBy(F.desc(F.round("score", 8)), "doc_id").limit(20).select("doc_id", F.round("score", 5).alias("score"))


@query(
    "",
    f"""WITH {_BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 8) DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 100), l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 100)
    SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM l) GROUP BY 1""",
)
def rrf_fusion(spark, d):
    """Text score and length rank, the best hundred of each (the feature's own k)."""
    docs = table(spark, d, "documents")

    def ranked(df, *order):
        top = df.orderBy(*order).limit(100)
        return top.select("doc_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    a = ranked(M.bm25(docs, "doc_id", "text", _TERMS), F.desc(F.round("score", 8)), F.col("doc_id"))
    b = ranked(docs.select("doc_id", "n_chars"), F.desc("n_chars"), F.col("doc_id"))
    return M.reciprocal_rank_fusion([a, b], "doc_id").select("doc_id", F.round("rrf", 8).alias("rrf"))


@query(
    "memories",
    """WITH a AS (SELECT max(transaction_time) AS now FROM memories), x AS (SELECT memory_id, 0.22 * confidence + 0.13 * 0.5 + 0.10 * exp(-date_diff('day', CAST(transaction_time AS DATE), CAST(now AS DATE)) / 90.0) + 0.10 * confidence + 0.10 * CASE importance WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'normal' THEN 0.5 ELSE 0.25 END + 0.08 * least(1.0, access_count / 40.0) AS s FROM memories, a)
    SELECT memory_id, round(s, 6) AS relevance FROM x ORDER BY round(x.s, 9) DESC, memory_id LIMIT 50""",
)
def relevance_score(spark, d):
    m = relation(spark, d, "memories")
    now = F.broadcast(m.agg(F.max("transaction_time").alias("now")))  # one row
    imp = F.when(F.col("importance") == "critical", 1.0).when(F.col("importance") == "high", 0.75).when(F.col("importance") == "normal", 0.5).otherwise(0.25)
    recency = F.exp(-F.date_diff(F.to_date("now"), F.to_date("transaction_time")) / 90.0)
    s = S.relevance(F.col("confidence"), F.lit(0.5), recency, F.col("confidence"), imp, F.least(F.lit(1.0), F.col("access_count") / 40.0))
    return m.join(now).select("memory_id", s.alias("s")).orderBy(F.desc(F.round("s", 9)), "memory_id").limit(50).select("memory_id", r6(F.col("s")).alias("relevance"))


@query(
    "",
    f"""WITH w AS (SELECT doc_id, len({_WORDS}) AS length, unnest({_WORDS}) AS term FROM documents), t AS (SELECT doc_id, term, length, count(*) AS tf FROM w WHERE length(term) > 2 GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
    x AS (SELECT doc_id, term, tf * 1.0 / length * (ln((SELECT count(*) FROM documents) * 1.0 / df) + 1) AS weight FROM t JOIN df USING (term))
    SELECT doc_id, term, round(weight, 6) AS weight FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(x.weight, 9) DESC, term) <= 3""",
)
def tfidf_terms(spark, d):
    return M.tfidf_terms(table(spark, d, "documents"), "doc_id", "text", 3).select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(
    "",
    """WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS ch, length(url) AS n FROM pages), k AS (SELECT page_id, n, ch, count(*) AS k FROM c GROUP BY 1, 2, 3)
    SELECT page_id, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 6) AS bits FROM k GROUP BY 1""",
)
def shannon_entropy(spark, d):
    return table(spark, d, "pages").select("page_id", r6(S.shannon_entropy(F.col("url"))).alias("bits"))


def _sql_re(p: str) -> str:
    return p.replace("'", "''")


@query("", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_sql_re(p.regex)}'))::BIGINT AS {p.name}" for p in X.PATTERNS) + " FROM documents")
def pii_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *X.counts(F.col("text")))


def _redact_sql() -> str:
    out = "text"
    for p in X.PATTERNS:
        if p.confidence < 0.40:
            continue
        out = f"regexp_replace({out}, '{_sql_re(p.regex)}', '[{p.name.upper()}]', 'g')"
    return out


@query("", f"SELECT doc_id, md5({_redact_sql()}) AS digest FROM documents")
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("digest"))


@query()
def pii_findings(spark, d):
    """Matches with their confidence in context."""
    f = X.findings(table(spark, d, "documents"), "doc_id", "text")
    return f.groupBy("name").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("confidence"))


@query("", "SELECT source, sum(CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT))::BIGINT AS tokens FROM documents GROUP BY 1")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(S.token_estimate(F.col("text"))).alias("tokens"))


_SETS = "sets AS (SELECT DISTINCT conv_id AS a, w AS t FROM (SELECT conv_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM conversations)), n AS (SELECT a, count(*) AS n FROM sets GROUP BY 1)"


@query(
    "",
    f"""WITH {_SETS}, i AS (SELECT x.a AS a, y.a AS b, count(*) AS k FROM sets AS x JOIN sets AS y ON x.t = y.t AND x.a < y.a GROUP BY 1, 2) SELECT i.a, i.b, round(k * 1.0 / (p.n + q.n - k), 6) AS jaccard FROM i JOIN n AS p ON p.a = i.a JOIN n AS q ON q.a = i.b WHERE k > 0.9 * (p.n + q.n - k)""",
)
def word_overlap_dedup(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).alias("t"))
    return M.jaccard_pairs(c, "conv_id", "t", 0.9).where("jaccard > 0.9").select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


@query(
    "",
    """SELECT CASE WHEN regexp_full_match(x, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake_case' WHEN regexp_full_match(x, '[a-z][a-z0-9]*([A-Z][A-Za-z0-9]*)+') THEN 'camelCase' WHEN regexp_full_match(x, '[A-Z][a-z0-9]+([A-Z][A-Za-z0-9]*)*') THEN 'PascalCase'
    WHEN regexp_full_match(x, '[A-Z][A-Z0-9_]*') THEN 'SCREAMING' ELSE 'other' END AS style, count(*) AS n FROM (SELECT replace(p_name, ' ', '_') AS x FROM part UNION ALL SELECT replace(c_mktsegment, ' ', '') FROM customer) GROUP BY 1""",
)
def naming_style(spark, d):
    x = table(spark, d, "part").select(F.translate("p_name", " ", "_").alias("x")).union(table(spark, d, "customer").select(F.replace("c_mktsegment", F.lit(" "), F.lit(""))))
    return x.groupBy(S.naming_style(F.col("x")).alias("style")).agg(F.count("*").alias("n"))


_ROUTE = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/[0-9]+', '/:id', 'g')"


@query("", f"SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_ROUTE} AS route, count(*) AS n FROM pages GROUP BY 1, 2")
def endpoints(spark, d):
    return X.endpoints(table(spark, d, "pages")).groupBy("host", "route").agg(F.count("*").alias("n"))


@query(
    "",
    f"""WITH r AS (SELECT DISTINCT {_ROUTE} AS route FROM pages), s AS (SELECT route, list_filter(string_split(route, '/'), lambda x: x <> '') AS p FROM r)
    SELECT a.route AS b_route, b.route AS f_route, round(CASE WHEN greatest(len(a.p), len(b.p)) = 0 THEN 1.0 ELSE len(list_filter(list_zip(a.p, b.p), lambda x: x[1] = x[2] OR starts_with(x[1], ':') OR starts_with(x[2], ':'))) * 1.0 / greatest(len(a.p), len(b.p)) END, 6) AS similarity
    FROM s AS a JOIN s AS b ON len(a.p) = len(b.p) AND coalesce(a.p[1], '') = coalesce(b.p[1], '') WHERE similarity >= 0.5""",
)
def path_similarity(spark, d):
    r = X.endpoints(table(spark, d, "pages")).select("route").distinct().withColumn("method", F.lit("GET"))
    return X.match_contracts(r, r).select("b_route", "f_route", r6(F.col("similarity")).alias("similarity"))


@query()
def textrank(spark, d):
    """Power iteration per document."""
    return X.textrank(table(spark, d, "documents"), "doc_id", "text", 2).select("doc_id", "position", "sentence", r6(F.col("score")).alias("score"))


@query()
def budget_pack(spark, d):
    """Greedy with skips: each choice depends on those before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", S.token_estimate(F.col("text")).alias("tokens"), F.length("text").alias("priority"))
    return X.pack_budget(c, "conv_id", "turn", "priority", "tokens", 400)


@query("", "SELECT conv_id, min(turn) AS turn, md5(text) AS digest FROM conversations GROUP BY conv_id, md5(text)")
def session_dedup(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", F.md5("text").alias("digest")).agg(F.min("turn").alias("turn")).select("conv_id", "turn", "digest")


@query("", "SELECT CASE WHEN regexp_matches(lower(text), '\\b(bug|error|fix|crash)\\b') THEN 'fix_bug' WHEN regexp_matches(lower(text), '\\b(why|how|explain|what)\\b') THEN 'understand' WHEN regexp_matches(lower(text), '\\b(add|implement|create|build)\\b') THEN 'add_feature' WHEN regexp_matches(lower(text), '\\b(review|check|audit)\\b') THEN 'review' ELSE 'general' END AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def intent_classify(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy(X.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


@query("", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS sessions, round(avg(length(text)), 4) AS mean_chars, max(turn) AS longest FROM conversations GROUP BY 1")
def session_analytics(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("sessions"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max("turn").alias("longest"))
