"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from . import license_scan
from .url_filter import ALPHABET, RULES, UPPER


def warc() -> str:
    """Equal payloads by their text; base32 from the digest's hex digits, five bits at a time."""
    group = "CAST('0x' || substr(d.hex, CAST(floor(j / 4) AS INT) * 5 + 1, 5) AS BIGINT)"
    base32 = f"array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({group} >> CAST((3 - j % 4) * 5 AS INT)) & 31 AS INT) + 1, 1)), '')"
    return f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""


def url_filters(weight: float = 4.0, least: int = 8) -> str:
    ranked = sorted(RULES, key=lambda r: -len(r.pattern))

    def fits(r) -> str:
        host, _, path = r.pattern.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in ranked) + " END"
    low = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"

    def p(v: str) -> str:
        p1 = f"((c.{v} + 1.0) / ((SELECT sum({v}) FROM n3) + {len(ALPHABET)}))"
        p2 = f"(CASE WHEN b.{v} < {least} THEN {p1} ELSE (bc.{v} + {weight} * {p1}) / (b.{v} + {weight}) END)"
        return f"ln(CASE WHEN ab.{v} < {least} THEN {p2} ELSE (n3.{v} + {weight} * {p2}) / (ab.{v} + {weight}) END)"

    sums = lambda name, key: f"{name} AS (SELECT {key} AS k, sum(allow)::DOUBLE AS allow, sum(block)::DOUBLE AS block FROM n3 GROUP BY 1)"
    return f"""
WITH u AS (SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
base AS (SELECT page_id, url, {low("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {pick(lambda r: r.pattern)} AS rule, {pick(lambda r: r.verdict)} AS ruled FROM base),
s AS (SELECT DISTINCT url, ruled AS label, '~~' || regexp_replace(regexp_replace({low("url")}, '^[^:/]*://', ''), '[^a-z0-9./-]', '~', 'g') AS s FROM r WHERE url IS NOT NULL),
g AS (SELECT url, label, substr(s, unnest(range(1, length(s) - 1)), 3) AS gram FROM s WHERE length(s) > 2),
n3 AS (SELECT gram, (count(*) FILTER (WHERE label = 'allow' AND md5(url) >= '3'))::DOUBLE AS allow, (count(*) FILTER (WHERE label = 'block' AND md5(url) >= '3'))::DOUBLE AS block FROM g GROUP BY 1),
{sums("ab", "substr(gram, 1, 2)")}, {sums("bc", "substr(gram, 2, 2)")}, {sums("b", "substr(gram, 2, 1)")}, {sums("c", "substr(gram, 3, 1)")},
ratio AS (SELECT gram, {p("allow")} - {p("block")} AS ratio FROM n3 JOIN ab ON ab.k = substr(gram, 1, 2) JOIN bc ON bc.k = substr(gram, 2, 2) JOIN b ON b.k = substr(gram, 2, 1) JOIN c ON c.k = substr(gram, 3, 1)),
scored AS (SELECT url, label, avg(ratio) AS score FROM g JOIN ratio USING (gram) GROUP BY 1, 2),
bins AS (SELECT greatest(-800, least(800, floor(score * 100)))::INT AS bin, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS b FROM scored WHERE label IS NOT NULL AND md5(url) < '3' GROUP BY 1),
edges AS (SELECT bin AS edge, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(b) OVER w, 0) AS b FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) UNION ALL SELECT max(bin) + 1, sum(a), sum(b) FROM bins),
best AS (SELECT edge FROM edges, (SELECT sum(a) AS ga, sum(b) AS gb FROM bins) WHERE ga > 0 AND gb > 0 ORDER BY round((ga - a) / ga + b / gb, 11) DESC, abs(edge), edge LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < coalesce((SELECT edge FROM best), 0) / 100.0 THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score
FROM r LEFT JOIN (SELECT url AS s_url, score FROM scored WHERE label IS NULL) ON s_url = url
"""


ORACLES: dict[str, str] = {
    "op5_url_filters": url_filters(),
    "op7_warc": warc(),
    "op10_license_scans": license_scan.oracle(),
}
