"""Licence lookup by canonical digests.

A text is normalised (case, copyright lines, punctuation and white space, equivalent
spellings) and its SHA-256 is joined to the digests of known licence texts, which
are normalised by the same expression. Whole documents are looked up, and each of
their lines, so that a one-line notice inside a document is found too.

Known are the fixed texts below, the whole texts in the folder ``licenses`` and any
table that a caller gives. A file there holds titles, body and appendix, parted by
lines of ``%%`` (titles among themselves by ``%``); what follows ``~`` in its name
tells wordings of one licence apart.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence comparison treats as equal.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("analyse", "analyze"), ("copyright holder", "copyright owner"))

# Whole licence texts and one-line notices.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; letters and digits in single-spaced words; one spelling."""
    out = F.regexp_replace(F.lower(text), r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*", " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


# Words after which a line that starts with "copyright" goes on with a licence's own sentence.
_SENTENCE = "notices?|licenses?|licences?|laws?|holders?|owners?|statements?|permission|protection|interests?|on|in|and|or|to|is|of"


def unwrapped(text: Column) -> Column:
    """``canonical``, but only copyright statements go: a sentence that was wrapped before "copyright", or an item (c), stays."""
    body = rf"(?im)^([ \t]*)(?:copyright(?=(?:[ \t]+(?:{_SENTENCE})|ed|s)\b)|\(c\)(?![ \t]*(?:copyright|©|[0-9]{{4}})))"
    return canonical(F.regexp_replace(text, body, "$1. $0"))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the folder's texts: each without a title and with each, with and without its appendix."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        titles, body, *rest = path.read_text(encoding="utf-8").split("\n%%\n")
        heads = ["", *titles.split("\n%\n")]
        heads += [f"{head}\nAll rights reserved." for head in heads]
        out += [(path.stem.split("~")[0], f"{head}\n{body}\n{tail}") for head in heads for tail in {"", *rest}]
    return out


def text_digests(texts: DataFrame) -> DataFrame:
    """digest -> license of a table of texts (license, text), as ``license_scan`` takes it."""
    each = texts.select("license", F.explode(F.array_distinct(F.array(canonical(F.col("text")), unwrapped(F.col("text"))))).alias("t"))
    return each.where("t <> ''").select(F.sha2("t", 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession) -> DataFrame:
    """digest -> license, of the fixed texts above and the folder's (some hundred rows)."""
    return text_digests(spark.createDataFrame([*KNOWN, *whole_texts()], "license string, text string"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences of every row of ``docs`` (doc_id, text).

    known: further digests (digest, license), as of ``text_digests``; a digest that is
    known here already keeps its licence. They are held by the driver and broadcast.

    Returns doc_id, digest (of the canonical whole text), license (of the whole text,
    else null), n_notices (lines that are a known text) and notices (their licences,
    sorted, joined by commas; empty if none). A null text counts as empty, which no
    licence equals. One row per input row, null ids and repeated rows included; other
    columns are not read. Nothing is shuffled.
    """
    spark = docs.sparkSession
    names = {r.digest: r.license for r in [*(known.select("digest", "license").collect() if known is not None else []), *known_digests(spark).collect()]}
    by_digest = F.broadcast(spark.createDataFrame(sorted(names.items()), "digest string, license string"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A set of literals is looked up by hash, so the map is searched for hits only.
    found = F.filter(F.transform(F.split("text", "\n"), lambda line: F.sha2(canonical(line), 256)), lambda digest: digest.isin(*names))
    found = F.transform(found, lambda digest: F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), digest))
    other = F.when(F.col("text").rlike(r"(?im)^[ \t]*(copyright|\(c\))"), F.sha2(unwrapped(F.col("text")), 256))  # else equal to the digest
    scanned = base.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), other.alias("other"), found.alias("found"))
    scanned = scanned.select("doc_id", "digest", "other", F.size("found").cast("bigint").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
    scanned = scanned.join(by_digest, "digest", "left").join(by_digest.select(F.col("digest").alias("other"), F.col("license").alias("other_license")), "other", "left")
    return scanned.select("doc_id", "digest", F.coalesce("license", "other_license").alias("license"), "n_notices", "notices")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for other, usual in SPELLINGS:
        out = f"replace({out}, '{other}', '{usual}')"
    return out


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    values = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license
  FROM (VALUES {values}) AS k(license, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS (
  SELECT doc_id, k.license FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) AS l
  JOIN known AS k ON k.digest = sha256({_sql_canonical("l.line")})),
notices AS (
  SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM hits GROUP BY 1)
SELECT d.doc_id, sha256({_sql_canonical("d.text")}) AS digest, k.license, coalesce(n.n_notices, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known AS k ON k.digest = sha256({_sql_canonical("d.text")}) LEFT JOIN notices AS n ON n.doc_id = d.doc_id
"""
