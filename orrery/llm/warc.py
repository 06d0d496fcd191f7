"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each payload's bytes once, under its
SHA-256; ``records`` holds every record's exact header block and that digest. A
record is its header, its payload where the header promises one, and two line ends;
joining the two tables rebuilds it byte for byte. Equal digests are verified on
writing (a second digest and the length have to agree) and on reading (the stored
bytes are digested again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _one_line(value: Column) -> Column:
    """A header value can't hold line ends: they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``.

    The payload is the html in UTF-8; a null one is empty. Of records with equal
    payloads of at least ``least_bytes`` the one with the largest page_id is the
    response and the others revisit it; a repeated row of that id is a response that
    shares its bytes. A null page_id ranks below all others. Other columns are not
    read.
    """
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    light = base.select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))
    index = f"{path}/index"
    light.write.parquet(index)
    light = spark.read.schema(light.schema).parquet(index)
    same = light.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.min("sha1").alias("s1"), F.max("sha1").alias("s2"), F.min("bytes").alias("b1"), F.max("bytes").alias("b2"))
    wrong = F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest")))
    same = same.select("digest", F.when((F.col("s1") == F.col("s2")) & (F.col("b1") == F.col("b2")), F.col("first_id")).otherwise(wrong).alias("first_id"))
    named = light.join(same, "digest")
    response = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("bytes") < least_bytes)
    kind = F.when(response, "response").otherwise("revisit")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(F.concat(_field("WARC-Refers-To", _record_id(F.col("first_id"))), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )
    records = named.select("page_id", F.encode(header, "UTF-8").alias("header"), "digest")
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    # Bytes of the first record of each payload only; its id, not its digest, is the key, so no key is hot.
    stored = base.select("page_id", "payload").join(same.select("first_id", "digest"), F.col("page_id").eqNullSafe(F.col("first_id"))).where(F.sha2("payload", 256) == F.col("digest"))
    stored = stored.select("digest", F.encode("payload", "UTF-8").alias("payload"))
    if light.groupBy("page_id").count().where("count > 1").limit(1).count():  # repeated ids: bytes still go in once
        stored = stored.dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    records = spark.read.schema("page_id bigint, header binary, digest string").parquet(f"{path}/records")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return records, payloads


def _value(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1)


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record's bytes: page_id, digest, record. Only a response holds its payload, so no digest is a hot key of this join."""
    records, payloads = _archive(spark, path)
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    own = _value(F.decode("header", "UTF-8"), "WARC-Type") == "response"
    whole = records.where(own).join(payloads, "digest", "left").select("page_id", "digest", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(records.where(~own).select("page_id", "digest", F.concat("header", end).alias("record")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records say, with size and digest of each payload taken from the record that holds it.

    A record without its payload, or whose payload doesn't have the digests and the length
    that the archive and the header name, is an error.
    """
    text = F.decode("record", "UTF-8")
    split = F.instr(text, CRLF + CRLF)
    parsed = rebuild_records(spark, path).select("digest", F.substring(text, F.lit(1), split + 3).alias("head"), F.substring(text, split + 4, F.length(text) - split - 7).alias("body"))
    page = lambda name: F.regexp_extract(_value(F.col("head"), name), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(c != "", c.cast("bigint"))
    told = parsed.select(
        "digest",
        number(page("WARC-Record-ID")).alias("page_id"),
        _value(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _value(F.col("head"), "WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        _value(F.col("head"), "WARC-Payload-Digest").alias("named"),
        _value(F.col("head"), "Content-Length").cast("bigint").alias("promised"),
        "body",
    )
    held = told.where("record_type = 'response'").select("digest", "page_id", "record_id", "record_type", "refers_to", "named", "promised", F.octet_length("body").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"), F.sha2("body", 256).alias("again"))
    sound = (F.col("digest") == F.col("again")) & (F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("promised") == F.col("payload_bytes"))
    bad = F.raise_error(F.concat(F.lit("no sound payload for the record "), F.col("record_id")))
    size = F.when(F.coalesce(sound, F.lit(False)), F.col("payload_bytes")).otherwise(bad.cast("bigint")).alias("payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = held.select("digest", "page_id", size, "payload_digest", "record_type", "refers_to")
    facts = whole.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = told.where("record_type <> 'response'").select("digest", "page_id", "record_id", "record_type", "refers_to", "named").join(facts, "digest", "left")
    known = F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    again = again.withColumn("payload_bytes", F.when(F.coalesce(known, F.lit(False)), F.col("payload_bytes")).otherwise(bad.cast("bigint")))
    return whole.select(columns).unionByName(again.select(columns))
