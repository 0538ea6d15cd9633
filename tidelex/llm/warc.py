"""Content-addressed web archive.

An archive is two tables in one folder. `payloads` holds each distinct payload once, under its
SHA-256, with its length and WARC digest; `headers` holds the exact header block of every record.
A record is rebuilt by joining the two on the SHA-256, and the rebuilt bytes are checked against
it. Copies of a payload are folded by a map-side aggregate, so a payload that a third of all pages
share is shuffled once per task; the joins are plain equi-joins, which Spark may split when hot.

Defined results: a null payload is empty; null ids and urls are allowed (an empty field); control
characters of a url are percent-encoded in the header only; repeated rows are archived once per
row. Of the records with one payload, all rows that carry the largest id are responses (one row,
unless rows repeat); where every id is null, all are. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 characters: each 5 bytes are 8 digits, re-spelled in RFC 4648 letters."""
    digest = F.sha1(payload)
    blocks = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*blocks), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: str, *fields: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(CRLF))
             for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), *lines, F.lit(CRLF))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write `payloads` and `headers` of `pages` under `folder`.

    Records whose payload has at least `min_revisit_bytes` bytes and occurs with a larger id are
    revisits of that record; all others are responses.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
        .alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    (rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("id").alias("response"))
     .select("sha256", F.octet_length("payload").cast("long").alias("n_bytes"),
             base32_sha1(F.col("payload")).alias("digest"), "response", "payload")
     .write.parquet(f"{folder}/payloads"))
    stored = pages.sparkSession.read.parquet(f"{folder}/payloads")
    known = stored.select("sha256", "n_bytes", "digest", "response")
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    record = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                      F.lit(">"))
    original = F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">"))
    revisit = ((F.col("n_bytes") >= min_revisit_bytes) & F.col("response").isNotNull()
               & ~F.col("id").eqNullSafe(F.col("response")))
    response_header = _header(
        "response", ("WARC-Record-ID", record), ("WARC-Target-URI", safe_url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n_bytes")))
    revisit_header = _header(
        "revisit", ("WARC-Record-ID", record), ("WARC-Target-URI", safe_url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", original),
        ("WARC-Profile",
         F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Length", F.lit(0)))
    (rows.drop("payload").join(known, "sha256")
     .select("sha256", F.when(revisit, revisit_header).otherwise(response_header).alias("header"))
     .write.parquet(f"{folder}/headers"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: header, payload (that of the response, for a revisit), the exact
    record bytes, and `verified`: the stored bytes still have the digests they are filed under."""
    stored = spark.read.parquet(f"{folder}/payloads").select("sha256", "digest", "payload")
    joined = spark.read.parquet(f"{folder}/headers").join(stored, "sha256")
    head = F.encode("header", "UTF-8")
    tail = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}"),
                  F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "header", "payload", F.concat(head, body, tail).alias("record"),
        ((F.unhex(F.sha2("payload", 256)) == F.col("sha256"))
         & (base32_sha1(F.col("payload")) == F.col("digest"))).alias("verified"))


def header_field(header: Column, name: str) -> Column:
    """A field of a header block; null where it is absent or empty."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\n){name}: ?([^\r\n]*)\r\n", 1), F.lit(""))


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archive, read it back, and describe each record from its own bytes."""
    write_archive(pages, folder)
    records = read_archive(pages.sparkSession, folder)
    id_of = lambda field: F.regexp_extract(
        F.coalesce(header_field(F.col("header"), field), F.lit("")), "^<urn:page:(-?[0-9]+)>$", 1)
    return records.select(
        F.nullif(id_of("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_extract(header_field(F.col("header"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
        .alias("payload_digest"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        F.nullif(id_of("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        header_field(F.col("header"), "WARC-Target-URI").alias("target_uri"), "verified")
