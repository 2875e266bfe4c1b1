"""Content-addressed web archive.

Payload bytes lie once in a store keyed by SHA-256; the exact header bytes of every record lie in a second
table with the key of their payload; the original records come back by joining the two.  Equal digests are
verified: a key whose payloads differ in length or SHA-1 stops the write, and every payload is hashed again
when read.  All work is joins and aggregates; a payload that very many records share is stored by map-side
reduction and fans out again only in the reading join, whose large side Spark can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.llm.scratch import Scratch

LEAST_REVISIT = 1000  # payload bytes from which equal payloads become revisits
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """``headers``: one row per record, with its header block; ``payloads``: one row per distinct payload."""

    headers: DataFrame
    payloads: DataFrame


def _uri(url: Column, page_id: Column) -> Column:
    """The url without white space and control characters; a URN of the id where it is missing."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "")
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def _urn(uid: Column) -> Column:
    h = F.md5(uid.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def header_block(date: str = DATE) -> Column:
    """WARC header lines of a record from uid, page_id, url, kind, sha1, bytes and response_uid."""
    revisit = F.col("kind") == "revisit"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("uid"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"), F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("response_uid")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END)).cast("binary")


def write(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT, date: str = DATE) -> Archive:
    """Archive of one record per row of (page_id, url, html); other columns are ignored.

    A null html is an empty payload.  Of records with equal payloads of ``least`` bytes or more the one with
    the largest page_id is the response and the others revisit it; rows without an id come last, and of
    repeated rows of that id exactly one is the response.  Smaller payloads are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = scratch.keep(source.select(
        F.monotonically_increasing_id().alias("uid"), "page_id", "url", "digest", F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes")), "rows")
    payloads = scratch.keep(source.groupBy("digest").agg(F.first("payload").alias("payload")), "payloads")

    groups = rows.groupBy("digest").agg(
        F.max(F.struct("page_id", "uid")).alias("last"),
        F.min("sha1").alias("sha1_low"), F.max("sha1").alias("sha1_high"),
        F.min("bytes").alias("bytes_low"), F.max("bytes").alias("bytes_high"))
    differ = (F.col("sha1_low") != F.col("sha1_high")) | (F.col("bytes_low") != F.col("bytes_high"))
    groups = groups.select("digest", F.when(differ, F.raise_error(F.concat(F.lit("unequal payloads of digest "), F.col("digest"))))
                           .otherwise(F.col("last.uid")).alias("response_uid"),
                           F.col("last.page_id").alias("response_id"))
    again = (F.col("bytes") >= least) & (F.col("uid") != F.col("response_uid"))
    records = rows.join(groups, "digest").withColumn("kind", F.when(again, "revisit").otherwise("response"))
    headers = records.select(
        "uid", "page_id", "digest", "kind", F.when(again, F.col("response_id")).alias("refers_to"),
        header_block(date).alias("header"))
    return Archive(scratch.keep(headers, "headers"), payloads)


def read(archive: Archive) -> DataFrame:
    """Records as written: uid, page_id, header (bytes), payload (bytes), and fields parsed from the header.

    Revisits come with the payload they refer to.  A stored payload that no longer has its digest, or whose
    header names another one, stops the read.
    """
    stored = archive.payloads.select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"),
        "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    out = archive.headers.join(stored, "digest")
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1)

    named = field("WARC-Payload-Digest")
    return out.select(
        "uid", "page_id", "header", "payload", "payload_bytes", "refers_to",
        F.when(named == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest"))
        .otherwise(F.raise_error(F.concat(F.lit("record of another payload: "), named))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"),
        field("Content-Length").cast("long").alias("content_length"))


def record_bytes() -> Column:
    """Bytes of a record of ``read`` without the blank lines after it: a revisit has its header only."""
    return F.when(F.col("record_type") == "revisit", F.col("header")).otherwise(F.concat("header", "payload"))


def export(records: DataFrame, path: str, **options: str) -> None:
    """Writes records of ``read`` as WARC files, each ended by two line ends as the format asks."""
    (records.select(record_bytes().cast("string").alias("value")).write
     .options(**options).option("lineSep", _END + _END).text(path))
