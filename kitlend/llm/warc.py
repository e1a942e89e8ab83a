"""WARC archives with revisit records (operator 10).

Pages whose payloads are equal are stored once. The headers (page, URL, payload
digest, length) are shuffled by digest, without payloads, equal ones counted first;
of the records that share a digest, and whose payload has at least ``min_bytes``, the
one with the largest page_id (of these the largest URL, of equal rows the first)
keeps the payload as a ``response``, the others become ``revisit`` records that refer
to it, with headers of their own and no block. Smaller payloads are all responses.

Payloads travel apart from the headers: one a digest, chosen before their shuffle, so
a payload of a third of all pages is sent once a task that reads it. Headers and
responses are tables of their own before they meet, so that Spark's join can split a
digest with very many headers. Record ids name the page, a hash of URL and digest, and
the number among equal rows, so no two records share one.

Archives are written by Spark's text sink: one row a record, the record
separator (two CRLF) as line separator, gzip a file. The sink commits whole
files into the shared folder, so a lost executor's half file is never seen.
``read_archives`` streams each file once, record by record with the lengths
that the headers state, checks the digest of every response, and
``resolve_revisits`` joins the revisits to their responses by digest.

Null html is an empty payload. Null page_ids and URLs sort before all others. A row
that repeats its response is a revisit of it. Null URLs give records without
WARC-Target-URI. Line breaks in a URL are percent-encoded. An empty table
gives no archive records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend.llm.common import new_folder, own_columns, prepare, stored

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
MIN_BYTES = 0
#: Date of the crawl in the fresh headers; a parameter, so that reruns agree.
CRAWLED = "2020-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 40 digits are 8 groups of 20 bits,
    each four letters."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def payloads(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest (SHA-1 in hex), payload_bytes, and ``small``, the
    payload itself below ``min_bytes``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(payload).cast("long")
    return own_columns(pages, "page_id", "url", "html").select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), size.alias("payload_bytes"),
        F.when(size < min_bytes, payload).alias("small"))


HEADER = ["digest", "payload_bytes", "page_id", "url", "small"]


def typed_headers(rows: DataFrame) -> DataFrame:
    """A row a record: the header columns, copy (its number among equal rows, from 1),
    record_type, record_id, and refers_id of revisits."""
    counted = stored(rows.select(*HEADER).groupBy(*HEADER).agg(F.count(F.lit(1)).alias("n")), "warc-headers-counted")
    best = stored(counted.groupBy(F.col("digest").alias("of"))
                  .agg(F.max(F.struct("page_id", "url")).alias("best")), "warc-responses")
    own, chosen = F.struct("page_id", "url"), F.col("best")
    records = (counted.join(best, F.col("digest") == F.col("of"))
               .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    kept = F.col("small").isNotNull() | own.eqNullSafe(chosen) & (F.col("copy") == 1)
    return records.select(
        *HEADER, "copy", F.when(kept, "response").otherwise("revisit").alias("record_type"),
        record_id(F.col("page_id"), F.col("url"), F.col("copy")).alias("record_id"),
        F.when(~kept, record_id(F.col("best.page_id"), F.col("best.url"), F.lit(1))).alias("refers_id"))


def record_id(page_id: Column, url: Column, copy: Column) -> Column:
    """``<page>:<hash of URL and digest>.<copy>``."""
    tag = F.substring(F.sha1(F.concat(F.col("digest"), F.coalesce(F.concat(F.lit(" "), url), F.lit("")))), 1, 16)
    return F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), tag, F.lit("."), copy.cast("string"))


def record_text(row: dict[str, Column]) -> Column:
    """The record's header lines, the blank line and the block, without the
    closing separator."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = row["record_type"] == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(row["payload"])
    return F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", row["record_type"]),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), row["record_id"], F.lit(">"))),
        line("WARC-Date", F.lit(CRAWLED)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(row["url"], "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(row["digest"]))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), row["refers_id"], F.lit(">"))),
            line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write deduplicated ``.txt.gz`` WARC files under ``path``."""
    prepare(pages.sparkSession)
    rows = payloads(pages, min_bytes)
    records = stored(typed_headers(rows), "warc-typed")
    texts = (rows.where(F.col("small").isNull()).groupBy(F.col("digest").alias("of"))
             .agg(F.first("payload").alias("payload")))
    first = records.where((F.col("record_type") == "response") & F.col("small").isNull())
    others = records.where((F.col("record_type") == "revisit") | F.col("small").isNotNull())
    whole = (first.join(texts, F.col("digest") == F.col("of")).drop("of")
             .unionByName(others.withColumn("payload", F.col("small"))))
    cols = {c: F.col(c) for c in ("record_type", "url", "digest", "payload", "record_id", "refers_id")}
    (whole.select(record_text(cols).alias("value")).write.option("lineSep", SEPARATOR)
     .option("compression", "gzip").text(path))


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def _records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; ``lines`` are the pieces between
    separators, in file order. A block that ends in an odd number of CRLF is cut
    two bytes early, and the piece after it begins with the separator's rest: the
    block is then cut at its length and the remainder is the next record's head."""
    sep = SEPARATOR.encode()
    carry = b""
    while True:
        head, carry = carry or next(lines, None), b""
        if head is None:
            return
        if not head:
            continue
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(head)}
        want = int(fields["content-length"])
        parts, got = [], -len(sep)
        while got < want:  # a block that holds the separator comes in several pieces
            piece = next(lines, None)
            if piece is None:
                break
            parts.append(piece)
            got += len(sep) + len(piece)
        block = sep.join(parts)
        if got > want and block.startswith(sep, want):
            block, carry = block[:want], block[want + len(sep):]
            got = want
        if got != want:
            raise ValueError(f"record {fields.get('warc-record-id')} is not {want} bytes long")
        yield fields, block


READ_SCHEMA = ("record_id string, record_key string, url string, record_type string, digest string, refers_key string, "
               "payload binary, payload_bytes long")


def _parse(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def lines() -> Iterator[bytes]:
        for batch in batches:
            for v in batch.column(0):
                yield v.as_py()
    strip = lambda v: None if v is None else v.removeprefix("<urn:page:").removesuffix(">")
    page = lambda v: None if v is None else strip(v).rpartition(":")[0]
    rows: list[tuple] = []
    held = 0
    types = [pa.string()] * 6 + [pa.binary(), pa.int64()]
    names = ["record_id", "record_key", "url", "record_type", "digest", "refers_key", "payload", "payload_bytes"]

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for f, block in _records(lines()):
        digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
            raise ValueError(f"record {f['warc-record-id']} does not match its digest")
        rows.append((strip(f["warc-record-id"]), page(f["warc-record-id"]), f.get("warc-target-uri"), kind, digest,
                     page(f.get("warc-refers-to")), block if with_payload else None,
                     len(block) if kind == "response" else None))
        held += len(block) if with_payload else 0
        if len(rows) >= 5000 or held >= 8 << 20:
            yield out()
            rows, held = [], 0
    yield out()


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a WARC record. Every gzip file is read by one task, streaming;
    the digest of each response is checked."""
    lines = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(lambda batches: _parse(batches, with_payload), READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives each revisit the payload length of the response with its digest;
    only headers are shuffled."""
    headers = records.select("record_key", "url", "record_type", "digest", "refers_key", "payload_bytes")
    first = (headers.where(F.col("record_type") == "response")
             .groupBy(F.col("digest").alias("of")).agg(F.max("payload_bytes").alias("full_bytes")))
    return headers.join(first, F.col("digest") == F.col("of"), "left").select(
        "record_key", "url", "record_type", "digest", "refers_key",
        F.coalesce(F.col("payload_bytes"), F.col("full_bytes")).alias("payload_bytes"))


def archived_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to of every page."""
    spark = pages.sparkSession
    prepare(spark)
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, min_bytes)
    back = stored(read_archives(spark, path, with_payload=False), "warc-headers")
    number = lambda c: F.when(c != "null", c).cast("long")
    return resolve_revisits(back).select(
        number(F.col("record_key")).alias("page_id"), "url", "payload_bytes",
        F.col("digest").alias("payload_digest"), "record_type",
        number(F.col("refers_key")).alias("refers_to"))
