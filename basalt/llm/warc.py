"""WARC archives with revisit records.

Pages become WARC/1.1 records. Their headers alone (page_id, address, payload
digest and length) are written once and shuffled by payload digest to find,
among equal payloads, the record with the largest page_id; the others become
revisits of it. The archives are then written with fresh headers: a response carries the
HTTP header and the payload, a revisit only the HTTP header and a reference.
Payloads are moved at most once, by page_id, so a payload that a third of all
pages share is never gathered anywhere.

Files are written by Spark's own text sink (a record's end, two line breaks,
is the separator between rows), so they go through its commit protocol to any
file system, and are read record by record from a stream. A file holds about
:data:`FILE_BYTES` of payload, and never more than a gigabyte: payloads of over
:data:`LARGE` bytes have a file each, others at most 1000 in one.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; control characters and spaces in an address are percent-encoded;
a null page_id is written without one and counts as smaller than any other;
rows that repeat page_id and payload are all of the same type; payloads
shorter than ``min_bytes`` are always responses; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import materialise, new_path, small_batches

END = "\r\n\r\n"
#: Payload bytes of one file, about; payloads that have a file of their own.
FILE_BYTES, LARGE = 16 << 20, 1 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload):
    """Upper-case base32 of SHA-1, 40 bits at a time."""
    sha, out = F.sha1(payload), []
    for i in range(4):
        part = F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0")
        out.append(F.translate(part, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    return F.concat(*out)


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, key (64 bits of the payload)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.xxhash64("html").alias("key"))


def resolve(recs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``recs`` with payload_digest, refers_to and refers_url, the latter null for responses. A payload is hashed once."""
    heads = materialise(recs.select("page_id", "url", "payload_bytes", "key", payload_digest(F.col("html")).alias("payload_digest")), "heads", fewer_files=True)
    equal = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    best = equal.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"))
    best = materialise(best.filter("n > 1 and refers_to is not null").drop("n"), "originals", fewer_files=True)
    again = ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("payload_bytes") >= min_bytes)
    to = lambda c: F.when(again, F.col(c)).alias(c)
    mine = heads.select("page_id", "payload_bytes", "key", "payload_digest").distinct().join(best, "payload_digest", "left")
    mine = mine.select(F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("key").alias("_key"), "payload_digest", to("refers_to"), to("refers_url"))
    mine = materialise(mine, "resolved", fewer_files=True)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("key") == F.col("_key")) & (F.col("payload_bytes") == F.col("_bytes"))
    return recs.join(mine, same).drop("_page", "_key", "_bytes", "key")


def sizes(pages: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes of payload, and rows of over :data:`LARGE` bytes, for :func:`write`."""
    n = F.coalesce(F.octet_length("html"), F.lit(0))
    return tuple(x or 0 for x in pages.agg(F.count(F.lit(1)), F.sum(n), F.count(F.when(n > LARGE, 1))).first())


def _address(url):
    """Without what would break a header line."""
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")


def _uuid(*cols):
    m = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write(resolved: DataFrame, path: str, size: tuple[int, int, int] | None = None) -> None:
    """Write the archives: one record for each row. ``size``: the :func:`sizes` of the pages, else those of the rows are taken."""
    rows, held, large = size or sizes(resolved)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"), F.col("url"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _address(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"), F.col("refers_url"))), line("WARC-Refers-To-Target-URI", _address(F.col("refers_url"))), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit(END), F.col("body"),
    )
    def save(part: DataFrame, files: int, most: int) -> None:
        lines = part.withColumn("body", body).select(head.alias("value")).coalesce(max(1, files))  # files of even size, however many partitions the rows come in
        lines.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)

    small = resolved.filter(F.col("payload_bytes") <= LARGE) if large else resolved
    save(small, -(-held // FILE_BYTES), min(1000, max(1, FILE_BYTES * rows // max(1, held))))
    if large:
        save(resolved.filter(F.col("payload_bytes") > LARGE), large, 1)


def parse(stream):
    """(headers, block) of each record of an open archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends within a record")
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives. A response's digest and length are those of its payload as read."""
    small_batches(spark)

    def records_of(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
                            raise ValueError(f"record {h['warc-record-id']} is damaged")
                    page, to = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    keep = payload if payloads and h["warc-type"] == "response" else None
                    rows.append((page and int(page), h["warc-target-uri"], h["warc-type"], length, digest, to and int(to), keep))
                    size += len(keep or b"")
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(records_of, ROW)


def restore(archive: DataFrame) -> DataFrame:
    """Revisits joined to their responses: every record with its payload."""
    a = archive.filter("record_type = 'response'").select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload")).dropDuplicates(["_to", "_digest"])
    joined = archive.join(a, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", F.coalesce("payload", "_payload").alias("payload"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all pages are archived in the shared folder, then the archives are read."""
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write(resolve(records(pages)), path, sizes(pages))
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), q AS (
  SELECT page_id, h, x, max(page_id) OVER (PARTITION BY x) AS best FROM p
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INT), 5)) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best = page_id THEN NULL ELSE best END AS refers_to
FROM q
"""
