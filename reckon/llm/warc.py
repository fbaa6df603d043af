"""WARC archives with revisit records.

Headers (page id, digest and size of the payload, no payload) are shuffled by payload digest and
reduced to the smallest page_id of each digest; a page whose payload of at least MIN_BYTES has a
smaller-numbered original is a revisit record that refers to it by record id, target and date,
without payload; all others are response records. Records are written with fresh headers, as plain text records whose separator is
the record end of the format (two CRLF), by Spark's own writer into the shared folder, gzip-compressed
by default; so any store that Spark writes will do, and failed tasks are written again. Reading back
parses every record by its Content-Length and checks the payload against its digest.

Defined cases: a null html is an empty payload; payloads below MIN_BYTES are always responses; rows
that repeat the smallest page_id of a digest are all responses; a null page_id comes after all
others (rows of a digest that has no other are all responses) and is read back as null; a null url
has no target header, and control characters or blanks in a url are percent-encoded; other columns
are not looked at; an empty table makes an empty archive.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.common import shared_dir
from reckon.ship import ship

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload aimed at for one archive file.
FILE_BYTES = 32 << 20
SALTS = 32
_END = b"\r\n\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes and payload_digest of each row of pages (page_id, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))


def _safe(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[\x00-\x1f\x7f]", "%0A"), " ", "%20")


def originals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """payload_digest, original (smallest page_id) and target (its url, of several the least) of each
    payload that comes more than once.

    Counts and minima are taken before the shuffle, so a payload that a third of the pages share
    is one row from each task."""
    html = F.coalesce(F.col("html"), F.lit(""))
    h = pages.where(F.octet_length(html) >= min_bytes).select(F.sha2(html, 256).alias("payload_digest"), F.col("page_id").cast("long").alias("page_id"), _safe(F.col("url")).alias("url"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    found = h.groupBy("payload_digest").agg(least.alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    return found.select("payload_digest", F.col("least.page_id").alias("original"), F.col("least.url").alias("target"))


def _record_id(digest: Column, page: Column) -> Column:
    x = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """record (the text of a WARC record less its final two CRLF) of each row of pages
    (page_id, url, html)."""
    row = pages.select(
        F.col("page_id").cast("long").alias("page_id"), _safe(F.col("url")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    row = row.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    # A payload shared by very many pages is met in SALTS parts.
    first = originals(pages, min_bytes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row = row.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    first = first.select(F.col("payload_digest").alias("digest"), "salt", "original", "target")
    row = row.join(first, ["digest", "salt"], "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(~revisit, _line("Content-Length", F.col("bytes"))).otherwise(""), F.lit("\r\n"))
    block = F.concat(http, F.when(~revisit, F.col("html")).otherwise(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", _record_id(F.col("digest"), F.col("page_id"))), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("digest"), F.col("original")))).otherwise(""),
        F.when(revisit, F.concat(_line("WARC-Refers-To-Target-URI", F.col("target")), _line("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(""),
        F.when(revisit, _line("X-Refers-To-Page", F.col("original"))).otherwise(""),
        _line("X-Page", F.col("page_id")), _line("X-Payload-Bytes", F.col("bytes")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length("block")), F.lit("\r\n"),
    )
    return row.withColumn("block", block).select(F.concat(head, F.col("block")).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> str:
    """Archives of pages (page_id, url, html) below path; returns path."""
    got = headers(pages).agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("bytes")).first()
    each = max(1, FILE_BYTES * got["n"] // max(1, got["bytes"] or 0))
    records(pages, min_bytes).write.option("maxRecordsPerFile", each).option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        out = io.BytesIO()
        while data:
            d = zlib.decompressobj(31)
            out.write(d.decompress(data))
            data = d.unused_data
        data = out.getvalue()
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start, n = end + 4, int(head["Content-Length"])
        if data[start + n : start + n + 4] != _END:
            raise ValueError(f"a record's end is missing at byte {start + n}")
        yield head, data[start : start + n]
        at = start + n + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for
    revisits) of each record below path. A payload that doesn't fit its digest is an error."""
    out = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for data in b.column("content"):
                rows, size = [], 0
                for head, block in parse(data.as_py()):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = None
                    if kind == "response":
                        payload = block[block.index(_END) + 4 :]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't fit its digest")
                    number = lambda k: int(head[k]) if k in head else None
                    rows.append((number("X-Page"), head.get("WARC-Target-URI"), number("X-Payload-Bytes"), digest, kind, number("X-Refers-To-Page"), payload))
                    size += len(block)
                    if size > 16 << 20:
                        yield _batch(rows, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, types)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, out)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(types.items())})


def resolve(archive: DataFrame) -> DataFrame:
    """archive (as read) with the payload of revisits taken from the responses they refer to."""
    first = archive.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload").alias("original")).dropDuplicates(["refers_to", "payload_digest"])
    return archive.join(first, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "original")).select(*archive.columns)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages into the shared folder, reads them back, and returns what the
    records say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = write(pages, shared_dir(spark, "warc"))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


