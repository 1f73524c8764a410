"""WARC archives and revisit resolution.

Archives are gzipped files of Spark's text writer, one record per line ended by
the two line breaks that close a WARC record, and committed like any table, so
a lost executor leaves no half-written archive.  A file is one gzip member; its
records' offsets count the bytes before compression.  Files have so many
records that their mean size stays below FILE_BYTES.  They are unzipped and
read back record by record, by their Content-Length, whatever a payload
contains, so a worker holds a zipped file and one record.

Every record has an id of its own, repeated rows included, and keeps it when
archives are written again; a revisit names its response's id and url.

Records with equal payloads (SHA-256) of at least SHORTEST bytes keep one
response, that of the smallest page id; ties between repeated rows fall to the
record that stands first in the archives.  A record without an id is a
response only if no record of its group has an id.  A null payload is empty; a
null url leaves out its header.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import deleted, fresh_path, table

#: Payloads of fewer bytes are never revisits.
SHORTEST = 100
#: Bounds of an archive file: records, and bytes before compression by the mean of all records.
RECORDS_PER_FILE = 2000
FILE_BYTES = 64 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id bigint, url string, record_id string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, file string, offset bigint"


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, date: str | None = None, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes rows of page_id, url, html, record_id, record_type, payload_digest, payload_bytes, refers_to, refers_id and refers_url.

    A revisit has no payload of its own, only headers that name its digest,
    its payload's length and the response it refers to.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    clean = lambda c: F.regexp_replace(F.col(c), r"[\x00-\x20\x7f]", "%20")
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", clean("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("X-Page-Id", F.col("page_id")), _header("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(_PROFILE)), _header("WARC-Refers-To", F.col("refers_id")), _header("WARC-Refers-To-Target-URI", clean("refers_url")), _header("X-Refers-To-Page", F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _header("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )
    records.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse_archive(archive: BinaryIO) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, offset, payload) of each record of an unzipped archive."""
    at = 0
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers, size = {}, len(line)
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
            size += len(line)
        block = archive.read(int(headers["Content-Length"]))
        end = archive.read(len(_END))
        if len(block) < int(headers["Content-Length"]) or end != _END.encode():
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield headers, at, block[block.index(b"\r\n\r\n") + 4 :]
        at += size + 2 + len(block) + len(end)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """HEADERS of each record, and its payload as html if asked for.

    The digest and length of a response are computed from its payload; those
    of a revisit are its headers'.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = HEADERS + (", html string" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64() if "bigint" in x else pa.string() for x in schema.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple] = []
                held = 0

                def flushed() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

                for h, at, body in parse_archive(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    whole = h["WARC-Type"] == "response"
                    number = lambda k: int(h[k]) if k in h else None
                    digest = hashlib.sha256(body).hexdigest() if whole else h["WARC-Payload-Digest"].removeprefix("sha256:")
                    row = (number("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Record-ID"], h["WARC-Type"], digest, len(body) if whole else number("X-Payload-Length"), number("X-Refers-To-Page"), name.as_py(), at)
                    rows.append((*row, body.decode() if whole else None) if payload else row)
                    held += len(body) if payload else 64
                    if held > 4 << 20:
                        yield flushed()
                        rows, held = [], 0
                if rows:
                    yield flushed()

    return files.mapInArrow(run, schema)


def resolved(headers: DataFrame) -> DataFrame:
    """(file, offset) of each record with its record_type, and refers_to, refers_id and refers_url: page, record and url of a revisit's response.

    Only headers are shuffled.  The first of each digest comes from a
    pre-aggregated minimum; joining it back is an equi-join whose large digests
    the adaptive planner splits.
    """
    place = F.struct(F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)).alias("id"), F.col("file"), F.col("offset"))
    long = headers.where(F.col("payload_bytes") >= SHORTEST).select("payload_digest", "page_id", "file", "offset", "record_id", "url", place.alias("place"))
    named = F.struct("place", F.struct("record_id", "url").alias("of"))
    first = long.groupBy("payload_digest").agg(F.min(named).alias("first"), F.min("page_id").alias("first_id"))
    again = (F.col("place") != F.col("first.place")) & F.col("first_id").isNotNull()
    refers = {"refers_to": "first_id", "refers_id": "first.of.record_id", "refers_url": "first.of.url"}
    long = long.select("payload_digest", "file", "offset", "place").join(first, "payload_digest").select("file", "offset", F.when(again, "revisit").otherwise("response").alias("record_type"), *[F.when(again, F.col(c)).alias(k) for k, c in refers.items()])
    none = [F.lit(None).cast(t).alias(k) for k, t in zip(refers, ("bigint", "string", "string"))]
    short = headers.where(F.col("payload_bytes") < SHORTEST).select("file", "offset", F.lit("response").alias("record_type"), *none)
    return long.unionByName(short)


def per_file(sizes: DataFrame) -> int:
    """Records of a file, from the mean of a column payload_bytes."""
    mean = sizes.agg(F.avg("payload_bytes")).first()[0] or 0
    return max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (mean + 1000))))


def archived(pages: DataFrame, path: str) -> int:
    """Writes a full response record per row of page_id, url and html; returns the records of a file."""
    html = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(html).cast("bigint").alias("payload_bytes")
    none = [F.lit(None).cast(t).alias(k) for k, t in (("refers_to", "bigint"), ("refers_id", "string"), ("refers_url", "string"))]
    record = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id")
    rows = pages.select("page_id", "url", "html", record, F.lit("response").alias("record_type"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), size, *none)
    n = per_file(pages.select(size))
    write_archives(rows, path, per_file=n)
    return n


def deduplicated(spark: SparkSession, source: str, target: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Reads the archives of source and writes them to target with revisit records for repeated payloads.

    Payloads move once, joined to the verdicts by the record's place, a key
    without skew.
    """
    headers = read_archives(spark, source)
    verdicts = resolved(headers).withColumnRenamed("record_type", "verdict").withColumnRenamed("refers_to", "original")
    records = read_archives(spark, source, payload=True).join(verdicts, ["file", "offset"])
    html = F.when(F.col("verdict") == "response", F.col("html"))
    rows = records.select("page_id", "url", html.alias("html"), "record_id", F.col("verdict").alias("record_type"), "payload_digest", "payload_bytes", F.col("original").alias("refers_to"), "refers_id", "refers_url")
    write_archives(rows, target, per_file=per_file)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, small = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    n = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"), raw)
    deduplicated(spark, raw, small, n)
    deleted(spark, raw)
    return read_archives(spark, small).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op5_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {SHORTEST} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {SHORTEST} AND page_id <> first_id THEN first_id END AS refers_to FROM f"""
}
QUERIES = {"op5_warc": op5_warc}
