"""The compressed index: front-coded dictionary, then counts and gaps in variable-byte code.

An index is cut into blocks of terms and, as a frequent term's postings have no
bound, into segments of documents; each block of a segment is one blob.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrid.functions import text as T

SEGMENT_DOCUMENTS = 1 << 20
BLOCK_TERMS = 4096


def gaps(postings: DataFrame) -> DataFrame:
    """term, doc_id and gap to the document before (to 0 for the first).

    A term's documents are sorted segment by segment; only the last document of
    each segment goes on to the next, so no task holds a whole frequent term.
    """
    rows = postings.groupBy("term", _segment("doc_id").alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    before = F.coalesce(F.lag(F.element_at("ids", -1)).over(Window.partitionBy("term").orderBy("segment")), F.lit(0).cast("bigint"))
    rows = rows.select("term", "ids", F.concat(F.array(before), F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("prior"))
    return rows.select("term", F.inline(F.zip_with("ids", "prior", lambda a, b: F.struct(a.alias("doc_id"), (a - b).alias("gap")))))


def from_gaps(gaps: DataFrame, order: str = "i") -> DataFrame:
    """term and doc_id: sums of the gaps in an order.

    Rows stay where gaps() left them, dealt by term, and are read once; a term
    stands once in a document, so it has a small share of all rows.
    """
    before = Window.partitionBy("term").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gaps.select("term", F.sum("gap").over(before).alias("doc_id"))


def _segment(column: str) -> Column:
    return F.floor(F.col(column) / SEGMENT_DOCUMENTS)


def front_coded(terms: DataFrame, block: int = 0) -> DataFrame:
    """term, prefix (characters shared with the term before) and suffix.

    block: first characters that share a block, so that blocks are coded in
    parallel; 0 codes all terms as one sequence.
    """
    w = Window.partitionBy(F.substring("term", 1, block)).orderBy("term") if block else Window.orderBy("term")
    before = F.coalesce(F.col("before"), F.lit(""))
    shared = F.aggregate(
        F.when(F.length(before) * F.length("term") > 0, F.sequence(F.lit(1), F.least(F.length(before), F.length("term")))).otherwise(F.array().cast("array<int>")),
        F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(before, i, F.lit(1)) == F.substring("term", i, F.lit(1))), i).otherwise(n),
    )
    coded = terms.select("term").distinct().withColumn("before", F.lag("term").over(w)).withColumn("prefix", shared)
    return coded.select("term", F.col("prefix").cast("bigint").alias("prefix"), F.substring("term", F.col("prefix") + 1, F.length("term")).alias("suffix"))


def vb(n: int) -> bytes:
    out = [n & 127 | 128]
    while n := n >> 7:
        out.append(n & 127)
    return bytes(out[::-1])


def vb_numbers(data: bytes) -> Iterator[int]:
    n = 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            yield n
            n = 0


def encode(index: list[tuple[str, list[int]]]) -> bytes:
    """One blob of terms in byte order with ascending ids.  Prefix lengths are in bytes, at a character's edge."""
    head, before, body = [], "", []
    for term, ids in index:
        n = len(os.path.commonprefix([before, term]))
        head.append(f"{len(term[:n].encode())}{term[n:]}")
        before = term
        body.append(vb(len(ids)) + b"".join(vb(b - a) for a, b in zip([0, *ids], ids)))
    return "".join(head).encode() + b"\0" + b"".join(body)


def decode(blob: bytes) -> list[tuple[str, list[int]]]:
    head, _, body = blob.partition(b"\0")
    terms, before = [], b""
    for m in regex.finditer(rb"([0-9]+)([^0-9]*)", head):
        before = before[: int(m[1])] + m[2]
        terms.append(before.decode())
    numbers, out = vb_numbers(body), []
    for t in terms:
        at, ids = 0, []
        for _ in range(next(numbers)):
            at += next(numbers)
            ids.append(at)
        out.append((t, ids))
    return out


def compressed(postings: DataFrame) -> DataFrame:
    """segment, first_term, n_terms and blob."""
    rows = postings.groupBy(_segment("doc_id").alias("segment"), "term").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    rows = rows.repartitionByRange("segment", "term").sortWithinPartitions("segment", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column("segment").to_pylist(), batch.column("term").to_pylist(), batch.column("ids").to_pylist())
            for segment, group in groupby(each, key=lambda r: r[0]):
                index = [(t, ids) for _, t, ids in group]
                for at in range(0, len(index), BLOCK_TERMS):
                    part = index[at : at + BLOCK_TERMS]
                    yield pa.RecordBatch.from_pylist([{"segment": segment, "first_term": part[0][0], "n_terms": len(part), "blob": encode(part)}], schema=kinds)

    kinds = pa.schema([("segment", pa.int64()), ("first_term", pa.string()), ("n_terms", pa.int64()), ("blob", pa.binary())])
    return rows.mapInArrow(run, "segment bigint, first_term string, n_terms bigint, blob binary")


def decompressed(blobs: DataFrame) -> DataFrame:
    """term and doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                got = decode(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([i for _, i in got], pa.list_(pa.int64()))], names=["term", "ids"])

    return blobs.select("blob").mapInArrow(run, "term string, ids array<bigint>").select("term", F.explode("ids").alias("doc_id"))


def sizes(postings: DataFrame) -> DataFrame:
    """Bytes of the plain text index, and of counts and gaps in variable-byte code."""
    text = postings.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.length(F.col("doc_id").cast("string"))).alias("digits"))
    plain = text.agg(F.sum(F.octet_length("term") + 1 + F.col("digits") + F.col("n")).cast("bigint").alias("text_bytes"), F.sum(T.vb_size(F.col("n"))).cast("bigint").alias("count_bytes"))
    coded = gaps(postings).agg(F.sum(T.vb_size(F.col("gap"))).cast("bigint").alias("gap_bytes"))
    one = F.lit(1).alias("one")
    return plain.select("*", one).join(coded.select("*", one), "one").drop("one")
