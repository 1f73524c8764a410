"""Tokens, dictionaries and indexes as DataFrames.

documents have doc_id and text; every index is a long table keyed by term.  A
document whose id is its own is indexed where it is read, without a shuffle;
rows of one id are put together by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrid.functions import text as T

#: So many ids of several documents are sent to every task; more are joined by a shuffle.
REPEATED = 1 << 17
#: Fixed value: bytes of one of Spark's bitmaps.
BITMAP_BYTES = 4096
#: Documents whose words are grouped at once.
TOGETHER = 256


def tokens(documents: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """key, pos (bigint, from 0) and term."""
    return documents.select(*key, F.posexplode(T.terms(text)).alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def lexer_stats(documents: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        *key, F.length(t).cast("bigint").alias("characters_read"), T.characters_ignored(t).cast("bigint").alias("characters_ignored"), T.line_count(t).cast("bigint").alias("lines")
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).alias(c) for c in ("characters_read", "characters_ignored", "lines")])


def dictionary(tokens: DataFrame, *key: str) -> DataFrame:
    return tokens.groupBy(*key, "term").agg(F.count("*").alias("cnt"))


def merged_dictionaries(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("term").agg(F.sum("cnt").alias("cnt"))


def dictionary_size(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count("*").alias("unique_words"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_words"))


def postings(tokens: DataFrame) -> DataFrame:
    return tokens.select("term", "doc_id").distinct()


def positional(tokens: DataFrame) -> DataFrame:
    """term, doc_id and pos: ascending distinct word ordinals."""
    return tokens.groupBy("term", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("pos"))


def by_document(documents: DataFrame, once: Callable[[DataFrame], DataFrame], several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """once() of the documents whose id is their own, and several() of those that share one; no id is an id here."""
    ids = documents.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated"))
    n = ids.limit(REPEATED + 1).count()
    if n == 0:
        return once(documents)
    ids = F.broadcast(ids) if n <= REPEATED else ids
    shared = F.col("doc_id").eqNullSafe(F.col("repeated"))
    return once(documents.join(ids, shared, "left_anti")).unionByName(several(documents.join(ids, shared, "left_semi")))


def grouped(places: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, doc_id, places) of each document's different terms, from (doc_id, t) with its terms: places are ordinals of words,
    or, for `offsets`, sums of the sizes in a list `n` before each; for `cnt` there are their number and that of all terms, len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.slice(at, TOGETHER)
                words = part.column("t")
                size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                coded = pc.dictionary_encode(words.flatten())
                key = row << 32 | np.asarray(coded.indices)
                order = np.argsort(key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
                ends = np.append(starts, len(key))
                of = row[order[starts]]
                columns = {"term": coded.dictionary.take(pa.array(key[starts] & 0xFFFFFFFF)), "doc_id": part.column("doc_id").take(pa.array(of))}
                if places == "cnt":
                    columns |= {"cnt": pa.array(np.diff(ends)), "len": pa.array(size[of])}
                else:
                    step = np.asarray(part.column("n").flatten()).astype(np.int64) if places == "offsets" else np.ones(len(row), dtype=np.int64)
                    before = np.cumsum(step) - step
                    first = np.cumsum(size) - size
                    values = before - before[first[row]] if len(row) else before
                    columns[places] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[order]))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def positional_of(documents: DataFrame) -> DataFrame:
    """term, doc_id and pos, as positional() gives them, of documents."""
    own = lambda d: _worded(d).mapInArrow(grouped("pos"), "term string, doc_id bigint, pos array<bigint>")
    return by_document(documents, own, lambda d: positional(tokens(d)))


def postings_of(documents: DataFrame) -> DataFrame:
    """term and doc_id, as postings() gives them, of documents."""
    return by_document(documents, lambda d: d.select(F.explode(F.array_distinct(T.terms("text"))).alias("term"), "doc_id"), lambda d: postings(tokens(d)))


def frequencies_of(documents: DataFrame) -> DataFrame:
    """term, doc_id and cnt, as term_frequencies() gives them, and len, the document's terms, of documents."""

    def several(d: DataFrame) -> DataFrame:
        tf = term_frequencies(tokens(d))
        lengths = document_lengths(tf).withColumnRenamed("doc_id", "of")
        return tf.join(lengths, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")

    return by_document(documents, lambda d: _worded(d).mapInArrow(grouped("cnt"), "term string, doc_id bigint, cnt bigint, len bigint"), several)


def _worded(documents: DataFrame) -> DataFrame:
    """doc_id and t, the terms, of documents with a text."""
    return documents.where("text is not null").select(F.col("doc_id").cast("bigint"), T.terms("text").alias("t"))


def offsets(documents: DataFrame) -> DataFrame:
    """term, doc_id and offsets, as the offset index stores them."""
    found = documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text", T.raw_terms("text").alias("found"))
    gaps = F.slice(F.split("text", T.TERM, -1), F.lit(1), F.size("found"))
    sizes = F.zip_with("found", gaps, lambda t, gap: F.octet_length(gap) + F.octet_length(t))
    sized = found.select("doc_id", F.transform("found", T.lowered).alias("t"), sizes.alias("n"))

    def several(rows: DataFrame) -> DataFrame:
        each = rows.select("doc_id", F.posexplode(F.arrays_zip("t", "n")).alias("pos", "r"))
        w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum("r.n").over(w), F.lit(0)).cast("bigint")
        return each.select("doc_id", F.col("r.t").alias("term"), at.alias("at")).groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("at")).alias("offsets"))

    return by_document(sized, lambda d: d.mapInArrow(grouped("offsets"), "term string, doc_id bigint, offsets array<bigint>"), several)


def universe(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id").distinct()


def bigrams(documents: DataFrame) -> DataFrame:
    """w1, w2 and doc_id of adjacent words, made inside each row: no window.  A term has no underscore, so a pair is one word for the time."""
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("t", F.lit(1), n), F.slice("t", F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))
    found = lambda d: _worded(d).select("doc_id", F.explode(F.array_distinct(pairs)).alias("p"))
    rows = by_document(documents, found, lambda d: found(d).distinct())
    return rows.select(F.substring_index("p", "_", 1).alias("w1"), F.substring_index("p", "_", -1).alias("w2"), "doc_id")


def bitmaps(postings: DataFrame) -> DataFrame:
    """term, bucket and bits: the incidence matrix in pieces of fixed size; ids count from 0, bits from 1."""
    return bucketed(postings, "term")


def bucketed(rows: DataFrame, *key: str) -> DataFrame:
    """key, bucket and bits of the doc_ids."""
    place = F.col("doc_id") + 1
    # dealt before they are put together, as each partial bitmap would be a whole one: 4 KB for a single document
    dealt = rows.select(*key, F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).repartition(*key, "bucket")
    return dealt.groupBy(*key, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_bitmaps(*parts: DataFrame) -> DataFrame:
    """The bit matrix of all parts.

    Pieces of one term and bucket are met by a merge join: parts made here come
    dealt and in order, so no piece, of 4 KB each, is shuffled or sorted.
    """
    whole = parts[0]
    for p in parts[1:]:
        other = p.select(F.col("term").alias("_term"), F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        met = whole.join(other.hint("merge"), (F.col("term") == F.col("_term")) & (F.col("bucket") == F.col("_bucket")), "full")
        whole = met.select(F.coalesce("term", "_term").alias("term"), F.coalesce("bucket", "_bucket").alias("bucket"), "bits", F.col("_bits").alias("other")).mapInArrow(_united, "term string, bucket bigint, bits binary")
    return whole


def matrix(bits: pa.Array) -> np.ndarray:
    """Bitmaps as rows of bytes; none is all zeros."""
    bits = bits.fill_null(bytes(BITMAP_BYTES))
    first, last = np.frombuffer(bits.buffers()[1], dtype=np.int32)[[bits.offset, bits.offset + len(bits)]]
    return np.frombuffer(bits.buffers()[2], dtype=np.uint8)[first:last].reshape(-1, BITMAP_BYTES)


def bitmap_array(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * BITMAP_BYTES), pa.py_buffer(np.ascontiguousarray(rows))])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            bits = matrix(part.column("bits")) | matrix(part.column("other"))
            yield pa.RecordBatch.from_arrays([part.column("term"), part.column("bucket"), bitmap_array(bits)], names=["term", "bucket", "bits"])


def pivoted(postings: DataFrame, doc_ids: list[int]) -> DataFrame:
    """A display matrix for a given list of documents."""
    return postings.where(F.col("doc_id").isin(doc_ids)).groupBy("term").pivot("doc_id", doc_ids).agg(F.lit(True))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("cnt"))


def document_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("doc_id").agg(F.sum("cnt").alias("len"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two indexes hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
