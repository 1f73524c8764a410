"""Substring dedup with difference-cover anchors.

A window is WINDOW consecutive words of one document; it is removed if its
word sequence also starts earlier (smaller doc_id, or earlier in the same
document), judged on the input.

Anchors are ANCHOR-word windows at positions that are in COVER modulo PERIOD.
COVER is a difference cover: for any two starts there is a shift below PERIOD
that takes both to cover positions, so two equal windows share an anchor as
PERIOD - 1 + ANCHOR <= WINDOW.  Anchors found in two texts, or twice in one,
are extended to the windows that hold them, and these are compared by a
128-bit hash of all their words.

Only hashes are grouped: rows are sorted by hash and streamed, so a frequent
passage is never held in memory, and repeats inside one piece of input are
folded into one row before the shuffle.  Equal texts are compared once: a later
copy loses all its windows.

A text is known by the id of its first document while it is the only text with
that id, and by its tag, a hash, beside the id otherwise.

Nulls: a null text has no words; rows without an id come after all others.
Rows with the same id are one document: the same position in two of them is
not earlier in either.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import staged, table
from lexgrid.llm.textscan import Words, scan_words

WINDOW = 20
ANCHOR = 8
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bits of an anchor's hash that are shuffled; windows are compared by all their words, so a chance match costs time only.
ANCHOR_BITS = np.uint64((1 << 64) - (1 << 16))
LAST_ID = (1 << 63) - 1
_COVERED = np.isin(np.arange(PERIOD), COVER)


def anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of the anchors of rows long enough to hold a window."""
    at, found = words.windows(ANCHOR, hashes)
    rows = words.rows()[at]
    place = at - words.bounds[rows]
    keep = _COVERED[place % PERIOD] & (words.counts()[rows] >= WINDOW)
    return rows[keep], place[keep], (found[keep] & ANCHOR_BITS).view(np.int64)


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted parallel keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _folded(order_keys: tuple[np.ndarray, ...], extra: list[np.ndarray]) -> tuple[np.ndarray, list[bytes | None]]:
    """First index of each group of equal order_keys (already sorted), and the packed extras of the others of the group."""
    starts = _group_starts(*order_keys)
    stops = np.append(starts[1:], len(order_keys[0]))
    packed = np.stack(extra, axis=1) if len(order_keys[0]) else np.zeros((0, len(extra)), dtype=np.int64)
    return starts, [packed[a + 1 : b].tobytes() if b - a > 1 else None for a, b in zip(starts, stops)]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, rid, twice, more): one row per anchor hash of a piece; more holds the other texts' rids."""
    for batch in batches:
        rids = np.asarray(batch.column("rid"))
        for words in scan_words(batch.column("text"), 4 << 20):
            rows, _, a = anchors(words, words.hashes())
            rid = rids[words.first_row + rows]
            order = np.lexsort((rid, a))
            a, rid = a[order], rid[order]
            starts = _group_starts(a, rid)
            twice = np.diff(np.append(starts, len(a))) > 1
            a, rid = a[starts], rid[starts]
            first, more = _folded((a,), [rid])
            twice = np.logical_or.reduceat(twice, first) if len(first) else twice
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(rid[first]), pa.array(twice), pa.array(more, pa.binary())], names=["a", "rid", "twice", "more"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, a) of the anchors that two texts hold, or one text twice, from rows sorted by a, rid."""
    held: tuple[int, int, bool, bool] | None = None  # the last row: a, rid, twice or shared, emitted

    def out(rid: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(a, pa.int64())], names=["rid", "a"])

    for batch in batches:
        if not len(batch):
            continue
        a, rid = np.asarray(batch.column("a")), np.asarray(batch.column("rid"))
        more = batch.column("more")
        shared = np.asarray(batch.column("twice").cast(pa.int8())).astype(bool) | np.asarray(more.is_valid().cast(pa.int8())).astype(bool)
        with_next = np.zeros(len(a), dtype=bool)
        with_next[:-1] = (a[1:] == a[:-1]) & (rid[1:] != rid[:-1])
        with_last = np.zeros(len(a), dtype=bool)
        with_last[1:] = with_next[:-1]
        if held is not None and held[0] == a[0] and held[1] != rid[0]:
            with_last[0] = True
            if not held[3]:
                yield out([held[1]], [held[0]])
        take = shared | with_next | with_last
        yield out(rid[take], a[take])
        packed = [(x, np.frombuffer(m, dtype=np.int64)) for x, m in zip(a[np.asarray(more.is_valid())].tolist(), more.drop_null().to_pylist())]
        if packed:
            yield out(np.concatenate([m for _, m in packed]), np.repeat([x for x, _ in packed], [len(m) for _, m in packed]))
        held = (int(a[-1]), int(rid[-1]), False, bool(take[-1]))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, start, tag, more): the windows around shared anchors, one row per word sequence of a piece."""
    for batch in batches:
        batch = batch.filter(batch.column("mine"))
        ids, tags = np.asarray(batch.column("doc")), np.asarray(batch.column("tag"))
        lists = batch.column("anchors")
        for words in scan_words(batch.column("text"), 4 << 20):
            one = words.hashes()
            rows, place, a = anchors(words, one)
            if not len(a):
                continue
            part = lists.slice(words.first_row, words.n_rows)
            listed = np.asarray(part.flatten())
            owner = np.repeat(np.arange(words.n_rows), np.asarray(part.value_lengths().fill_null(0)))
            # an anchor counts where its own row lists it
            known = np.unique(np.stack([owner, listed], axis=1), axis=0) if len(listed) else np.zeros((0, 2), dtype=np.int64)
            table_, values = np.concatenate([known, np.stack([rows, a], axis=1)]), len(known)
            _, inverse, count = np.unique(table_, axis=0, return_inverse=True, return_counts=True)
            inverse = inverse.reshape(-1)
            present = np.zeros(len(count), dtype=bool)
            present[inverse[:values]] = True
            hit = present[inverse[values:]]
            rows, place = rows[hit], place[hit]
            start = words.bounds[rows] + place
            reach = np.zeros(len(words.starts) + 1, dtype=np.int64)
            low = np.maximum(start - (PERIOD - 1), words.bounds[rows])
            np.add.at(reach, low, 1)
            np.add.at(reach, start + 1, -1)
            wanted = np.cumsum(reach)[:-1] > 0
            at, h1 = words.windows(WINDOW, one)
            _, h2 = words.windows(WINDOW, words.hashes(1), 1)
            keep = wanted[at]
            at, h1, h2 = at[keep], h1[keep].view(np.int64), h2[keep].view(np.int64)
            rows = words.rows()[at]
            begin, doc, tag = at - words.bounds[rows], ids[words.first_row + rows], tags[words.first_row + rows]
            order = np.lexsort((begin, doc, h2, h1))
            h1, h2, doc, begin, tag = h1[order], h2[order], doc[order], begin[order], tag[order]
            first, more = _folded((h1, h2), [tag, begin, doc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[first]), pa.array(h2[first]), pa.array(doc[first]), pa.array(begin[first].astype(np.int32)), pa.array(tag[first]), pa.array(more, pa.binary())],
                names=["h1", "h2", "doc", "start", "tag", "more"],
            )


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, start) of the windows that are not the first of their sequence, from rows sorted by h1, h2, doc, start."""
    last: tuple[int, int, int, int] | None = None  # hash and place of the first window of the present group
    for batch in batches:
        if not len(batch):
            continue
        h1, h2, doc, start, tag = (np.asarray(batch.column(c)).astype(np.int64) for c in ("h1", "h2", "doc", "start", "tag"))
        begins = _group_starts(h1, h2)
        first = np.repeat(begins, np.diff(np.append(begins, len(h1))))
        fd, fs = doc[first], start[first]
        if last is not None and (h1[0], h2[0]) == last[:2]:
            fd[first == 0], fs[first == 0] = last[2], last[3]
        later = (doc != fd) | (start != fs)
        out = [(doc[later], tag[later], start[later])]
        more = batch.column("more")
        for i in np.flatnonzero(np.asarray(more.is_valid().cast(pa.int8()))):
            t, s, d = np.frombuffer(more[int(i)].as_py(), dtype=np.int64).reshape(-1, 3).T
            other = (d != fd[i]) | (s != fs[i])
            out.append((d[other], t[other], s[other]))
        doc_, tag_, start_ = (pa.array(np.concatenate(c), pa.int64()) for c in zip(*out))
        yield pa.RecordBatch.from_arrays([doc_, tag_, start_.cast(pa.int32())], names=["doc", "tag", "start"])
        last = (int(h1[-1]), int(h2[-1]), int(fd[-1]), int(fs[-1]))


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words of these spans joined by one space."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    out = data[np.minimum(where, len(data) - 1)]
    out[np.cumsum(lengths) - 1] = 0x20
    return out[:-1].tobytes()


def _outcome(texts: bool):
    """Per document: counts, and the digest of the kept text or the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies = batch.column("removed"), batch.column("copy").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for words in scan_words(batch.column("text"), 4 << 20):
                out = []
                for r in range(words.n_rows):
                    a, b = words.bounds[r], words.bounds[r + 1]
                    n = b - a
                    gone = np.zeros(n + 1, dtype=np.int32)
                    if n >= WINDOW and copies[words.first_row + r]:
                        gone[0] = 1
                    elif (listed := lists[words.first_row + r]).is_valid:
                        s = np.unique(np.asarray(listed.values))
                        s = s[s + WINDOW <= n]
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + WINDOW, -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = _kept(words.data, words.starts[a:b][keep], words.ends[a:b][keep])
                    out.append((ids[words.first_row + r], int(n), int(n - keep.sum()), kept.decode() if texts else hashlib.sha256(kept).hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(documents: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words left, joined by spaces (or the SHA-256 of that in UTF-8)."""
    doc = F.coalesce("doc_id", F.lit(LAST_ID))
    base = documents.select("doc_id", doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64("text")).withColumn("check", F.hash("text"))
    rows = base.select("text", "rid").mapInArrow(_anchor_rows, "a bigint, rid bigint, twice boolean, more binary")
    shared = rows.repartition("a").sortWithinPartitions("a", "rid").mapInArrow(_shared_anchors, "rid bigint, a bigint")
    first = base.groupBy("rid", "check").agg(F.min("doc").alias("first"))
    several = first.groupBy("first").agg((F.count("*") > 1).alias("several"))
    first = first.join(several, "first").select("rid", "check", "first", F.when(F.col("several"), F.col("rid")).otherwise(0).alias("tag"))
    # staged, so that the shuffle of all anchors is gone before windows are shuffled
    hits = staged(shared.groupBy("rid").agg(F.collect_set("a").alias("anchors")), "anchors", free=True)
    found = base.join(first.join(hits, "rid"), ["rid", "check"]).withColumn("mine", F.col("doc") == F.col("first"))
    # all columns go along, and copies go in the worker, so that this join and the last one read the texts from one shuffle
    windows = found.select("doc_id", "check", "doc", "rid", "text", "tag", "anchors", "mine").mapInArrow(_window_rows, "h1 bigint, h2 bigint, doc bigint, start int, tag bigint, more binary")
    later = windows.repartition("h1").sortWithinPartitions("h1", "h2", "doc", "start").mapInArrow(_later_windows, "doc bigint, tag bigint, start int")
    removed = later.groupBy(F.col("doc").alias("first"), "tag").agg(F.collect_set("start").alias("removed"))
    verdict = first.join(removed, ["first", "tag"], "left")
    done = base.join(verdict, ["rid", "check"]).select("doc_id", "check", "doc", "rid", "text", "removed", (F.col("doc") != F.col("first")).alias("copy"))
    return done.mapInArrow(_outcome(texts), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")


SQL = {
    "op9_substring_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST_ID}) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, k, i, first_value(k) OVER o AS fk, first_value(i) OVER o AS fi FROM g WINDOW o AS (PARTITION BY g ORDER BY k, i)) WHERE (k, i) <> (fk, fi)),
x AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM f),
e AS (SELECT r, doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT e.r, count(*) AS n_left, string_agg(e.w, ' ' ORDER BY e.i) AS t FROM e ANTI JOIN x ON e.r = x.r AND e.i = x.i GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_left, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""
}
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
