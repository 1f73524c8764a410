"""TF-IDF vectors in sparse long form, cosine ranking and leader/follower cluster pruning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrid.operators.index import document_lengths
from lexgrid.sources.store import stored

INDEX_LEADERS = 2
QUERY_LEADERS = 2
#: Documents of the leader table up to which it is sent to every task.
BROADCAST_LEADERS = 2000
#: Products of weights, and rows of documents, that a task makes similarities of at once.
PRODUCTS, HELD_ROWS = 1 << 20, 1 << 19


class EmptyQuery(ValueError):
    pass


def frequencies(tf: DataFrame) -> DataFrame:
    """tf as share of the document's terms, by the column len if there is one."""
    sized = tf.where("doc_id is not null") if "len" in tf.columns else tf.join(document_lengths(tf), "doc_id")
    return sized.select("term", "doc_id", (F.col("cnt") / F.col("len")).alias("tf"))


def idf(tf: DataFrame, n: int) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log2(F.lit(n + 1.0) / (F.col("df") + 1.0)))


def document_count(tf: DataFrame) -> int:
    return tf.select("doc_id").distinct().count()


def weights(tf: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id, term and w = tf * log2((N + 1) / (df + 1))."""
    n = document_count(tf) if n is None else n
    # the terms of a partition are few beside its postings, which need no order for the join
    return frequencies(tf).join(idf(tf, n).hint("shuffle_hash"), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))


class Space:
    """Stored weights, and what is made of them once: norms, leaders and followers.

    store: writes a table of a name and gives it back; by default it goes to the shared folder.
    """

    def __init__(self, weights: DataFrame, store: Callable[[DataFrame, str], DataFrame] = stored) -> None:
        self.weights, self._store = weights, store
        self._made: dict[str, DataFrame] = {}

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._store(make(), name)
        return self._made[name]

    @property
    def norms(self) -> DataFrame:
        return self._table("norms", lambda: norms(self.weights))

    @property
    def leaders(self) -> DataFrame:
        return self._table("leaders", lambda: leaders(self.norms.select("doc_id"), self.norms.count()))

    @property
    def followers(self) -> DataFrame:
        return self._table("followers", lambda: followers(self.weights, self.leaders, size=self.norms))

    def cosine(self, query_terms: list[str]) -> DataFrame:
        return cosine(self.weights, query_terms, size=self.norms)

    def cluster_query(self, query_terms: list[str], k: int = QUERY_LEADERS) -> DataFrame:
        return cluster_query(self.weights, self.leaders, self.followers, query_terms, k, sims=self.cosine(query_terms))

    def recall(self, query_terms: list[str], k: int = 10) -> float:
        """The share of the k closest documents that the pruned search finds."""
        best = closest(self.cosine(query_terms), k).select("doc_id")
        return best.join(self.cluster_query(query_terms).select("doc_id"), "doc_id", "left_semi").count() / max(1, best.count())


def norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine(weights: DataFrame, query_terms: list[str], size: DataFrame | None = None) -> DataFrame:
    """doc_id and sim for every document: the query is binary over the vocabulary.

    size: norms made before, so that only the postings of the asked terms are read.
    """
    if not query_terms:
        raise EmptyQuery("Query can't be empty")
    asked = F.col("term").isin(sorted({*query_terms}))
    k = weights.where(asked).select("term").distinct().count()
    if k == 0:
        raise EmptyQuery("Index doesn't contain any word from the query")
    if size is not None:
        dots = weights.where(asked).groupBy("doc_id").agg(F.sum("w").alias("dot"))
        return size.join(dots, "doc_id", "left").select("doc_id", F.when(F.col("norm") > 0, F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * math.sqrt(k))).otherwise(0.0).alias("sim"))
    rows = weights.groupBy("doc_id").agg(F.sum(F.when(asked, F.col("w")).otherwise(0.0)).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select("doc_id", F.when(F.col("norm") > 0, F.col("dot") / (F.col("norm") * math.sqrt(k))).otherwise(0.0).alias("sim"))


def closest(sims: DataFrame, k: int, nearest: bool = True, by: str | None = None) -> DataFrame:
    """The k most (or, for nearest=False, least) similar rows, for each value of `by`; ties by id."""
    order = F.desc("r") if nearest else F.asc("r")
    rounded = sims.withColumn("r", F.round("sim", 9))
    if by is None:
        return rounded.orderBy(order, "doc_id").limit(k).drop("r")
    w = Window.partitionBy(by).orderBy(order, "leader")
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("r", "rank")


def leader_order(doc_id: Column | str = "doc_id") -> Column:
    """A fixed scatter of ids that any SQL engine can compute."""
    return (F.col(doc_id) * F.lit(2654435761)) % F.lit(4294967296)


def leaders(doc_ids: DataFrame, n: int) -> DataFrame:
    """floor(sqrt(N)) documents in the order of the scatter."""
    return doc_ids.select("doc_id").distinct().orderBy(leader_order(), "doc_id").limit(math.isqrt(n))


def followers(weights: DataFrame, leaders: DataFrame, k: int = INDEX_LEADERS, nearest: bool = True, size: DataFrame | None = None) -> DataFrame:
    """leader, doc_id and sim: each other document with its k closest leaders.

    Every document is compared to every leader, but no pair of the two is ever
    a row: tasks hold the leaders' weights, take the documents whole and give
    out only the k best of each.
    """
    spark = weights.sparkSession
    size = norms(weights) if size is None else size
    size = size.where("doc_id is not null")
    own = weights.where("w <> 0 and doc_id is not null")
    led = leaders.select(F.col("doc_id").alias("leader"))
    if leaders.count() <= BROADCAST_LEADERS:
        led = F.broadcast(led)
    table = own.join(led, own["doc_id"] == led["leader"]).select("leader", "term", "w").toArrow().combine_chunks()
    named = size.join(led, size["doc_id"] == led["leader"]).select("leader", "norm").orderBy("leader").toArrow()
    coded = pc.dictionary_encode(table["term"]).combine_chunks()
    tids, terms = np.asarray(coded.indices), coded.dictionary
    sent = spark.sparkContext.broadcast(Leaders(np.asarray(named["leader"]), np.asarray(named["norm"]), np.asarray(table["leader"]), tids, np.asarray(table["w"]), len(terms)))
    vocabulary = spark.createDataFrame(pa.table({"term": terms.cast(pa.string()), "tid": np.arange(len(terms), dtype=np.int32)}))
    rows = own.join(F.broadcast(vocabulary), "term").select("doc_id", "tid", "w")
    rows = rows.unionByName(size.select("doc_id", F.lit(-1).alias("tid"), F.col("norm").alias("w"))).join(led, F.col("doc_id") == F.col("leader"), "left_anti")
    best = lambda batches: _best_leaders(batches, sent.value, k, nearest)
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "tid").mapInArrow(best, "leader bigint, doc_id bigint, sim double")


class Leaders:
    """Weights of the leaders, by term: those of terms that many leaders have as a full matrix, others as lists."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, leader: np.ndarray, tid: np.ndarray, w: np.ndarray, n_terms: int) -> None:
        self.ids, self.size = ids, size
        place = np.searchsorted(ids, leader)
        count = np.bincount(tid, minlength=n_terms)
        often = count > len(ids) // 8
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.full = np.zeros((int(often.sum()), len(ids)))
        mine = often[tid]
        self.full[self.row[tid[mine]], place[mine]] = w[mine]
        order = np.flatnonzero(~mine)
        order = order[np.argsort(tid[order], kind="stable")]
        self.place, self.w = place[order], w[order]
        self.count = np.where(often, 0, count)
        self.start = np.cumsum(self.count) - self.count

    def sims(self, doc: np.ndarray, tid: np.ndarray, w: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """documents x leaders, from the documents' weights: place of the document, term and weight; and their norms."""
        n = len(self.ids)
        row = self.row[tid]
        often = row >= 0
        held = np.zeros((len(norm), len(self.full)))
        held[doc[often], row[often]] = w[often]
        out = held @ self.full
        doc, tid, w = doc[~often], tid[~often], w[~often]
        count = self.count[tid]
        ends = np.cumsum(count)
        at = 0
        while at < len(doc):
            stop = max(at + 1, int(np.searchsorted(ends, PRODUCTS + (ends[at - 1] if at else 0), side="right")))
            c = count[at:stop]
            of = np.repeat(np.arange(at, stop), c)
            entry = np.arange(len(of)) + np.repeat(self.start[tid[at:stop]] - (np.cumsum(c) - c), c)
            low, high = doc[at], doc[stop - 1] + 1
            out[low:high] += np.bincount((doc[of] - low) * n + self.place[entry], w[of] * self.w[entry], (high - low) * n).reshape(-1, n)
            at = stop
        scale = norm[:, None] * self.size
        return np.divide(out, scale, out=np.zeros_like(out), where=scale > 0)


def _best_leaders(batches: Iterator[pa.RecordBatch], led: Leaders, k: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """(leader, doc_id, sim) from (doc_id, tid, w) in order; a document's first row has its norm, with -1 as term."""
    n = len(led.ids)

    def closed(docs: np.ndarray, tids: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.append(np.flatnonzero(tids < 0), len(tids))
        step = max(1, PRODUCTS // max(n, len(led.full), 1))
        for first in range(0, len(heads) - 1 if n else 0, step):
            head = heads[first : first + step + 1]
            mine = slice(head[0], head[-1])
            doc = np.repeat(np.arange(len(head) - 1), np.diff(head))
            term = tids[mine] >= 0
            sims = led.sims(doc[term], tids[mine][term], w[mine][term], w[head[:-1]])
            rank = np.floor(sims * 1e9 + 0.5) * (1 if nearest else -1)
            each = np.arange(len(sims))
            for _ in range(min(k, n)):  # the first of equals is the one of the least id
                best = rank.argmax(axis=1)
                rank[each, best] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(led.ids[best]), pa.array(docs[head[:-1]]), pa.array(sims[each, best])], names=["leader", "doc_id", "sim"])

    held: list[tuple[np.ndarray, ...]] = []
    total = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(tuple(np.asarray(c) for c in batch.columns))
        total += len(batch)
        if total >= HELD_ROWS and (held[-1][1] < 0).any():
            docs, tids, w = (np.concatenate(c) for c in zip(*held))
            last = np.flatnonzero(tids < 0)[-1]
            yield from closed(docs[:last], tids[:last], w[:last])
            held, total = [(docs[last:], tids[last:], w[last:])], len(docs) - last
    if held:
        yield from closed(*(np.concatenate(c) for c in zip(*held)))


def cluster_query(weights: DataFrame, leaders: DataFrame, followers: DataFrame, query_terms: list[str], k: int = QUERY_LEADERS, nearest: bool = True, repeats: bool = False, sims: DataFrame | None = None) -> DataFrame:
    """doc_id and sim of the followers of the k leaders closest to the query; repeats: a follower of two leaders counts twice."""
    sims = cosine(weights, query_terms) if sims is None else sims
    chosen = closest(sims.join(leaders.select("doc_id"), "doc_id", "left_semi"), k, nearest).select(F.col("doc_id").alias("leader"))
    found = followers.join(F.broadcast(chosen), "leader").select("doc_id")
    found = found if repeats else found.distinct()
    return found.join(sims, "doc_id").orderBy(F.desc("sim"), "doc_id")
