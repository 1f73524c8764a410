"""One search entry over stored indexes, for query texts, and figures of building and searching."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators import codec, evaluate, index, vector
from lexgrid.sources import formats
from lexgrid.sources.store import stored

MODES = ("documents", "matrix", "positional", "pairs", "vector")


def timed(action: Callable[[], Any]) -> tuple[Any, float]:
    """What the action returns, and its seconds."""
    began = time.perf_counter()
    return action(), time.perf_counter() - began


class Engine:
    """Indexes of documents (doc_id, text), each built and stored when a mode first needs it.

    Files of positions and pairs are segments: they hold the documents that a
    task read, in order of terms, so that a search reads a few row groups of
    each and building shuffles nothing.
    """

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents
        self._made: dict[str, DataFrame] = {}

    def _table(self, name: str, make: Callable[[], DataFrame], by: str | None = "term", placed: bool = False) -> DataFrame:
        if name not in self._made:
            self._made[name] = stored(make(), name, by, placed)
        return self._made[name]

    @property
    def positional(self) -> DataFrame:
        return self._table("positional", lambda: index.positional_of(self.documents), placed=True)

    @property
    def universe(self) -> DataFrame:
        return self._table("universe", lambda: index.universe(self.positional), None)

    @property
    def bitmaps(self) -> DataFrame:
        return self._table("bitmaps", lambda: index.bitmaps(self.positional.select("term", "doc_id")), placed=True)

    @property
    def bigrams(self) -> DataFrame:
        return self._table("bigrams", lambda: index.bigrams(self.documents), "w1", placed=True)

    @property
    def space(self) -> vector.Space:
        tf = lambda: self._table("tf", lambda: index.frequencies_of(self.documents), None)
        return vector.Space(self._table("weights", lambda: vector.weights(tf()), placed=True), lambda df, name: self._table(name, lambda: df, None))

    def search(self, text: str, mode: str = "positional") -> DataFrame:
        """doc_id of the documents that match, with pos in mode positional, and with sim of all in mode vector."""
        if mode == "documents":
            return evaluate.documents_matching(self.positional, text, self.universe)
        if mode == "matrix":
            return evaluate.bitmap_matching(self.bitmaps, text, self.universe)
        if mode == "positional":
            return evaluate.positions_matching(self.positional, text, self.universe)
        if mode == "pairs":
            return evaluate.pairs_matching(self.bigrams, text, self.bigrams.select("doc_id").distinct())
        if mode == "vector":
            return self.space.cosine(lexed(self.documents, text))
        raise ValueError(f"mode must be one of {', '.join(MODES)}")

    def closest(self, text: str, k: int = 10, names: DataFrame | None = None) -> DataFrame:
        """rank, doc_id, weight (4 decimals) and name of the k documents closest to a query text."""
        best = vector.closest(self.search(text, "vector"), k)
        if names is not None:
            best = best.join(names.select("doc_id", "name"), "doc_id")
        else:
            best = best.withColumn("name", F.col("doc_id").cast("string"))
        # k rows: one task ranks them
        return evaluate.numbered(best, [F.desc(F.round("sim", 9)), F.col("doc_id")], "rank").select("rank", "doc_id", F.round("sim", 4).alias("weight"), "name")

    def figures(self) -> dict[str, float]:
        """Build seconds, bytes a second, and sizes of the text and compressed forms, with times and whether the round trip holds."""
        size = self.documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self._made.pop("positional", None)
        _, built = timed(lambda: self.positional)
        postings = self.positional.select("term", "doc_id")
        blobs, packed = timed(lambda: stored(codec.compressed(postings), "blobs"))
        same, unpacked = timed(lambda: index.same(codec.decompressed(blobs), postings))
        return {
            "bytes": size, "build_s": built, "bytes_s": size / built if built else 0.0,
            "text_bytes": formats.index_lines(postings).agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0,
            "compressed_bytes": blobs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0, "compress_s": packed, "decompress_s": unpacked, "round_trip": float(same),
        }


def lexed(documents: DataFrame, text: str) -> list[str]:
    """The terms of a query text, by the same expression that indexes documents."""
    return documents.sparkSession.range(1).select(T.terms(F.lit(text)).alias("t")).first()["t"] or []
