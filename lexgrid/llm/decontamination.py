"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is folded.  An item
of n characters has an error budget of ERROR_RATE * n edits and is split into
one piece more than that, so any passage within the budget holds one piece
unchanged.  An automaton finds the pieces, and Myers' bit-parallel algorithm
verifies the places that they point at.

Items shorter than SHORTEST characters after folding have no error budget and
count only at word edges: a letter or digit at an end of the item has none
beside it in the text.  An item without characters matches nothing, and a null
or empty text has no hit.  Repeated rows and items are judged
one by one; rows without an id are judged too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import table

ERROR_RATE = 0.05
SHORTEST = 24
#: Characters of test items handled in one pass over the documents; more items take more passes.
BLOCK_CHARACTERS = 2_000_000


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text, the first of equals, or None beyond `most` edits."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        across = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(across | up))
        minus = up & across
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


def at_edges(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word."""
    inner = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inner(a) and not inner(b)


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...]) -> None:
        self.items = [(i, f, int(ERROR_RATE * len(f)) if len(f) >= SHORTEST else 0) for i, t in items if (f := folded(t))]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, most) in enumerate(self.items):
            cuts = [len(text) * p // (most + 1) for p in range(most + 2)]
            for a, b in zip(cuts, cuts[1:]):
                found[text[a:b]].append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, budget, end in the folded text) of each item that the text holds."""
        if not self.items or not text:
            return []
        text = folded(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for k, stop in places:
                starts[k].add(end + 1 - stop)
        out = []
        for k, where in starts.items():
            item, pattern, most = self.items[k]
            best: tuple[int, int] | None = None
            if len(pattern) < SHORTEST:
                ends = [a + len(pattern) for a in sorted(where) if at_edges(text, a, a + len(pattern))]
                out += [(item, 0, 0, b) for b in ends[:1]]
                continue
            for a, b in merged(sorted(where), most, len(pattern)):
                got = myers(pattern, text[max(0, a) : b], most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], max(0, a) + got[1])
            if best:
                out.append((item, best[0], most, best[1]))
        return out


def merged(starts: list[int], most: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that cover every expected start, `most` characters wider on both sides; overlapping ones are joined."""
    a = b = None
    for s in starts:
        if a is None or s - most > b:
            if a is not None:
                yield a, b
            a = s - most
        b = s + length + most
    if a is not None:
        yield a, b


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(items)


def blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[tuple[tuple[int, str], ...]]:
    """The items, in blocks of about BLOCK_CHARACTERS; a block is all that the driver holds at once."""
    items = items.where(F.length(text) > 0).select(key, text)
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // BLOCK_CHARACTERS)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == k)
        yield tuple(sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that it holds: key, item_id, distance, budget, end.  No shuffle."""
    spark = documents.sparkSession
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id bigint, distance int, budget int, end int"
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(blocks(items)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            for batch in batches:
                rows = [(k.as_py(), *hit) for k, t in zip(batch.column(0), batch.column(1)) for hit in matcher.hits(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=[key, "item_id", "distance", "budget", "end"])

        found = documents.select(key, text).mapInArrow(run, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def clean(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with their own columns.  No shuffle."""
    spark = documents.sparkSession
    for block in blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(t.as_py()) for t in batch.column(text)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
SQL: dict[str, str] = {}
