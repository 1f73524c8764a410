"""Query evaluation: one filtered scan of an index, one shuffle by document, one expression for the whole tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrid.operators.index import BITMAP_BYTES, bitmap_array, bucketed, matrix
from lexgrid.plans.query import Node, Not, Nothing, Pair, QueryError, Term, holds_when_absent, parse, words


#: Buckets of documents whose bits a task holds at once.
HELD_BUCKETS = 4096


def _tree(query: str | Node) -> Node:
    return parse(query + "\n") if isinstance(query, str) else query


def documents_matching(postings: DataFrame, query: str | Node, universe: DataFrame) -> DataFrame:
    """doc_id of the documents that match at document level: terms, & | ! and \\."""
    tree = _tree(query)
    _no_near(tree)
    return _flagged(postings, tree, universe, F.col("term"), words(tree), lambda n: n.word if isinstance(n, Term) else None)


def _no_near(node: Node) -> None:
    if isinstance(node, Pair):
        if node.op == "near":
            raise QueryError("Operation not supported.")
        _no_near(node.left), _no_near(node.right)
    elif isinstance(node, Not):
        _no_near(node.of)


def _flagged(index: DataFrame, tree: Node, universe: DataFrame, key: Column, names: list, leaf) -> DataFrame:
    flags = [F.bool_or(key == n).alias(f"f{i}") for i, n in enumerate(names)]
    rows = index.where(key.isin(names) if names else F.lit(False)).groupBy("doc_id").agg(*(flags or [F.lit(False).alias("f0")]))
    if holds_when_absent(tree) or not names:
        rows = universe.select("doc_id").join(rows, "doc_id", "left")

    def value(node: Node) -> Column:
        if (name := leaf(node)) is not None:
            return F.coalesce(F.col(f"f{names.index(name)}"), F.lit(False))
        if isinstance(node, Not):
            return ~value(node.of)
        if isinstance(node, Pair):
            a, b = value(node.left), value(node.right)
            return {"&": a & b, "|": a | b, "\\": a & ~b}[node.op]
        return F.lit(False)

    return rows.where(value(tree)).select("doc_id")


def pairs_matching(bigrams: DataFrame, query: str | Node, universe: DataFrame) -> DataFrame:
    """doc_id by the word-pair index: every operand is two adjacent words; universe: documents with a pair."""
    tree = _tree(query)
    names: list[str] = []

    def leaf(node: Node) -> str | None:
        if isinstance(node, Pair) and node.op == "near":
            if isinstance(node.left, Term) and isinstance(node.right, Term) and (node.before, node.after) == (0, 1):
                return f"{node.left.word}_{node.right.word}"
            raise QueryError("Only 2 word queries are supported.")
        if isinstance(node, Term):
            raise QueryError("Only 2 word queries are supported.")
        return None

    def gather(node: Node) -> None:
        if (name := leaf(node)) is not None:
            if name not in names:
                names.append(name)
        elif isinstance(node, Not):
            gather(node.of)
        elif isinstance(node, Pair):
            gather(node.left), gather(node.right)

    gather(tree)
    first = [n.split("_")[0] for n in names]
    scan = bigrams.where(F.col("w1").isin(first)) if names else bigrams.limit(0)
    return _flagged(scan.withColumn("pair", F.concat_ws("_", "w1", "w2")), tree, universe, F.col("pair"), names, leaf)


def bitmap_matching(bitmaps: DataFrame, query: str | Node, universe: DataFrame | None = None) -> DataFrame:
    """doc_id by the bit matrix; NOT is taken within documents that have a term.

    universe: their ids; without it a query with NOT reads the bits of all terms.
    """
    tree = _tree(query)
    _no_near(tree)
    names = words(tree)
    each = [F.bitmap_or_agg(F.when(F.col("term") == n, F.col("bits"))).alias(f"b{i}") for i, n in enumerate(names)]
    asked = bitmaps.where(F.col("term").isin(names) if names else F.lit(False))
    if universe is not None and holds_when_absent(tree):
        none = F.lit(bytearray(BITMAP_BYTES))
        rows = asked.groupBy("bucket").agg(F.lit(1).alias("met"), *each)
        rows = bucketed(universe).join(rows, "bucket", "left").select("bucket", F.col("bits").alias("all"), *[F.coalesce(f"b{i}", none).alias(f"b{i}") for i in range(len(names))])
    else:
        if holds_when_absent(tree):
            schema = "bucket bigint, all binary, " + ", ".join(f"b{i} binary" for i in range(len(names)))
            of = F.coalesce(*[F.when(F.col("term") == n, F.lit(i)) for i, n in enumerate(names)], F.lit(-1))
            part = bitmaps.select("bucket", of.alias("asked"), "bits").mapInArrow(_united_by_bucket(len(names)), schema)
            rows = part.groupBy("bucket").agg(F.bitmap_or_agg("all").alias("all"), *[F.bitmap_or_agg(f"b{i}").alias(f"b{i}") for i in range(len(names))])
        else:
            rows = asked.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("all"), *each)

    def bits(col: pd.Series) -> np.ndarray:
        return np.stack([np.frombuffer(x, dtype=np.uint8) for x in col])

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            whole = bits(frame["all"])

            def value(node: Node) -> np.ndarray:
                if isinstance(node, Term):
                    return bits(frame[f"b{names.index(node.word)}"])
                if isinstance(node, Not):
                    return whole & ~value(node.of)
                if isinstance(node, Pair):
                    a, b = value(node.left), value(node.right)
                    return a & b if node.op == "&" else a | b if node.op == "|" else a & ~b
                return whole & 0

            set_ = np.unpackbits(value(tree), axis=1, bitorder="little")
            row, bit = np.nonzero(set_)
            first = (frame["bucket"].to_numpy() - 1) * set_.shape[1]
            yield pd.DataFrame({"doc_id": first[row] + bit})

    return rows.mapInPandas(run, "doc_id bigint")


def _united_by_bucket(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, all, b0, b1, ...) of a task's bitmaps (bucket, asked, bits): held by bucket, as sorting them would hold every term's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            whole = np.stack([*held.values()])
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.int64()), *[bitmap_array(whole[:, i]) for i in range(n + 1)]], names=["bucket", "all", *[f"b{i}" for i in range(n)]])

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                bits, buckets, asked = matrix(part.column("bits")), np.asarray(part.column("bucket")), np.asarray(part.column("asked"))
                for bucket in np.unique(buckets).tolist():
                    own = held.setdefault(bucket, np.zeros((n + 1, BITMAP_BYTES), dtype=np.uint8))
                    mine = buckets == bucket
                    own[0] |= np.bitwise_or.reduce(bits[mine], axis=0)
                    for k in np.flatnonzero(mine & (asked >= 0)).tolist():
                        own[asked[k] + 1] |= bits[k]
                if len(held) > HELD_BUCKETS:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return run


def positions_matching(positional: DataFrame, query: str | Node, universe: DataFrame) -> DataFrame:
    """doc_id and pos of the documents that match; an empty pos marks a match without positions."""
    tree = _tree(query)
    names = words(tree)
    rows = positional.where(F.col("term").isin(names) if names else F.lit(False)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("m"))
    if holds_when_absent(tree):
        rows = universe.select("doc_id").join(rows, "doc_id", "left")
    made: dict[Node, Column] = {}
    none = F.lit(None).cast("array<bigint>")
    empty = F.array().cast("array<bigint>")

    def bound(node: Node) -> Column:
        """The node's value in a column of its own; equal nodes share one."""
        nonlocal rows
        if node not in made:
            value = expression(node)
            name = f"n{len(made)}"
            rows = rows.withColumn(name, value)
            made[node] = F.col(name)
        return made[node]

    def expression(node: Node) -> Column:
        if isinstance(node, Term):
            return F.try_element_at("m", F.lit(node.word))
        if isinstance(node, Not):
            return F.when(bound(node.of).isNull(), empty).otherwise(none)
        if isinstance(node, Pair):
            a, b = bound(node.left), bound(node.right)
            if node.op == "&":
                return F.array_intersect(a, b)
            if node.op == "|":
                return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_union(a, b))
            if node.op == "\\":
                left = F.when(b.isNull(), a).otherwise(F.array_except(a, b))
            else:
                def met(right: Column) -> Column:
                    def near(p: Column) -> Column:
                        hit = F.filter(right, lambda q: q.between(p - node.before, p + node.after))
                        return F.when(F.size(hit) > 0, F.array_append(hit, p)).otherwise(hit)

                    return F.array_distinct(F.flatten(F.transform(a, near)))

                # b is bound by a lambda, else it would be computed again for each position of a
                left = F.element_at(F.transform(F.array(b), lambda right: F.when(right.isNotNull(), met(right))), 1)
            return F.when(F.size(left) > 0, left).otherwise(none)
        return none

    answer = bound(tree)
    return rows.where(answer.isNotNull()).select("doc_id", F.sort_array(answer).alias("pos"))


def phrase_strict(positional: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id and start of exact consecutive occurrences, repeated words included."""
    names = list(dict.fromkeys(phrase))
    starts = positional.where(F.col("term").isin(names)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("m"))
    shifted = [F.transform(F.try_element_at("m", F.lit(w)), lambda p: p - k) for k, w in enumerate(phrase)]
    found = shifted[0]
    for s in shifted[1:]:
        found = F.array_intersect(found, s)
    return starts.select("doc_id", F.explode(found).alias("start"))


def near_joined(tokens: DataFrame, left: str, right: str, before: int, after: int) -> DataFrame:
    """The range-join form of near, for long documents with frequent words: doc_id and pos."""
    a = tokens.where(F.col("term") == left).select("doc_id", F.col("pos").alias("p"))
    b = tokens.where(F.col("term") == right).select("doc_id", F.col("pos").alias("q"))
    met = a.join(b, "doc_id").where(F.col("q").between(F.col("p") - before, F.col("p") + after))
    return met.select("doc_id", F.explode(F.array("p", "q")).alias("pos")).distinct()


def rendered(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Matches by id with their names and 1-based numbers; meant for a result that is shown."""
    return numbered(matches.select("doc_id"), [F.col("doc_id")], "number").join(documents.select("doc_id", "name"), "doc_id").select("number", "doc_id", "name")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Few rows with their 1-based places in an order: they meet in one task, so names and texts are joined after."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
