"""N-gram Jaccard join as an exact metric-space join.

A document's set is its distinct SHINGLE-word shingles; documents link at a
Jaccard distance of at most EPSILON = 0.2.

Almost all documents are at distance 1 from any given document, where the
triangle inequality says nothing.  So a pre-step takes groups of shingles as
pivots.  The hash range is cut into 2**level parts, so that a set has 1.25 to
2.5 shingles a part; what a set has in a part is one cell.  Linked sets of a
and b shingles differ in at most (a + b) / 9, each of which spoils one part.  So
a document belongs to its cells that come first, most shingles first, as many
as it takes that two linked documents share a cell, and some more.  Cells of
single shingles come last: many documents share one by chance, and their number
grows with the input, few share two of one part.  Levels go by size; linked
sets meet at the smaller one's, so a set whose linked ones may have a lower
level has cells of both.  Sets under LOWEST shingles, and those with too few
parts to choose from, have cells of single shingles in hash order (see cells()).

The least member of a cell is its region's first document pivot; cells with one
pivot make one region.  Regions are then joined recursively and exactly by
document pivots, Voronoi regions and windows (see voronoi.py).

Cells that may be left out.  Let linked sets have a >= b elements, so that b >=
0.8 a.  A set of n takes extra(n) = n // 20 cells beyond those that make one
shared cell sure, so the two share 1 + b // 20 cells or more.  A set may leave
out its crowded cells (more than CROWDED members: a common passage) if they are
at most a third of allowance(n) = n // 25, and the regions that it meets in the
fewest cells, up to another third.  Of the shared cells, at most a third of a
// 25 go as crowded ones, and a third of a // 25 and of b // 25 by the choice
of either set: at most a // 25 <= b // 20 together, as a / 25 <= b / 20.  So
one shared cell stays.  For the same reason a set that meets others in no more
than allowance(n) cells has no link.

Equal texts are one member.  Nulls and texts without words have empty sets and
link with nothing.  A row without an id takes part, but gives its id to no
component.  Rows with the same id are linked by their texts alone.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import components, free_names, removed, table, with_rid
from lexgrid.llm.textscan import Words, mix, raw, row_sets, scan_words
from lexgrid.llm.voronoi import PERCENT, Attach, members_of_cells, region_links

SHINGLE = 5
CROWDED = 256
LAST_ID = (1 << 63) - 1
LOWEST = 20
_FOLD = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)), dtype=np.uint8)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each row in ascending hash order."""
    words.data = _FOLD[words.data]
    one = words.hashes()
    counts = words.counts()
    at, found = words.windows(SHINGLE, one)
    rows = words.rows()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = np.array([int(mix(one[words.bounds[r] : words.bounds[r + 1]] * np.arange(3, 3 + 2 * counts[r], 2, dtype=np.uint64)).sum(dtype=np.uint64)) for r in short], dtype=np.uint64)
    return row_sets(np.concatenate([rows[at], short]), np.concatenate([found, whole]), words.n_rows)


def extra(n: np.ndarray) -> np.ndarray:
    return n // 20


def prefix(n: np.ndarray) -> np.ndarray:
    """Single shingles that are cells of a set of n: two linked sets x, y share 1 + min(extra) of them or more."""
    return np.minimum(n, n - -(-n * PERCENT // 100) + 1 + extra(n))


def levels(n: np.ndarray) -> np.ndarray:
    """Bits of a part's number for sets of n: 1.25 to 2.5 elements a part; -1 for sets under LOWEST.  No level spans less than twice its least n."""
    return np.where(n < LOWEST, -1, np.frexp((4 * n // 5).astype(np.float64))[1] - 1)


def spoiled(total: np.ndarray) -> np.ndarray:
    """Elements that two linked sets of so many elements together have not in common, at most."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def cells(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): two linked sets x, y share 1 + min(extra) cells or more.

    Of the |P| parts of a set, those that hold no spoiled element are cells of
    both.  So of the first spoiled + 1 + extra in an order common to all, 1 +
    extra are shared, even if the other set has no more parts than that and all
    of them are its cells.  Where both have too few, they share single shingles.
    """
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)
    own, low = levels(n), levels(-(-n * PERCENT // 100))
    single = (own < 0) | (low < 0)
    found = []
    # at its own level a set may be the smaller one, at the lower level it is the larger
    for level, which, most in ((own, own >= 0, spoiled(n + n * 100 // PERCENT)), (low, (low >= 0) & (low != own), spoiled(2 * n))):
        mine = which[rows]
        if not mine.any():
            continue
        row, value = rows[mine], values[mine]
        part = value >> (64 - level[row]).astype(np.uint64)
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
        size = np.minimum(np.diff(np.append(starts, len(row))), 255)
        row = row[starts]
        cell = mix(np.add.reduceat(value, starts) + mix(level[row].astype(np.uint64)))
        count = np.bincount(row, minlength=len(n))
        wanted = most + 1 + extra(n)
        single |= which & (count < wanted)
        order = np.lexsort((cell, row.astype(np.int64) << 8 | 255 - size))
        place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        keep = place < wanted[row]
        found.append((row[keep], cell[order[keep]]))
    keep = single[rows] & (np.arange(len(values)) - bounds[rows] < prefix(n)[rows])
    found.append((rows[keep], values[keep]))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def allowance(n: Column) -> Column:
    """Cells that may go of those that a set of n shares with a linked one: 1 + max(allowance) or more are shared."""
    return F.floor(n / 25)


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, rid, tag): the cells of each text; tag is the size of its set."""
    for batch in batches:
        _, once = np.unique(np.asarray(batch.column("rid")), return_index=True)
        batch = batch.take(pa.array(np.sort(once)))
        rids = np.asarray(batch.column("rid"))
        for words in scan_words(batch.column("text"), 2 << 20):
            values, bounds = shingles(words)
            n = np.diff(bounds)
            rows, found = cells(values, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(rids[words.first_row + rows]), pa.array(n[rows].astype(np.int32))], names=["cell", "rid", "tag"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, items, regions): sets as bytes, from (rid, text, regions)."""
    for batch in batches:
        for words in scan_words(batch.column("text"), 2 << 20):
            values, bounds = shingles(words)
            items = pa.Array.from_buffers(pa.large_binary(), words.n_rows, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
            part = batch.slice(words.first_row, words.n_rows)
            yield pa.RecordBatch.from_arrays([part.column("rid"), items, part.column("regions")], names=["rid", "items", "regions"])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw(column)
    return data.view(np.uint64), offsets // 8


def links(texts: DataFrame, attach: Attach) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): enough links to connect every component of texts (rid, text); and the staged tables behind it."""
    dealt = texts.mapInArrow(_cell_rows, "cell bigint, rid bigint, tag int")
    met = dealt.repartition("cell").sortWithinPartitions("cell", "rid").mapInArrow(members_of_cells(CROWDED), "rid bigint, pivot bigint, crowded boolean, tag int")
    by_pivot = met.groupBy("rid", "pivot", "crowded").agg(F.count("*").alias("k"), F.max("tag").alias("n"))
    own = F.struct("k", "pivot", "crowded")
    regions = by_pivot.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(~F.col("crowded"), own))).alias("open"), F.collect_list(F.when(F.col("crowded"), own)).alias("shut"),
        F.sum("k").alias("met"), F.max("n").alias("n"),
    ).withColumn("room", allowance(F.col("n"))).where(F.col("met") > F.col("room"))
    third = F.floor(F.col("room") / 3)
    total = lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda s, x: s + x["k"])
    # the least regions go while their cells come to a third of the allowance
    tried = F.aggregate(
        "open", F.struct(F.lit(0).cast("bigint").alias("cells"), F.array().cast("array<bigint>").alias("kept")),
        lambda s, x: F.when(s["cells"] + x["k"] <= third, F.struct((s["cells"] + x["k"]).alias("cells"), s["kept"].alias("kept"))).otherwise(F.struct(s["cells"].alias("cells"), F.array_append(s["kept"], x["pivot"]).alias("kept"))),
        lambda s: s["kept"],
    )
    shut = F.when(total(F.col("shut")) > third, F.transform("shut", lambda x: x["pivot"])).otherwise(F.array().cast("array<bigint>"))
    chosen = F.array_distinct(F.concat(tried, shut))
    return region_links(regions.select("rid", F.col("n").cast("bigint").alias("n"), F.explode(chosen).alias("region")), attach, unpacked)


def _set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.diff(shingles(w)[1]) for w in scan_words(batch.column("text"), 2 << 20)]
        n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(n, pa.int64())], names=["doc_id", "rid", "n_shingles"])


def _components(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text, rid) of documents, (rid, first): each text's smallest id, and (node, component) of the linked texts."""
    base = with_rid(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    first = base.groupBy("rid").agg(F.min("doc_id").alias("first"))

    def attach(each: DataFrame) -> DataFrame:
        """The sets of the texts: of equal texts one copy."""
        one = first.join(each, "rid").withColumnRenamed("rid", "r")
        found = base.join(one, (F.col("rid") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("rid", "text", "regions")
        return found.mapInArrow(_packed, f"rid bigint, items binary, regions {found.schema['regions'].dataType.simpleString()}")

    edges, tables = links(base.select("rid", "text"), attach)
    found = components(edges)
    for t in tables:
        removed(documents.sparkSession, t)
    return base, first, found


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of documents (doc_id, text)."""
    base, first, found = _components(documents)
    sizes = base.mapInArrow(_set_sizes, "doc_id bigint, rid bigint, n_shingles bigint")
    named = found.join(first, found["node"] == first["rid"]).select("rid", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").select("rid", "least")
    named = first.join(named, "rid", "left").select("rid", F.coalesce("least", "first").alias("least"))
    empty = F.col("n_shingles") == 0
    return sizes.join(named, "rid").select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def survivors(documents: DataFrame) -> DataFrame:
    """(doc_id, rid): one row for each group of equal or linked texts that hold a word, with the smallest id, none last, then the smallest rid."""
    _, first, found = _components(documents)
    named = first.join(found, first["rid"] == found["node"], "left").select(F.coalesce("component", "rid").alias("component"), F.struct(F.col("first").isNull().alias("none"), "first", "rid").alias("own"))
    least = named.groupBy("component").agg(F.min("own").alias("own"))
    return least.select(F.col("own.first").alias("doc_id"), "own.rid")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of equal or linked texts, that of the smallest id (none last); other columns stay, whatever their names.

    Texts without words are in no group: their rows all stay.  Of repeated rows
    of one id and text, any one is taken.
    """
    rid, doc = free_names(documents, "rid", "doc")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = survivors(documents.where(worded)).select(F.col("rid").alias(rid), F.coalesce("doc_id", F.lit(LAST_ID)).alias(doc))
    keyed = with_rid(documents.where(worded), "text", rid).withColumn(doc, F.coalesce("doc_id", F.lit(LAST_ID)))
    one = keyed.join(kept, [rid, doc]).dropDuplicates([rid, doc])
    return one.select(*[F.col(f"`{c}`") for c in documents.columns]).unionByName(documents.where(~worded))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL: dict[str, str] = {}
