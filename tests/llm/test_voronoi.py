"""Region joins against brute force, with limits so low that every way of joining is taken."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrid.llm import jaccard_join, line_dedup, shared, voronoi
from tests.llm.test_operators import components, edited, shingles, write

PASSAGE = [f"license{i}" for i in range(40)]


def corpora(kind, n, rng):
    base = [f"b{i}" for i in range(60)]
    own = lambda i, k: [f"o{i}_{j}" for j in range(k)]
    if kind == "star":  # near copies of one text, most of them not linked to each other
        return [" ".join(base)] + [edited(rng, base, 1) for _ in range(n - 1)]
    if kind == "alike":  # near copies of which few are linked
        return [edited(rng, base, rng.choice((1, 2, 2, 3))) for _ in range(n)]
    if kind == "passage":  # a passage in otherwise different texts, a few of which have a near copy
        texts = [" ".join(own(i, 30) + PASSAGE + own(-i - 1, rng.randrange(60))) for i in range(n)]
        return texts + [edited(rng, t.split(), 1) for t in texts[: n // 10]]
    families = [[f"f{k}_{j}" for j in range(50)] for k in range(6)]
    return [edited(rng, rng.choice(families), rng.randrange(4)) for _ in range(n)]


def classes(texts, known=()):
    """The smallest place of each text's class.  Shingles of `known` alone make no link."""
    sets = [shingles(t) for t in texts]
    known = {*known}
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s - known:
            where[g].append(i)
    root = [*range(len(sets))]

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in sorted({p for v in where.values() for p in itertools.combinations(v, 2)}):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in range(len(sets))}


@pytest.mark.parametrize("kind", ["star", "alike", "passage", "families"])
def test_large_regions_by_brute_force(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(kind)
    monkeypatch.setattr(voronoi, "REGION", 40)
    monkeypatch.setattr(voronoi, "PIVOTS", 5)
    monkeypatch.setattr(jaccard_join, "CROWDED", 8)
    texts = corpora(kind, 260, rng)
    got = {r.doc_id: r.component_id for r in jaccard_join.op4_jaccard_join(spark, write(spark, [*enumerate(texts)], tmp_path)).collect()}
    assert got == classes(texts)


@pytest.mark.parametrize("items", [300, 1 << 21])
def test_long_members_are_dealt_by_their_elements(spark, tmp_path, monkeypatch, items):
    monkeypatch.setattr(voronoi, "ITEMS", items)
    rng = random.Random(9)
    texts = [edited(rng, [f"w{i}" for i in range(200)], rng.randrange(8)) for _ in range(12)]
    got = {r.doc_id: r.component_id for r in jaccard_join.op4_jaccard_join(spark, write(spark, [*enumerate(texts)], tmp_path)).collect()}
    assert got == classes(texts)


def rounds(monkeypatch):
    seen = []
    joined = voronoi._joined
    monkeypatch.setattr(voronoi, "_joined", lambda *a: seen.append(a[-2]) or joined(*a))
    return seen


def test_passage_of_5000_documents_takes_few_rounds(spark, tmp_path, monkeypatch):
    seen, rng = rounds(monkeypatch), random.Random(3)
    texts = corpora("passage", 5000, rng)
    got = {r.doc_id: r.component_id for r in jaccard_join.op4_jaccard_join(spark, write(spark, [*enumerate(texts)], tmp_path)).collect()}
    assert len(seen) < 10
    # 36 of the passage's shingles against 26 or more own ones on either side can't make 80 percent of a union
    assert got == classes(texts, shingles(" ".join(PASSAGE)))


def test_large_star_takes_few_rounds(spark, tmp_path, monkeypatch):
    seen, rng = rounds(monkeypatch), random.Random(4)
    texts = corpora("star", 4000, rng)
    got = {r.doc_id: r.component_id for r in jaccard_join.op4_jaccard_join(spark, write(spark, [*enumerate(texts)], tmp_path)).collect()}
    assert len(seen) < 6
    assert {*got.values()} == {0}


def test_region_by_brute_force():
    rng = random.Random(11)
    for turn in range(12):
        n = rng.choice((3, 40, 130, 260))
        words = [[f"w{k}_{i}" for i in range(40)] for k in range(3)]
        texts = [edited(rng, rng.choice(words), rng.randrange(4)) for _ in range(n)]
        sets = [shingles(t) for t in texts]
        ids = {s: i for i, s in enumerate(sorted({x for s in sets for x in s}))}
        rank = np.concatenate([sorted(ids[x] for x in s) for s in sets])
        bounds = np.cumsum([0, *map(len, sets)])
        links = voronoi.Region(np.arange(n), rank, bounds).links()
        root = [*range(n)]
        for a, b in links:
            assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        want = components(sets)
        assert [root[i] == root[j] for i in range(n) for j in range(i)] == [want[i] == want[j] for i in range(n) for j in range(i)]


def test_groups_over_batches():
    rows = [(1, 0, 5), (1, 0, 6), (1, 1, 5), (2, 0, 1), (2, 0, 2), (2, 0, 3), (3, 0, 1)]
    for size in range(1, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["region", "salt", "rid"]) for i in range(0, len(rows), size)]
        got = [[*zip(*(c.to_pylist() for c in b.columns))] for b in voronoi._whole_groups(batches)]
        assert [r for g in got for r in g] == rows
        ends = [g[-1][:2] for g in got]
        assert len({*ends}) == len(ends) and all(a[-1][:2] != b[0][:2] for a, b in zip(got, got[1:]))


def test_texts_whose_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(shared, "text_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    texts = [f"text number {i // 2}" for i in range(40)]
    rows = shared.with_rid(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(rows) == 40
    assert len({r.rid for r in rows}) == len({(r.rid, r.text) for r in rows}) == 20


def test_densified_signatures_differ_little_from_jaccard():
    rng = random.Random(5)
    met = total = 0
    for _ in range(150):
        line = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(30, 200)))
        at = rng.randrange(len(line))
        other = line[:at] + "#" + line[at + 1 :]
        sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (line, other)]
        if 100 * len(sets[0] & sets[1]) < 80 * len(sets[0] | sets[1]):
            continue
        batch = pa.RecordBatch.from_arrays([pa.array([line, other])], names=["text"])
        bands = [*line_dedup._band_rows([batch])]
        total += 1
        met += any(len({*b.column("band").to_pylist()}) == 1 for b in bands)
    assert total > 100 and met >= total - 1


def test_intersections_of_sets_with_values_of_the_same_upper_bits():
    rng = random.Random(6)
    sets = [sorted({rng.choice((0, 1 << 63)) + rng.randrange(12) for _ in range(rng.randrange(1, 12))}) for _ in range(60)]
    got = voronoi.Sets(np.array([x for s in sets for x in s], dtype=np.uint64), np.cumsum([0, *map(len, sets)]))
    i, j = np.triu_indices(60, 1)
    assert got.both(i, j).tolist() == [len({*sets[a]} & {*sets[b]}) for a, b in zip(i, j)]
