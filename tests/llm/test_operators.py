"""Operators against SQL, brute force and held-out data, and their edge cases."""

import collections
import glob
import gzip
import hashlib
import io
import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexgrid.llm import decontamination, jaccard_join, language, line_dedup, quality_classifier, quality_rules, registry, shared, substring_dedup, voronoi, warc

SCHEMA = "doc_id long, text string, rid int, ids string, _m int, cell int"
P = " ".join(f"word{i}" for i in range(40))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, P), (7, "x " + P), (8, P + "\n" + P), (None, P), (None, None), (9, "a b c d e"), (10, "A b\tc d  e"), (11, "é 日本 x" * 30),
    (12, "w " * 30000), (13, "l1 aaa\nl1 aaa\nl2 bbb\n\n"), (14, P.replace("word39", "other")), (6, P),
]


def write(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def duck(folder, sql):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = c.sql(sql)
    columns = sorted(found.columns)
    return columns, sorted(map(repr, found.select(*columns).fetchall()))


def same(df, folder, sql):
    columns, want = duck(folder, sql)
    assert sorted(df.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == want


@pytest.mark.parametrize("name", registry.SQL)
def test_against_sql(spark, small_dir, name):
    same(registry.QUERIES[name](spark, small_dir), small_dir, registry.SQL[name])


@pytest.mark.parametrize("name", ["op6_quality_rules", "op9_substring_dedup"])
def test_edge_cases_against_sql(spark, tmp_path, name):
    folder = write(spark, EDGE, tmp_path)
    same(registry.QUERIES[name](spark, folder), folder, registry.SQL[name])


@pytest.mark.parametrize("name", ["op1_bpe", "op2_language", "op4_jaccard_join", "op6_quality_rules", "op8_pii", "op9_substring_dedup", "op10_line_dedup"])
def test_edge_and_empty_tables(spark, tmp_path, name):
    for rows in (EDGE, []):
        d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        folder = f"{tmp_path}/{len(rows)}"
        d.write.parquet(f"{folder}/documents.parquet")
        assert registry.QUERIES[name](spark, folder).count() == len(rows)


def folded(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    both = collections.Counter(p for v in where.values() for p in itertools.combinations(v, 2))
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("region, salted", [(2048, False), (8, True)])
def test_jaccard_join_by_brute_force(spark, tmp_path, monkeypatch, region, salted):
    monkeypatch.setattr(voronoi, "REGION", region)
    rng = random.Random(region)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(4))) for i in range(14)] + [(i, edited(rng, [f"c{i % 7}_{k}" for k in range(60)], rng.randrange(3))) for i in range(30, 60)]
    rows += [(60, "a b"), (61, "A b"), (62, ""), (63, None)]
    rng.shuffle(rows)
    rows.sort()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op4_jaccard_join(spark, write(spark, rows, tmp_path)).collect()}
    roots = components([shingles(t) for _, t in rows])
    assert got == {i: (len(shingles(t)), rows[r][0]) for (i, t), r in zip(rows, roots)}


def test_line_dedup_by_brute_force(spark, small_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    lines = [(i, k, folded(x)) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    distinct = list(dict.fromkeys(x for *_, x in lines))
    roots = dict(zip(distinct, components([{x[a : a + 5] for a in range(max(1, len(x) - 4))} for x in distinct])))
    seen, gone = set(), collections.defaultdict(set)
    for i, k, x in lines:
        if roots[x] in seen:
            gone[i].add(k)
        seen.add(roots[x])
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op10_line_dedup(spark, small_dir).collect()}
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    assert got == {i: (len(gone[i]), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + rng.randrange(max(1, i))) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_myers_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        got = decontamination.myers(p, t, len(p))
        best = min(row[1:])
        assert got == (best, row.index(best, 1))


def test_decontamination(spark):
    rng = random.Random(6)
    item = "".join(rng.choice("abcdefgh ") for _ in range(200))
    item = " ".join(item.split())
    cut = lambda n: (lambda at: "".join("#" if i in at else c for i, c in enumerate(item)))({*rng.sample(range(len(item)), n)})
    budget = int(0.05 * len(item))
    d = spark.createDataFrame([(0, f"zz {item.upper()} yy"), (1, "q " + cut(budget)), (2, cut(budget + 1)), (3, None), (4, ""), (5, "clean text " * 50), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, "short"), (7, None)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.distance) for r in decontamination.leaks(d, items).collect()}
    assert got == {0: (9, 0), 1: (9, budget), None: (9, 0)}
    assert {r.doc_id for r in decontamination.clean(d, items).collect()} == {2, 3, 4, 5}
    assert decontamination.leaks(d, items.limit(0)).count() == 0


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = language.op2_language(spark, folder).join(truth, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    assert language.Compressors({}).predict("abc") == ("und", 0.0, False)
    assert language.Compressors({"en": b"the"}).predict("12 34")[0] == "und"


def test_quality_classifier_held_out(spark):
    folder = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    g = quality_classifier.grade(spark.read.parquet(f"{folder}/labels.parquet"))
    out = F.col("doc_id") % 4 == 1
    model = quality_classifier.trained(d, g.where(~out))
    assert model.thresholds == sorted(model.thresholds)
    got = {r.grade: r.s for r in quality_classifier.scored(d, model).join(g.where(out), "doc_id").groupBy("grade").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert got[2] > 0.95 and got[0] < 0.3 and got[1] < 0.3


def test_warc(spark, tmp_path):
    big, other = "é" * 60, "z" * 150 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(3, "u\r\nX: y", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (6, "u", other), (7, "u", other), (None, "u", big)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op5_warc(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] != 6] == [(-1, 120, "revisit", 1), (1, 120, "response", None), (2, 5, "response", None), (3, 120, "revisit", 1), (4, 5, "response", None), (5, 0, "response", None), (7, len(other), "revisit", 6)]
    assert sorted(g[2] for g in got if g[0] == 6) == ["response", "revisit"]


def test_pipeline(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.staged(stage(spark, docs, small_dir), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    kept = {r.doc_id for r in docs.collect()}
    assert len(kept) == docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, small_dir).collect()} == kept
    assert decontamination.leaks(docs, spark.read.parquet(f"{small_dir}/benchmark.parquet")).count() == 0
    assert len({*components([shingles(r.text) for r in docs.collect() if shingles(r.text)])}) == sum(bool(shingles(r.text)) for r in docs.collect())
    assert quality_rules.passing(docs).count() <= docs.count() and substring_dedup.deduplicated(docs).count() == docs.count()


def test_pipeline_near_duplicates_of_repeated_and_missing_ids(spark):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    near = {k: t.replace(f"{k}59", "other") for k, t in text.items()}
    rows = [(1, text["a"]), (2, near["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"]), (None, text["a"]), (None, text["e"]), (None, text["e"]), (None, near["e"]), (4, text["b"]), (5, " \n"), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    e = [g for g in got if g[0] is None and g[1]]
    assert len(e) == 1 and e[0][1] in (text["e"], near["e"])
    want = [(1, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"]), (5, " \n"), (5, ""), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want + e))


def test_decontamination_of_short_items(spark):
    texts = ["Is 2+2  = 4? yes", "so, WHAT IS\nIT?", "what is its", "somewhat is it", "what isn't", "(what is it)", None, "", "  ", "a twenty letter wort xx", "a twenty letter words xx", "_what is it_ or somewhat is it"]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is it"), (2, "2+2 = 4?"), (3, " "), (4, ""), (5, None), (6, "twenty letter words xx")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.budget, r.end) for r in decontamination.leaks(d, items).collect())
    assert got == [(0, 2, 0, 0, 11), (1, 1, 0, 0, 14), (5, 1, 0, 0, 11), (10, 6, 0, 0, 24), (11, 1, 0, 0, 11)]
    assert {r.doc_id for r in decontamination.clean(d, items).collect()} == {2, 3, 4, 6, 7, 8, 9}


def test_line_dedup_of_repeated_and_missing_ids(spark):
    shared_line = "this line stands in both of the texts at the same place"
    rows = [(None, f"{shared_line}\nfirst text's own"), (None, f"{shared_line}\nanother ending"), (7, "head one\nsome line of seven"), (7, "top two\nsome line of seven"), (8, "twice the same row"), (8, "twice the same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in line_dedup.deduplicated(docs).collect()]
    lines = collections.Counter((i, x) for i, t in got for x in t.split("\n"))
    assert lines == {(i, x): 2 if i == 8 else 1 for i, t in rows for x in t.split("\n")}


class Unset:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf, self.sparkContext = {}, self
        self.master = master


def test_shared_folder():
    assert shared.shared_dir(Unset("local[2]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_dir(Unset(master))


def test_entry_hides_no_broken_import(monkeypatch):
    """Only an absent subpackage is passed over."""
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "lexgrid.llm.registry", None)
    monkeypatch.setitem(sys.modules, "lexgrid.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    assert not any(n.startswith("op") and n[2].isdigit() for n in importlib.reload(__spark_entry__).queries())
    monkeypatch.undo()
    monkeypatch.setitem(sys.modules, "zstandard", None)
    for name in [n for n in sys.modules if n.startswith("lexgrid.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ModuleNotFoundError, match="zstandard"):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()


def records(path):
    for p in sorted(glob.glob(f"{path}/part-*")):
        with gzip.open(p) as f:
            yield from warc.parse_archive(f)


def test_warc_records(spark, tmp_path):
    """Every record has an id of its own; a revisit names its response's id and url."""
    pages = spark.createDataFrame([(1, "http://a/ b", "p" * 200), (1, "http://a/ b", "p" * 200), (None, None, "p" * 200), (4, "http://d", "q" * 200), (5, "http://e", None)], "page_id long, url string, html string")
    warc.archived(pages, f"{tmp_path}/raw")
    warc.deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/small")
    raw, small = [*records(f"{tmp_path}/raw")], [*records(f"{tmp_path}/small")]
    ids = [h["WARC-Record-ID"] for h, *_ in small]
    assert len({*ids}) == 5 and {*ids} == {h["WARC-Record-ID"] for h, *_ in raw}
    first = next(h for h, _, body in small if h["WARC-Type"] == "response" and body == b"p" * 200)
    again = [h for h, *_ in small if h["WARC-Type"] == "revisit"]
    assert len(again) == 2 and first["X-Page-Id"] == "1"
    for h in again:
        assert (h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"], h["X-Refers-To-Page"]) == (first["WARC-Record-ID"], "http://a/%20b", "1")
    with pytest.raises(ValueError, match="cut off"):
        [*warc.parse_archive(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))]
    with pytest.raises(ValueError, match="no WARC record"):
        [*warc.parse_archive(io.BytesIO(b"x"))]


def test_warc_of_a_large_page_and_of_none(spark, tmp_path):
    big = "0123456789abcdef" * (50 << 16)
    for k, rows in enumerate(([(1, "u", big), (2, "u", big), (3, "u", "small")], [])):
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/{k}/pages.parquet")
        got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op5_warc(spark, f"{tmp_path}/{k}").collect())
        assert got == ([(1, len(big), "response", None), (2, len(big), "revisit", 1), (3, 5, "response", None)] if rows else [])
