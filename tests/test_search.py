"""The search engine on hand-made fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators import codec, engine, evaluate, index, vector, zones
from lexgrid.plans.query import QueryError, holds_when_absent, parse
from lexgrid.sources import files, formats, store
from lexgrid.streaming.append import append_positional

TOKENIZER = [
    ("word Word WORD wOrD WoRd", 1, 5), ("кіт пес кіт їжак ґава єнот пес кіт", 5, 8), ("слово Слово СЛОВО сЛоВо СлОвО", 1, 5), ("об'єкт п'ять м'яч сім'я", 4, 4),
    ("one two three four one two three one two one one", 4, 11), ("!@#$%^&*()_+-=[]{};:,.<>/?1234", 0, 0), ("", 0, 0), (None, 0, 0),
]


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("text, unique, total", TOKENIZER)
def test_tokenizer_counts(spark, text, unique, total):
    r = index.dictionary_size(index.dictionary(index.tokens(frame(spark, text)))).first()
    assert (r.unique_words, r.total_words) == (unique, total)


@pytest.mark.parametrize("text, want", [("'tis dogs' rock'n'roll a1b don’t", ["tis", "dogs'", "rock'n'roll", "a", "b", "don", "t"]), ("İstanbul", ["i̇stanbul"]), ("ΟΔΟΣ", ["οδοσ"]), ("Straße Ⅷ", ["straße", "ⅷ"])])
def test_terms(spark, text, want):
    assert [r.term for r in index.tokens(frame(spark, text)).orderBy("pos").collect()] == want


@pytest.mark.parametrize("text, want", [("a\nb\nc\nd\ne\nf\ng\nh\ni\nj", (19, 9, 10)), ("abc def ghi jkl", (15, 3, 1)), ("abcd efgh\nijkl mnop\nqrst uvwx\nyzab cdef\nghi jkl", (47, 9, 5)), ("!@#$%^&*()_+-=[]{};:,.<>/?1234", (30, 30, 1)), ("", (0, 0, 1))])
def test_lexer_stats(spark, text, want):
    assert tuple(index.merged_stats(index.lexer_stats(frame(spark, text))).first()) == want


TREES = {
    "a > b > c": ">(a, >(b, c))", "a > b {2} c": ">(a, near2(b, c))", "a {2} b > c": "near2(a, >(b, c))", '"a b" {3} x': ">(a, near3(b, x))", '("a b") {3} x': "near3(>(a, b), x)", "!a > b": "!(>(a, b))",
    "a \\ b \\ c": "\\(\\(a, b), c)", "!a \\ b": "\\(!(a), b)", "a | b & !c": "|(a, &(b, !(c)))", "!(!a)": "!(!(a))", '"a"': "a", '""': "False", " ": "False", "a)": "a", 'a ""': "a", '"" a': "a",
}
ERRORS = {
    "!!a": "Missing argument", "a {1} !b": "Missing argument", "a &": "Missing argument", "a b": "single expression", '"a" "b"': "single expression", "(a": "Unexpected operator", 'a & ""': "Missing argument", "a {x} b": "Expected number",
    "a {} b": "Expected number", "a {3 b": "closing bracket", '"a b': "Unclosed phrase", '"a & b"': "Unexpected token in phrase", "5": "Unexpected token", "}": "Unexpected token", "a # b": "invalid character",
}


@pytest.mark.parametrize("text", TREES)
def test_trees(text):
    assert str(parse(text)) == TREES[text]


@pytest.mark.parametrize("text", ERRORS)
def test_parse_errors(text):
    with pytest.raises(QueryError, match=ERRORS[text]):
        parse(text)


def test_dialects():
    assert str(parse("a b", dialect="boolean")) == "b"
    with pytest.raises(QueryError, match="invalid character"):
        parse("a \\ b", dialect="boolean")
    with pytest.raises(QueryError, match="invalid character"):
        parse("hello", raw=True)
    assert holds_when_absent(parse("!a | b")) and not holds_when_absent(parse("a \\ !b"))


DOCS = ["hello big wide world", "world hello", "hello world hello", "what is love", "love is what", "is what love"]
MATCHES = {
    "hello & world": {0: [], 1: [], 2: []}, "hello | love": {0: [0], 1: [1], 2: [0, 2], 3: [2], 4: [0], 5: [2]}, "!hello": {3: [], 4: [], 5: []}, "hello \\ world": {0: [0], 1: [1], 2: [0, 2]},
    "hello \\ (hello > world)": {0: [0], 1: [1], 2: [2]}, "hello \\ !world": {0: [0], 1: [1], 2: [0, 2]}, "hello > world": {2: [0, 1]}, "hello {1} world": {1: [0, 1], 2: [0, 1, 2]},
    "hello {3} world": {0: [0, 3], 1: [0, 1], 2: [0, 1, 2]}, '"what is love"': {3: [0, 1]}, "hello > hello": {0: [0], 1: [1], 2: [0, 2]}, " ": {}, "zzz": {}, "!zzz & is": {3: [], 4: [], 5: []}, "(hello & world) {3} wide": {},
}


@pytest.mark.parametrize("text", MATCHES)
def test_positional_queries(spark, text):
    t = index.tokens(frame(spark, *DOCS))
    got = evaluate.positions_matching(index.positional(t), text, index.universe(t)).collect()
    assert {r.doc_id: r.pos for r in got} == MATCHES[text]


def test_overmatching_and_strict(spark):
    t = index.tokens(frame(spark, "b a", "a b a"))
    assert {r.doc_id for r in evaluate.positions_matching(index.positional(t), '"a b a"', index.universe(t)).collect()} == {0, 1}
    assert [tuple(r) for r in evaluate.phrase_strict(index.positional(t), ["a", "b", "a"]).collect()] == [(1, 0)]


def test_document_level(spark):
    t = index.tokens(frame(spark, *DOCS, "", None))
    p, u = index.postings(t), index.universe(t)
    for text, want in {"hello & world": {0, 1, 2}, "hello \\ world": set(), "hello \\ !world": {0, 1, 2}, "!hello": {3, 4, 5}, "hello | what": {0, 1, 2, 3, 4, 5}, "!(hello | what)": set()}.items():
        assert {r.doc_id for r in evaluate.documents_matching(p, text, u).collect()} == want, text
        for universe in (None, u):
            assert {r.doc_id for r in evaluate.bitmap_matching(index.bitmaps(p), text, universe).collect()} == want, text
    with pytest.raises(QueryError, match="not supported"):
        evaluate.documents_matching(p, "a > b", u)


def test_word_pairs(spark):
    pairs = index.bigrams(frame(spark, *DOCS))
    u = pairs.select("doc_id").distinct()
    assert {r.doc_id for r in evaluate.pairs_matching(pairs, "is > what | hello > world", u).collect()} == {2, 4, 5}
    assert {r.doc_id for r in evaluate.pairs_matching(pairs, "!(is > what)", u).collect()} == {0, 1, 2, 3}
    for text in ("a", "a {3} b", '"a b c"'):
        with pytest.raises(QueryError, match="2 word"):
            evaluate.pairs_matching(pairs, text, u)


def test_codec(spark):
    assert [codec.vb(n).hex() for n in (0, 5, 127, 128, 300, 16384)] == ["80", "85", "ff", "0180", "02ac", "010080"]
    small = [("a", [0, 2]), ("ab", [1]), ("abc", [130]), ("b", [0])]
    assert codec.encode(small).hex() == "30613162326330620082808281818101828180"
    assert codec.decode(codec.encode(small)) == small
    p = spark.createDataFrame([(t, i) for t, ids in small + [("éa", [3]), ("éb", [1 << 21, 1 << 22])] for i in ids], "term string, doc_id long")
    assert index.same(codec.decompressed(codec.compressed(p)), p)
    assert index.same(codec.from_gaps(codec.gaps(p), "doc_id"), p)


def test_cosine(spark):
    t = index.term_frequencies(index.tokens(frame(spark, *DOCS)))
    w = vector.weights(t)
    sims = {r.doc_id: round(r.sim, 6) for r in vector.cosine(w, ["hello", "world"]).collect()}
    assert sims == {1: 1.0, 2: 0.948683, 0: 0.407861, 3: 0.0, 4: 0.0, 5: 0.0}
    for words in ([], ["zzz"]):
        with pytest.raises(vector.EmptyQuery):
            vector.cosine(w, words)
    led = vector.leaders(t.select("doc_id"), 6)
    assert led.count() == 2
    for nearest in (True, False):
        follow = vector.followers(w, led, nearest=nearest)
        assert follow.count() == 8 and follow.groupBy("doc_id").count().where("count = 2").count() == 4
    assert vector.cluster_query(w, led, follow, ["love"]).count() == 4
    assert vector.cluster_query(w, led, follow, ["love"], repeats=True).count() == 8


def test_followers_make_no_pairs(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, t, round(draw.random(), 2)) for i in range(60) for t in draw.sample("abcdefghijklmnopqrstuvwxyz", draw.randint(1, 9)) + ["usual"]] + [(60, "zz", 0.0), (None, "usual", 0.5)]
    w = spark.createDataFrame(rows, "doc_id long, term string, w double")
    led = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "doc_id long")
    of = {}
    for i, t, x in rows:
        of.setdefault(i, {})[t] = x
    norm = {i: sum(x * x for x in v.values()) ** 0.5 for i, v in of.items()}
    sim = lambda a, b: sum(x * of[b].get(t, 0) for t, x in of[a].items()) / (norm[a] * norm[b]) if norm[a] else 0.0
    size = spark.createDataFrame([*norm.items()], "doc_id long, norm double")
    for sign in (1, -1):
        found = vector.followers(w, led, nearest=sign > 0, size=size)
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {(l, i): round(sim(i, l), 9) for i in range(61) if i % 7 or i > 59 for l in sorted(range(0, 60, 7), key=lambda l: (-sign * round(sim(i, l), 9), l))[:2]}
        assert {(r.leader, r.doc_id): round(r.sim, 9) for r in found.collect()} == want
    # the same in small parts
    monkeypatch.setattr(vector, "PRODUCTS", 7), monkeypatch.setattr(vector, "HELD_ROWS", 5)
    terms, lead = sorted({t for _, t, _ in rows}), [r for r in rows if r[0] is not None and r[0] % 7 == 0 and r[0] < 60]
    held = vector.Leaders(np.arange(0, 60, 7), np.array([norm[i] for i in range(0, 60, 7)]), *(np.array(c) for c in ([r[0] for r in lead], [terms.index(r[1]) for r in lead], [r[2] for r in lead])), len(terms))
    own = [r for i in range(60) if i % 7 for r in [(i, -1, norm[i])] + sorted((i, terms.index(t), x) for t, x in of[i].items())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own[k : k + 3])], names=["doc_id", "tid", "w"]) for k in range(0, len(own), 3)]
    got = {(l, i): round(x, 9) for b in vector._best_leaders(batches, held, 2, False) for l, i, x in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {k: x for k, x in want.items() if k[1] < 60}


def test_documents_are_indexed_where_they_are_read(spark):
    own = frame(spark, *DOCS, "", None, "it's Straße ΟΔΟΣ it's", "x" * 3)
    for made in (index.positional_of, index.postings_of, index.frequencies_of, index.offsets, index.bigrams):
        assert "Exchange" not in made(own)._jdf.queryExecution().executedPlan().toString(), made


@pytest.mark.parametrize("repeated", [1 << 17, 0])
def test_documents_of_one_id(spark, monkeypatch, repeated):
    monkeypatch.setattr(index, "REPEATED", repeated)
    d = spark.createDataFrame([*enumerate(DOCS), (1, "hello again hello"), (None, "a b a"), (None, "b c"), (9, ""), (10, None), (11, "Ünï ünï 5 ΟΔΟΣ"), (11, "ünï")], "doc_id long, text string")
    t = index.tokens(d)
    assert index.same(index.positional_of(d), index.positional(t))
    assert index.same(index.postings_of(d), index.postings(t))
    tf = index.frequencies_of(d)
    assert index.same(tf.drop("len"), index.term_frequencies(t))
    assert index.same(tf.select("doc_id", "len").distinct(), index.document_lengths(index.term_frequencies(t)))
    assert index.bigrams(d).where("doc_id = 1").count() == 3 and index.bigrams(d).where("doc_id is null").count() == 3
    ids = "doc_id in (0, 2, 3, 4, 5, 9, 10)"
    assert index.same(index.offsets(d).where(ids), index.offsets(d.where(ids))) and index.offsets(d).where("doc_id is null").count() == 3
    assert index.same(vector.weights(tf), vector.weights(tf.drop("len")))


def test_bits_are_dealt_before_they_are_put_together(spark):
    p = spark.createDataFrame([("a", 0), ("a", 40000), ("b", 1), ("c", 70000)], "term string, doc_id long")
    u = p.select("doc_id").distinct()
    for made in (index.bitmaps(p), index.merged_bitmaps(index.bitmaps(p), index.bitmaps(p))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():  # no piece of 4 KB is shuffled or sorted
            assert "Exchange" not in line or "REPARTITION_BY_COL" in line, line
    parts = [index.bitmaps(p.where(f"doc_id % 3 = {k}")) for k in range(3)]
    merged = index.merged_bitmaps(*parts)
    assert index.same(merged, index.bitmaps(p))
    for text, want in {"a": {0, 40000}, "!a": {1, 70000}, "!zz": {0, 1, 40000, 70000}, "!a & !b": {70000}}.items():
        for universe in (None, u):
            assert {r.doc_id for r in evaluate.bitmap_matching(merged, text, universe).collect()} == want, text


@pytest.mark.parametrize("n, code", [(0, "80"), (5, "85"), (300, "02ac"), (1 << 56, "010000000000000080"), ((1 << 63) - 1, "7f" * 8 + "ff"), (None, None)])
def test_number_codes(spark, n, code):
    r = spark.createDataFrame([(n,)], "n long").select(T.vb_hex(F.col("n")).alias("h"), T.vb_number(T.vb_hex(F.col("n"))).alias("n")).first()
    assert (r.h, r.n) == (code, n)


BOOK = """<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>
<author><first-name>Ann</first-name><last-name>Lee</last-name></author><author><nickname>zed</nickname></author>
<book-title>Love</book-title></title-info></description><body><section><title><p>skipme</p></title>
<epigraph><p>epi</p></epigraph><p>one <strong>bold</strong> two</p>
<section><p>love three</p><cite><p>no</p></cite></section></section></body></FictionBook>"""


def test_zones(spark):
    d = spark.createDataFrame([(0, "data/books/love.fb2", BOOK), (1, "a/broken.fb2", "<x>"), (2, "b/plain.txt", "love it")], "doc_id long, name string, text string")
    found, bad = zones.segments(d)
    z = zones.zone_postings(found)
    assert [r.doc_id for r in bad.collect()] == [1]
    score = lambda t: {r.doc_id: (r.score, r.kinds) for r in zones.ranked(z, t).collect()}
    assert score("love") == {0: (0.8, ["Body", "Filename", "Title"]), 2: (0.2, ["Body"])}
    assert score("fb")[0] == (0.2, ["Filename"]) and score("zed")[0] == (0.1, ["Authors"]) and score("three")[0] == (0.2, ["Body"])
    for t in ("skipme", "epi", "bold", "no"):
        assert score(t) == {}


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"one two", "b.txt": b"\xff\xfe", "c.txt": b"", "d.txt": "été".encode()}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    good, bad = files.read_documents(spark, str(tmp_path))
    assert [(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()] == [(0, "one two"), (1, ""), (2, "été")]
    assert [r.name.rsplit("/")[-1] for r in bad.collect()] == ["b.txt"]
    assert files.read_documents(spark, str(tmp_path), limit=2)[0].count() == 1
    assert files.corpus_size(good).first().bytes == 12


def test_files_of_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "AT_ONCE", 2)
    for name in ("a; isDirectory=true; length=9.txt", "b [1] %20.txt", "c\nd.txt", "é.txt", "k=1.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "zz.bin").write_bytes(b"\xff")
    for part in ("k=1", "sub"):
        (tmp_path / part).mkdir()
        (tmp_path / part / "inner.txt").write_text("inner")
    names = sorted(p.name for p in tmp_path.iterdir() if p.is_file())
    assert [x.rsplit("/")[-1] for x in files.listed(spark, str(tmp_path))] == names
    good, bad = files.read_documents(spark, str(tmp_path))
    assert [(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()] == [(i, "" if n == "empty.txt" else n) for i, n in enumerate(n for n in names if n != "zz.bin")]
    assert [r.name.rsplit("/")[-1] for r in bad.collect()] == ["zz.bin"]


def test_a_listing_takes_few_calls(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.txt").touch()
    client = spark.sparkContext._gateway._gateway_client
    sent, calls = client.send_command, []
    client.send_command = lambda *a, **k: calls.append(a) or sent(*a, **k)
    try:
        assert len(files.listed(spark, str(tmp_path))) == 300
    finally:
        client.send_command = sent
    assert len(calls) < 100


def test_formats(spark, tmp_path):
    words = spark.createDataFrame([("a", 2), ("b'c", 5), ("é", 1)], "term string, cnt long")
    for i, storage in enumerate((formats.KeyValueStorage(), formats.JsonStorage())):
        storage.write(f"{tmp_path}/{i}", words)
        assert index.same(storage.read(spark, f"{tmp_path}/{i}"), words)
    lines = spark.createDataFrame([("a=1",), ("a=2",)], "value string")
    assert formats.KeyValueStorage.parsed(lines).first().cnt == 3
    for bad in ("a=1=2", "a", "a=x"):
        with pytest.raises(PySparkException):
            formats.KeyValueStorage.parsed(spark.createDataFrame([(bad,)], "value string")).collect()
    formats.write_tf(index.term_frequencies(index.tokens(frame(spark, "a b a"))), f"{tmp_path}/tf")
    parts = sorted((tmp_path / "tf").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "0:3\n#\na|0:2\nb|0:1\n"
    lengths, terms = formats.read_tf(spark, f"{tmp_path}/tf")
    assert [tuple(r) for r in lengths.collect()] == [(0, 3)]
    assert sorted(tuple(r) for r in terms.collect()) == [("a", 0, 2), ("b", 0, 1)]
    assert formats.size_on_disk(spark, f"{tmp_path}/tf").first().bytes > 0


def test_filters_reach_the_scan(spark, tmp_path):
    formats.store(index.postings(index.tokens(frame(spark, *DOCS))), f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    plan = evaluate.documents_matching(p, "hello & world", p)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_streaming_append(spark, tmp_path):
    frame(spark, *DOCS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    append_positional(stream, f"{tmp_path}/idx", f"{tmp_path}/ck").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/idx").drop("segment")
    assert index.same(got, index.positional(index.tokens(frame(spark, *DOCS))))


def test_gaps_over_segments(spark, monkeypatch):
    monkeypatch.setattr(codec, "SEGMENT_DOCUMENTS", 10)
    p = spark.createDataFrame([(t, i) for t, ids in (("a", [0, 3, 9, 10, 47, 48]), ("b", [35]), ("c", [9, 10])) for i in ids], "term string, doc_id long")
    got = {(r.term, r.doc_id): r.gap for r in codec.gaps(p).collect()}
    assert got == {("a", 0): 0, ("a", 3): 3, ("a", 9): 6, ("a", 10): 1, ("a", 47): 37, ("a", 48): 1, ("b", 35): 35, ("c", 9): 9, ("c", 10): 1}
    assert index.same(codec.from_gaps(codec.gaps(p), "doc_id"), p)


def test_gaps_are_summed_in_one_pass(spark):
    p = spark.createDataFrame([("a", i) for i in (1, 5, 9)], "term string, doc_id long")
    assert "Join" not in codec.from_gaps(codec.gaps(p), "doc_id")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_over_segments(spark, monkeypatch):
    monkeypatch.setattr(formats, "SEGMENT_DOCUMENTS", 10)
    p = spark.createDataFrame([("a", i) for i in (1, 2, 15)] + [("b", 30)], "term string, doc_id long")
    lines = formats.index_lines(p)
    assert sorted(r.value for r in lines.collect()) == ["a:1,2", "a:15", "b:30"]
    assert index.same(formats.index_from_lines(lines), p)


@pytest.mark.parametrize("read", [formats.index_from_lines, formats.tf_from_lines])
def test_rows_of_a_line_do_not_carry_it(spark, read):
    plan = read(spark.createDataFrame([("a:1,2",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "value#" not in plan.split("Generate")[0]


def test_engine(spark):
    e = engine.Engine(frame(spark, *DOCS))
    ids = lambda text, mode: {r.doc_id for r in e.search(text, mode).collect()}
    assert ids("hello & world", "documents") == ids("hello & world", "matrix") == {0, 1, 2}
    assert ids("hello > world", "positional") == {2} and ids("is > what", "pairs") == {4, 5}
    assert {r.doc_id: round(r.sim, 6) for r in e.search("Hello, WORLD!", "vector").collect()} == {1: 1.0, 2: 0.948683, 0: 0.407861, 3: 0.0, 4: 0.0, 5: 0.0}
    assert [tuple(r) for r in e.closest("hello world", 2).orderBy("rank").collect()] == [(1, 1, 1.0, "1"), (2, 2, 0.9487, "2")]
    assert 0 <= e.space.recall(["love"], 2) <= 1
    for text in ("", "12 !"):
        with pytest.raises(vector.EmptyQuery, match="empty"):
            e.search(text, "vector")
    with pytest.raises(vector.EmptyQuery, match="any word"):
        e.search("zzz", "vector")
    with pytest.raises(ValueError, match="mode"):
        e.search("a", "other")
    got = e.figures()
    assert got["round_trip"] == 1 and got["bytes"] == sum(map(len, DOCS)) and got["text_bytes"] > got["compressed_bytes"] > 0 and got["build_s"] > 0
    assert engine.timed(lambda: 5)[0] == 5


class Unset:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf, self.sparkContext = {}, self
        self.master = master


def test_shared_folder():
    assert store.shared_folder(Unset("local[2]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            store.shared_folder(Unset(master))
