"""Registered queries of the search engine and SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.operators import codec, engine, evaluate, index, vector, zones
from lexgrid.sources import files, formats
from lexgrid.sources.store import fresh_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOK = r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{L}[\p{L}'']*'), lambda x: lower(x)) AS w FROM documents),
tok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM d),
uni AS (SELECT DISTINCT doc_id FROM tok)"""


def query(sql: str | None = None, tok: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"{TOK} {sql}" if tok else sql
        return f

    return put


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def toks(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(documents(spark, d))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings_of(documents(spark, d))


def long_pos(df: DataFrame) -> DataFrame:
    """Matches as rows: doc_id and position, -1 for a match without positions."""
    return df.select("doc_id", F.explode(F.when(F.size("pos") == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.col("pos"))).alias("pos"))


@query("SELECT doc_id, pos::BIGINT AS pos, term FROM tok")
def tokenize(spark, d):
    return toks(spark, d)


STATS = r"SELECT doc_id, length(coalesce(text, ''))::BIGINT AS characters_read, (length(coalesce(text, '')) - coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}'']*'), lambda x: length(x))), 0))::BIGINT AS characters_ignored, (1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::BIGINT AS lines FROM documents"


@query(STATS, tok=False)
def lexer_stats(spark, d):
    return index.lexer_stats(documents(spark, d))


@query(f"SELECT sum(characters_read)::BIGINT AS characters_read, sum(characters_ignored)::BIGINT AS characters_ignored, sum(lines)::BIGINT AS lines FROM ({STATS})", tok=False)
def lexer_stats_total(spark, d):
    return index.merged_stats(index.lexer_stats(documents(spark, d)))


WORDS = "SELECT term, count(*) AS cnt FROM tok GROUP BY term"


@query(WORDS)
def word_count(spark, d):
    return index.dictionary(toks(spark, d))


@query("SELECT doc_id, term, count(*) AS cnt FROM tok GROUP BY ALL")
def dictionary_per_doc(spark, d):
    return index.dictionary(toks(spark, d), "doc_id")


@query("SELECT count(DISTINCT term) AS unique_words, count(*) AS total_words FROM tok")
def dictionary_size(spark, d):
    return index.dictionary_size(index.dictionary(toks(spark, d)))


@query(WORDS)
def dictionary_merge(spark, d):
    t = toks(spark, d)
    return index.merged_dictionaries(*[index.dictionary(t.where(F.col("doc_id") % 3 == k)) for k in range(3)])


@query(WORDS)
def keyval_roundtrip(spark, d):
    lines = index.dictionary(toks(spark, d)).select(F.concat_ws("=", "term", F.col("cnt").cast("string")).alias("value"))
    return formats.KeyValueStorage.parsed(lines)


@query(WORDS)
def json_dictionary_roundtrip(spark, d):
    return formats.JsonStorage.parsed(formats.JsonStorage().lines(index.dictionary(toks(spark, d))))


@query("SELECT DISTINCT term, doc_id FROM tok")
def inverted_index(spark, d):
    return postings(spark, d)


@query("SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def positional_index(spark, d):
    return index.positional_of(documents(spark, d)).select("term", "doc_id", F.array_join(F.transform("pos", lambda p: p.cast("string")), ",").alias("positions"))


@query(r""", c AS (SELECT doc_id, regexp_extract_all(text, '[^\p{L}]*(?:\p{L}[\p{L}'']*)') AS g FROM documents),
e AS (SELECT doc_id, generate_subscripts(g, 1) AS i, lower(ltrim(regexp_extract(unnest(g), '\p{L}[\p{L}'']*$'))) AS term, octet_length(encode(unnest(g))) AS n FROM c)
SELECT doc_id, term, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM e""")
def offset_index(spark, d):
    return index.offsets(documents(spark, d)).select("doc_id", "term", F.explode("offsets").alias("at"))


@query("SELECT doc_id FROM uni")
def doc_universe(spark, d):
    return index.universe(toks(spark, d))


@query(", p AS (SELECT doc_id, term AS w1, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok) SELECT DISTINCT w1, w2, doc_id FROM p WHERE w2 IS NOT NULL")
def bigram_index(spark, d):
    return index.bigrams(documents(spark, d))


@query("SELECT term, count(DISTINCT doc_id) AS ones FROM tok GROUP BY term")
def incidence_matrix(spark, d):
    return index.bitmaps(postings(spark, d)).groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("ones"))


@query("SELECT term, count(DISTINCT doc_id) AS ones FROM tok GROUP BY term")
def matrix_merge(spark, d):
    p = postings(spark, d)
    return index.merged_bitmaps(*[index.bitmaps(p.where(F.col("doc_id") % 2 == k)) for k in range(2)]).groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("ones"))


def docs_of(word: str) -> str:
    return f"SELECT doc_id FROM tok WHERE term = '{word}'"


def _boolean(name: str, text: str, sql: str, matrix: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = toks(spark, d)
        if matrix:
            return evaluate.bitmap_matching(index.bitmaps(index.postings(t)), text, index.universe(t))
        return evaluate.documents_matching(t.select("term", "doc_id"), text, index.universe(t))

    run.__name__ = name
    query(sql)(run)


A, B, C = (docs_of(w) for w in ("with", "that", "la"))
_boolean("bool_and", "with & that", f"{A} INTERSECT {B}")
_boolean("bool_or", "with | la", f"{A} UNION {C}")
_boolean("bool_not", "!with", f"SELECT doc_id FROM uni EXCEPT {A}")
_boolean("bool_nested", "(with | la) & !(that & of)", f"({A} UNION {C}) EXCEPT ({B} INTERSECT {docs_of('of')})")
_boolean("bool_subtract", "with \\ that", f"{A} EXCEPT {B}")
_boolean("bool_matrix", "(with | la) & !that", f"({A} UNION {C}) EXCEPT {B}", matrix=True)


@query("SELECT 0::BIGINT AS differing")
def bool_crosscheck(spark, d):
    t = toks(spark, d)
    p = postings(spark, d)
    a = evaluate.documents_matching(p, "(with & that) | !of", index.universe(t)).select("doc_id", F.lit(1).alias("a"))
    b = evaluate.bitmap_matching(index.bitmaps(p), "(with & that) | !of").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full").where("a is null or b is null").agg(F.count("*").alias("differing"))


def _positional(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = toks(spark, d)
        return long_pos(evaluate.positions_matching(index.positional(t), text, index.universe(t)))

    run.__name__ = name
    query(sql)(run)


def pos_of(word: str) -> str:
    return f"SELECT doc_id, pos::BIGINT AS pos FROM tok WHERE term = '{word}'"


def near_sql(left: str, right: str, a: int, b: int) -> str:
    on = f"l.doc_id = r.doc_id AND r.pos BETWEEN l.pos - {a} AND l.pos + {b}"
    return f"SELECT r.doc_id, r.pos FROM ({left}) l JOIN ({right}) r ON {on} UNION SELECT l.doc_id, l.pos FROM ({left}) l JOIN ({right}) r ON {on}"


OF, THE = pos_of("of"), pos_of("the")
_positional("pos_and", "with & that", f"SELECT doc_id, -1::BIGINT AS pos FROM ({A} INTERSECT {B})")
_positional("pos_or", "with | la", f"{pos_of('with')} UNION {pos_of('la')}")
_positional("pos_not", "!with", f"SELECT doc_id, -1::BIGINT AS pos FROM (SELECT doc_id FROM uni EXCEPT {A})")
_positional("pos_subtract_next", "of \\ (of > the)", f"{OF} EXCEPT ({near_sql(OF, THE, 0, 1)})")
_positional("near_3", "of {3} the", near_sql(OF, THE, 3, 3))
_positional("near_1", "with {1} that", near_sql(pos_of("with"), pos_of("that"), 1, 1))
_positional("next", "of > the", near_sql(OF, THE, 0, 1))
_positional("next_chain", "and > (of > the)", near_sql(pos_of("and"), near_sql(OF, THE, 0, 1), 0, 1))
_positional("phrase", '"and of the"', near_sql(pos_of("and"), near_sql(OF, THE, 0, 1), 0, 1))


@query("SELECT a.doc_id, a.pos::BIGINT AS start FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def phrase_exact(spark, d):
    return evaluate.phrase_strict(index.positional(toks(spark, d)), ["of", "the"])


@query(near_sql(OF, THE, 3, 3))
def near_range_join(spark, d):
    return evaluate.near_joined(toks(spark, d), "of", "the", 3, 3)


PAIR = "SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = '{}' AND b.term = '{}'"


@query(f"{PAIR.format('of', 'the')} EXCEPT {PAIR.format('to', 'the')}")
def bigram_lookup(spark, d):
    pairs = index.bigrams(documents(spark, d))
    return evaluate.pairs_matching(pairs, "of > the \\ (to > the)", pairs.select("doc_id").distinct())


@query(f"SELECT row_number() OVER (ORDER BY doc_id) AS number, doc_id, 'doc/' || doc_id AS name FROM (SELECT DISTINCT doc_id FROM ({near_sql(OF, THE, 0, 1)}))")
def result_rendering(spark, d):
    return flagship(spark, d).select("number", "doc_id", "name")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The documents with `of` right before `the`, numbered in order of ids, with names."""
    t = toks(spark, d)
    found = evaluate.positions_matching(index.positional(t), "of > the", index.universe(t))
    named = documents(spark, d).select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"))
    return evaluate.rendered(found, named)


@query("SELECT term, term || ':' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS line FROM (SELECT DISTINCT term, doc_id FROM tok) GROUP BY term")
def index_text_format(spark, d):
    return formats.index_lines(postings(spark, d)).withColumnRenamed("value", "line")


@query("SELECT DISTINCT term, doc_id FROM tok")
def index_text_roundtrip(spark, d):
    return formats.index_from_lines(formats.index_lines(postings(spark, d)))


@query(", tf AS (SELECT term, doc_id, count(*) AS c FROM tok GROUP BY ALL) SELECT term, term || '|' || string_agg(doc_id || ':' || c, ',' ORDER BY doc_id) AS line FROM tf GROUP BY term UNION ALL SELECT '' AS term, doc_id || ':' || sum(c)::BIGINT AS line FROM tf GROUP BY doc_id")
def tf_index_text_format(spark, d):
    lengths, terms = formats.tf_lines(index.frequencies_of(documents(spark, d)))
    return terms.select("term", F.col("value").alias("line")).unionByName(lengths.select(F.lit("").alias("term"), F.col("value").alias("line")))


@query("SELECT term, doc_id, count(*) AS cnt FROM tok GROUP BY ALL")
def tf_index_text_roundtrip(spark, d):
    return formats.tf_from_lines(formats.tf_lines(index.frequencies_of(documents(spark, d)))[1])


GAPS = ", p AS (SELECT DISTINCT term, doc_id FROM tok), g AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM p)"
NB = "(1 + (gap >= 128)::INT + (gap >= 16384)::INT + (gap >= 2097152)::INT + (gap >= 268435456)::INT)"


@query(f"{GAPS} SELECT * FROM g")
def gap_encode(spark, d):
    return codec.gaps(postings(spark, d))


@query("SELECT DISTINCT term, doc_id FROM tok")
def gap_roundtrip(spark, d):
    return codec.from_gaps(codec.gaps(postings(spark, d)), "doc_id")


@query(f"{GAPS} SELECT term, doc_id, array_to_string(list_transform(range({NB}), lambda i: printf('%02x', (((gap >> (7 * ({NB} - 1 - i)))) & 127) + CASE WHEN i = {NB} - 1 THEN 128 ELSE 0 END)), '') AS code FROM g")
def vb_bytes(spark, d):
    return codec.gaps(postings(spark, d)).select("term", "doc_id", T.vb_hex(F.col("gap")).alias("code"))


@query(f"{GAPS} SELECT term, doc_id, gap FROM g")
def vb_roundtrip(spark, d):
    return codec.gaps(postings(spark, d)).select("term", "doc_id", T.vb_number(T.vb_hex(F.col("gap"))).alias("gap"))


@query(""", t AS (SELECT DISTINCT term FROM tok), b AS (SELECT term, coalesce(lag(term) OVER (PARTITION BY left(term, 1) ORDER BY term), '') AS prev FROM t),
x AS (SELECT term, list_max(list_filter(range(0, least(length(prev), length(term)) + 1), lambda i: left(prev, i) = left(term, i))) AS prefix FROM b)
SELECT term, prefix::BIGINT AS prefix, substr(term, prefix + 1) AS suffix FROM x""")
def front_coding(spark, d):
    return codec.front_coded(toks(spark, d).select("term"), block=1)


@query("SELECT DISTINCT term, doc_id FROM tok")
def compressed_roundtrip(spark, d):
    return codec.decompressed(codec.compressed(postings(spark, d)))


@query(f"""{GAPS}, t AS (SELECT term, count(*) AS gap, sum(length(doc_id::VARCHAR)) AS digits FROM p GROUP BY term)
SELECT (SELECT sum(octet_length(encode(term)) + 1 + digits + gap)::BIGINT FROM t) AS text_bytes, (SELECT sum({NB})::BIGINT FROM t) AS count_bytes, (SELECT sum({NB})::BIGINT FROM g) AS gap_bytes""")
def compression_sizes(spark, d):
    return codec.sizes(postings(spark, d))


ZONES = r"""WITH s AS (SELECT page_id AS doc_id, 'Title' AS kind, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS text FROM pages
UNION ALL SELECT page_id, 'Body', regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') FROM pages
UNION ALL SELECT page_id, 'Filename', unnest(list_filter(string_split(url, '/'), lambda p: p <> '')) FROM pages),
z AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '\p{L}[\p{L}'']*'), lambda x: lower(x))) AS term, doc_id, kind FROM s)"""


def page_zones(spark: SparkSession, d: str) -> DataFrame:
    return zones.page_segments(spark.read.parquet(f"{d}/pages.parquet"))


@query(f"{ZONES} SELECT doc_id, kind, text FROM s", tok=False)
def zone_segments(spark, d):
    return page_zones(spark, d)


@query(f"{ZONES} SELECT term, doc_id, kind FROM z", tok=False)
def zone_postings(spark, d):
    return zones.zone_postings(page_zones(spark, d))


@query(f"{ZONES} SELECT doc_id, round(sum(CASE kind WHEN 'Filename' THEN 0.2 WHEN 'Title' THEN 0.4 WHEN 'Body' THEN 0.2 ELSE 0.1 END)::DOUBLE, 4) AS score, string_agg(kind, ',' ORDER BY kind) AS kinds FROM z WHERE term = 'the' GROUP BY doc_id", tok=False)
def zone_rank(spark, d):
    return zones.ranked(zones.zone_postings(page_zones(spark, d)), "the").withColumn("kinds", F.array_join("kinds", ","))


@query(r"SELECT page_id, regexp_replace(html, '<br\s*/?>', ' ', 'g') AS html FROM pages", tok=False)
def strip_br(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", zones.strip_breaks("html").alias("html"))


VEC = """, tf AS (SELECT term, doc_id, count(*) AS cnt FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(cnt) AS len FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, cnt / len * log2((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) AS w FROM tf JOIN dl USING (doc_id) JOIN df USING (term), n),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"""
ASKED = ("with", "that", "ing", "estion")
LIST = ", ".join(f"'{t}'" for t in ASKED)
COS = f"""{VEC}, k AS (SELECT count(*) AS k FROM df WHERE term IN ({LIST})),
c AS (SELECT doc_id, CASE WHEN norm > 0 THEN coalesce(sum(w) FILTER (term IN ({LIST})), 0) / (norm * sqrt(k)) ELSE 0 END AS sim FROM w JOIN nm USING (doc_id), k GROUP BY doc_id, norm, k)"""
CLUSTERS = f"""{COS}, ld AS (SELECT doc_id AS leader FROM dl ORDER BY (doc_id * 2654435761) % 4294967296, doc_id LIMIT (SELECT floor(sqrt(n))::BIGINT FROM n)),
dots AS (SELECT a.doc_id, b.doc_id AS leader, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term) WHERE b.doc_id IN (FROM ld) AND a.doc_id NOT IN (FROM ld) GROUP BY ALL),
sims AS (SELECT o.doc_id AS doc_id, l.leader AS leader, coalesce(dot / nullif(o.norm * m.norm, 0), 0) AS sim FROM nm o CROSS JOIN ld l JOIN nm m ON m.doc_id = l.leader LEFT JOIN dots ON dots.doc_id = o.doc_id AND dots.leader = l.leader WHERE o.doc_id NOT IN (FROM ld)),
fo AS (SELECT leader, doc_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, leader) AS r FROM sims) WHERE r <= 2)"""


def tf_of(spark: SparkSession, d: str) -> DataFrame:
    return index.frequencies_of(documents(spark, d))


def space_of(spark: SparkSession, d: str) -> vector.Space:
    """Weights of the documents, stored: what a search reads."""
    t = stored(tf_of(spark, d), "tf")
    return vector.Space(stored(vector.weights(t), "weights", "term", placed=True))


@query(f"{VEC} SELECT term, doc_id, round(cnt / len, 9) AS tf FROM tf JOIN dl USING (doc_id)")
def tf(spark, d):
    return vector.frequencies(tf_of(spark, d)).withColumn("tf", F.round("tf", 9))


@query(f"{VEC} SELECT term, df, round(log2((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)), 6) AS idf FROM df, n")
def df_idf(spark, d):
    t = tf_of(spark, d)
    return vector.idf(t, vector.document_count(t)).withColumn("idf", F.round("idf", 6))


@query(f"{VEC} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tf_idf(spark, d):
    return vector.weights(stored(tf_of(spark, d), "tf")).withColumn("w", F.round("w", 6))


@query(f"{VEC} SELECT doc_id, round(norm, 6) AS norm FROM nm")
def doc_norms(spark, d):
    return space_of(spark, d).norms.withColumn("norm", F.round("norm", 6))


@query(f"{COS} SELECT doc_id, round(sim, 6) AS sim FROM c")
def cosine_rank(spark, d):
    return space_of(spark, d).cosine(list(ASKED)).withColumn("sim", F.round("sim", 6))


@query(f"{COS} SELECT doc_id, round(sim, 6) AS sim FROM c ORDER BY round(sim, 9) DESC, doc_id LIMIT 10")
def closest_documents(spark, d):
    return vector.closest(space_of(spark, d).cosine(list(ASKED)), 10).withColumn("sim", F.round("sim", 6))


@query(f"{CLUSTERS} SELECT leader AS doc_id FROM ld")
def leaders(spark, d):
    return space_of(spark, d).leaders


@query(f"{CLUSTERS} SELECT leader, doc_id, round(sim, 6) AS sim FROM fo")
def followers(spark, d):
    return space_of(spark, d).followers.withColumn("sim", F.round("sim", 6))


@query(f"""{CLUSTERS}, best AS (SELECT doc_id AS leader FROM c WHERE doc_id IN (FROM ld) ORDER BY round(sim, 9) DESC, doc_id LIMIT 2)
SELECT DISTINCT doc_id, round(c.sim, 6) AS sim FROM fo JOIN best USING (leader) JOIN c USING (doc_id)""")
def cluster_query(spark, d):
    return space_of(spark, d).cluster_query(list(ASKED)).withColumn("sim", F.round("sim", 6))


@query(f"{COS} SELECT row_number() OVER (ORDER BY round(sim, 9) DESC, doc_id) AS rank, doc_id, round(sim, 4) AS weight, 'doc/' || doc_id AS name FROM c ORDER BY rank LIMIT 10")
def closest_to_text(spark, d):
    whole = documents(spark, d)
    names = whole.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"))
    return engine.Engine(whole).closest("With THAT, (ing) 12 estion!", 10, names)


@query(f"""SELECT 'documents' AS mode, doc_id FROM ({A} INTERSECT {B}) UNION ALL SELECT 'matrix', doc_id FROM ({A} INTERSECT {B})
UNION ALL SELECT 'positional', doc_id FROM (SELECT DISTINCT doc_id FROM ({near_sql(OF, THE, 0, 1)})) UNION ALL SELECT 'pairs', doc_id FROM ({PAIR.format('of', 'the')} EXCEPT {PAIR.format('to', 'the')})
UNION ALL SELECT 'vector', doc_id FROM tok WHERE term = 'with' GROUP BY doc_id""")
def search_modes(spark, d):
    e = engine.Engine(documents(spark, d))
    asked = {"documents": "with & that", "matrix": "with & that", "positional": "of > the", "pairs": "of > the \\ (to > the)"}
    found = [e.search(text, mode).select(F.lit(mode).alias("mode"), "doc_id") for mode, text in asked.items()]
    found.append(e.search("with", "vector").where("sim <> 0").select(F.lit("vector").alias("mode"), "doc_id"))
    return functools.reduce(DataFrame.unionByName, found)


@query("""SELECT doc_id, k.kind, k.text FROM (SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]+', ' ', 'g') AS plain FROM documents) b,
LATERAL (SELECT unnest([{'kind': 'Filename', 'text': 'books'}, {'kind': 'Filename', 'text': doc_id || '.fb2'}, {'kind': 'Title', 'text': coalesce(source, 'none')}, {'kind': 'Authors', 'text': coalesce(lang, 'none')}, {'kind': 'Authors', 'text': 'Lee'}, {'kind': 'Authors', 'text': 'zed'}, {'kind': 'Body', 'text': plain}]) AS k) u
WHERE k.text <> ''""", tok=False)
def book_zones(spark, d):
    return zones.segments(books(spark, d))[0]


def books(spark: SparkSession, d: str) -> DataFrame:
    """The documents as FictionBook files."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]+", " ")
    author = F.concat(F.lit("<author><first-name>"), F.coalesce("lang", F.lit("none")), F.lit("</first-name><last-name>Lee</last-name></author><author><nickname>zed</nickname></author>"))
    xml = F.concat(
        F.lit("<FictionBook><description><title-info>"), author, F.lit("<book-title>"), F.coalesce("source", F.lit("none")), F.lit("</book-title></title-info></description><body><section><title><p>skipped</p></title><section><p>"),
        plain, F.lit("</p></section></section></body></FictionBook>"),
    )
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("books/"), F.col("doc_id").cast("string"), F.lit(".fb2")).alias("name"), xml.alias("text"))


@query("""SELECT 'all' AS read, count(*) AS documents, count(DISTINCT text)::BIGINT AS texts, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, count(*) - 1 AS last_id, 1::BIGINT AS ignored FROM (SELECT coalesce(text, '') AS text FROM documents)
UNION ALL SELECT 'first', least(7, count(*)), 0, 0, least(7, count(*)) - 1, 0 FROM documents""", tok=False)
def files_source(spark, d):
    folder = fresh_folder(spark, "files")
    # a file takes some milliseconds, so all cores write, and each task moves its own to their places
    texts = documents(spark, d).select(F.coalesce("text", F.lit("")).alias("text")).repartition(4 * spark.sparkContext.defaultParallelism)
    texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    files.put(spark, f"{folder}/zz-not-text", b"\xff\xfe no text")
    files.put(spark, f"{folder}/_SUCCESS", None)
    whole, ignored = files.read_documents(spark, folder)
    first, _ = files.read_documents(spark, folder, 7)
    none = F.lit(None)
    rows = whole.select(F.lit("all").alias("read"), "doc_id", "text").unionByName(ignored.select(F.lit("all").alias("read"), none.cast("bigint").alias("doc_id"), none.cast("string").alias("text")))
    rows = rows.unionByName(first.select(F.lit("first").alias("read"), "doc_id", "text"))
    return rows.groupBy("read").agg(
        F.count("doc_id").alias("documents"), F.countDistinct("text").alias("texts"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.max("doc_id").alias("last_id"),
        F.sum(F.col("doc_id").isNull().cast("bigint")).alias("ignored"),
    ).where("read = 'all' or last_id is not null").withColumns({c: F.when(F.col("read") == "all", F.col(c)).otherwise(0) for c in ("texts", "bytes")})


@query(r""", c AS (SELECT doc_id, regexp_extract_all(text, '[^\p{L}]*(?:\p{L}[\p{L}'']*)') AS g FROM documents),
e AS (SELECT doc_id, generate_subscripts(g, 1) AS i, lower(ltrim(regexp_extract(unnest(g), '\p{L}[\p{L}'']*$'))) AS term, octet_length(encode(unnest(g))) AS n FROM c),
o AS (SELECT doc_id, term, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM e)
SELECT term, '{"' || term || '":{' || string_agg('"' || doc_id || '":[' || p || ']', ',' ORDER BY doc_id::VARCHAR) || '}}' AS line FROM (SELECT term, doc_id, string_agg(b::VARCHAR, ',' ORDER BY b) AS p FROM o GROUP BY ALL) GROUP BY term""")
def offset_json(spark, d):
    return formats.json_lines(index.offsets(documents(spark, d)), "offsets").withColumnRenamed("value", "line")


@query("""SELECT 'index' AS section, term AS key, '{"index":{"' || term || '":{' || string_agg('"' || doc_id || '":[' || p || ']', ',' ORDER BY doc_id::VARCHAR) || '}}}' AS value FROM (SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS p FROM tok GROUP BY ALL) GROUP BY term
UNION ALL SELECT 'documents', doc_id::VARCHAR, '{"documents":{"' || doc_id || '":[]}}' FROM uni""")
def positional_json_index(spark, d):
    return formats.json_index_lines(index.positional_of(documents(spark, d)), index.universe(toks(spark, d)))


@query("SELECT '' AS term, doc_id, count(*) AS n FROM tok GROUP BY doc_id UNION ALL SELECT term, doc_id, count(*) FROM tok GROUP BY term, doc_id")
def tf_file_roundtrip(spark, d):
    folder = fresh_folder(spark, "tf-file")
    formats.write_tf(index.frequencies_of(documents(spark, d)), folder)
    lengths, found = formats.read_tf(spark, folder)
    return lengths.select(F.lit("").alias("term"), "doc_id", F.col("len").alias("n")).unionByName(found.select("term", "doc_id", F.col("cnt").alias("n")))


@query("SELECT coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes FROM documents", tok=False)
def corpus_size(spark, d):
    return files.corpus_size(documents(spark, d))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0", tok=False)
def document_lookup(spark, d):
    whole = documents(spark, d)
    return files.lookup(whole, whole.where("doc_id % 100 = 0").select("doc_id"))


@query(ZONES + """ SELECT term, '{"' || term || '":[' || string_agg('{"document":' || doc_id || ',"segment_kind":"' || kind || '"}', ',' ORDER BY doc_id, kind) || ']}' AS line FROM z GROUP BY term""", tok=False)
def zone_json(spark, d):
    return formats.zone_json_lines(zones.zone_postings(page_zones(spark, d))).withColumnRenamed("value", "line")


@query("""SELECT term, '{"' || term || '":{' || string_agg('"' || doc_id || '":[' || p || ']', ',' ORDER BY doc_id::VARCHAR) || '}}' AS line FROM (SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS p FROM tok GROUP BY ALL) GROUP BY term""")
def positional_json(spark, d):
    return formats.json_lines(index.positional_of(documents(spark, d)), "pos").withColumnRenamed("value", "line")


@query(""", p AS (SELECT doc_id, term || '_' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM tok) SELECT pair, '{"' || pair || '":[' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || ']}' AS line FROM (SELECT DISTINCT * FROM p WHERE pair IS NOT NULL) GROUP BY pair""")
def bigram_json(spark, d):
    return formats.bigram_json_lines(index.bigrams(documents(spark, d))).withColumnRenamed("value", "line")
