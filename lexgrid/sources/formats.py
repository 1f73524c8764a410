"""Text and JSON formats of dictionaries and indexes, for import and export.  Parquet sorted by term is the native store."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a term that share a line.
SEGMENT_DOCUMENTS = 1 << 20


class DictionaryStorage(Protocol):
    def write(self, path: str, dictionary: DataFrame) -> None: ...

    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


class KeyValueStorage:
    """word=count lines; words that repeat are summed, and a line of another form is an error."""

    def write(self, path: str, dictionary: DataFrame) -> None:
        dictionary.select(F.concat_ws("=", "term", F.col("cnt").cast("string"))).write.mode("overwrite").text(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return self.parsed(spark.read.text(path))

    @staticmethod
    def parsed(lines: DataFrame) -> DataFrame:
        part = F.split("value", "=")
        number = F.expr("try_cast(get(split(value, '='), 1) as bigint)")
        ok = (F.size(part) == 2) & number.isNotNull()
        rows = lines.select(F.get(part, 0).alias("term"), F.when(ok, number).otherwise(F.raise_error(F.concat(F.lit("bad dictionary line: "), "value")).cast("bigint")).alias("cnt"))
        return rows.groupBy("term").agg(F.sum("cnt").alias("cnt"))


class JsonStorage:
    """{"word": count}, an object per line: one for each of the parts that words are dealt to."""

    def __init__(self, parts: int = 64) -> None:
        self.parts = parts

    def lines(self, dictionary: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("term"), F.lit(self.parts))
        return dictionary.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "cnt"))))).alias("value")).select("value")

    def write(self, path: str, dictionary: DataFrame) -> None:
        self.lines(dictionary).write.mode("overwrite").text(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return self.parsed(spark.read.text(path))

    @staticmethod
    def parsed(lines: DataFrame) -> DataFrame:
        rows = lines.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("term", "cnt"))
        return rows.groupBy("term").agg(F.sum("cnt").alias("cnt"))


def index_lines(postings: DataFrame) -> DataFrame:
    """term and value: term:id,id,...; a term has a line for each segment of documents, so that no line holds all of a frequent one."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("doc_id")), lambda i: i.cast("string")), ",")
    return postings.groupBy("term", segment()).agg(ids.alias("ids")).select("term", F.concat_ws(":", "term", "ids").alias("value"))


def segment(column: str = "doc_id") -> Column:
    return F.floor(F.col(column) / SEGMENT_DOCUMENTS)


def index_from_lines(lines: DataFrame) -> DataFrame:
    part = F.split("value", ":")
    ids = F.when(F.size(part) == 2, F.split(F.get(part, 1), ",").cast("array<bigint>")).otherwise(F.raise_error(F.lit("bad index line")).cast("array<bigint>"))
    return named(lines, ":").select("term", F.explode(ids).alias("doc_id"))


def named(lines: DataFrame, mark: str) -> DataFrame:
    """Lines with their terms: cut before a line is exploded, as else every row of it would carry and cut the whole line again."""
    return lines.select(F.substring_index("value", mark, 1).alias("term"), "value")


def tf_lines(tf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc:len lines, term|doc:count,... lines), each with its sort key."""
    lengths = tf.groupBy("doc_id").agg(F.sum("cnt").alias("len")).select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("len").cast("string")).alias("value"))
    pair = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("cnt").cast("string"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", pair.alias("p")))), lambda s: s["p"]), ",")
    return lengths, tf.groupBy("term", segment()).agg(listed.alias("docs")).select("term", F.concat_ws("|", "term", "docs").alias("value"))


def tf_from_lines(lines: DataFrame) -> DataFrame:
    """term, doc_id and cnt from the second section."""
    part = F.split("value", r"\|")
    pairs = F.explode(F.split(F.get(part, 1), ",")).alias("p")
    return named(lines, "|").select("term", pairs).select("term", F.split_part("p", F.lit(":"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("p", F.lit(":"), F.lit(2)).cast("bigint").alias("cnt"))


def write_tf(tf: DataFrame, path: str) -> None:
    """Lengths in order of documents, a line #, then terms in their order: the parts of one text folder, in the order of their names."""
    lengths, terms = tf_lines(tf)
    none = F.lit(None)
    parted = tf.sparkSession.range(1).select(F.lit(1).alias("section"), none.cast("bigint").alias("doc_id"), none.cast("string").alias("term"), F.lit("#").alias("value"))
    whole = lengths.select(F.lit(0).alias("section"), "doc_id", none.cast("string").alias("term"), "value").unionByName(parted)
    whole = whole.unionByName(terms.select(F.lit(2).alias("section"), none.cast("bigint").alias("doc_id"), "term", "value"))
    whole.orderBy("section", "doc_id", "term").select("value").write.mode("overwrite").text(path)


def read_tf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id and len, tf): both sections.  Terms hold no digit, colon or bar, so a line tells its section itself."""
    lines = spark.read.text(path)
    lengths = lines.where(F.col("value").rlike("^[0-9]+:[0-9]+$"))
    number = lambda i: F.split_part("value", F.lit(":"), F.lit(i)).cast("bigint")
    return lengths.select(number(1).alias("doc_id"), number(2).alias("len")), tf_from_lines(lines.where(F.col("value").contains("|")))


def json_lines(index: DataFrame, entry: str) -> DataFrame:
    """term and a JSON object {term: {doc: entry}} for each segment of documents; entry is an array column."""
    # entries travel as the text that they become; digits and letters need no escapes
    doc = F.col("doc_id").cast("string")
    text = F.concat(F.lit('"'), doc, F.lit('":['), F.array_join(F.col(entry).cast("array<string>"), ","), F.lit("]"))
    docs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(doc.alias("doc"), text.alias("text")))), lambda s: s["text"]), ",")
    return index.groupBy("term", segment()).agg(docs.alias("docs")).select("term", F.concat(F.lit('{"'), "term", F.lit('":{'), "docs", F.lit("}}")).alias("value"))


def json_index_lines(positional: DataFrame, universe: DataFrame) -> DataFrame:
    """The positional index in JSON, section, key and value: {"documents": {doc: []}} for each document, {"index": {term: {doc: [pos]}}} for each term."""
    document = F.col("doc_id").cast("string")
    documents = universe.select(F.lit("documents").alias("section"), document.alias("key"), F.concat(F.lit('{"documents":{"'), document, F.lit('":[]}}')).alias("value"))
    terms = json_lines(positional, "pos").select(F.lit("index").alias("section"), F.col("term").alias("key"), F.concat(F.lit('{"index":'), "value", F.lit("}")).alias("value"))
    return documents.unionByName(terms)


def zone_json_lines(zone_postings: DataFrame) -> DataFrame:
    each = F.sort_array(F.collect_set(F.struct(F.col("doc_id").alias("document"), F.col("kind").alias("segment_kind"))))
    return zone_postings.groupBy("term").agg(each.alias("e")).select("term", F.to_json(F.create_map("term", "e")).alias("value"))


def bigram_json_lines(bigrams: DataFrame) -> DataFrame:
    each = bigrams.groupBy(F.concat_ws("_", "w1", "w2").alias("pair")).agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    return each.select("pair", F.to_json(F.create_map("pair", "docs")).alias("value"))


def size_on_disk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length").alias("bytes"))


def store(index: DataFrame, path: str) -> None:
    """Parquet in order of terms, so that a filter on terms reads few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)
