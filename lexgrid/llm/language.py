"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample text.  A
text is lower-cased and encoded against every dictionary, in short blocks, and the language of
the smallest total wins.  A margin below `margin` marks the prediction as not
accepted; the prediction is still given.  A text that is null or has no letter
is `und` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import table

#: Documented bounds of the sample that dictionaries are made of.
SAMPLE_DOCUMENTS = 400  # for each language, about
DICTIONARY_BYTES = 64 << 10
MOST_LANGUAGES = 500
BLOCK = 4096  # characters encoded at once
LEVEL = 6
MARGIN = 0.02


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary per language from about SAMPLE_DOCUMENTS documents each, chosen by a hash of the key.

    The rate of each language comes from a count over all labelled rows, so the
    sample has a bounded expected size at any scale; each sampled document
    gives an excerpt out of its middle, as long as fills the dictionary.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(span, span * SAMPLE_DOCUMENTS // n + 1))])
    place = F.pmod(F.xxhash64(F.lit("language sample"), key, text), F.lit(span))
    length = 2 * DICTIONARY_BYTES // SAMPLE_DOCUMENTS
    excerpt = F.expr(f"substring({text}, greatest(1, cast(length({text}) / 2 as int) - {length // 2}), {length})")
    picked = labelled.where(place < F.try_element_at(share, lang)).select(F.col(lang).alias("lang"), place.alias("place"), excerpt.alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.place, r.text)):
        texts.setdefault(r.lang, []).append(r.text.lower().encode())
    return {k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in texts.items()}


class Compressors:
    def __init__(self, content: dict[str, bytes]) -> None:
        self.langs = sorted(content)
        self.each = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(content[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        text = text.lower()
        blocks = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.each]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=sum(map(len, blocks)))
        margin = max(0.0, 1 - sizes[best] / second) if second else 0.0
        return self.langs[best], margin, margin >= MARGIN


def identified(documents: DataFrame, content: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns plus lang_pred, score (the margin, 0 to 1) and accepted."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(content)  # DICTIONARY_BYTES for each of MOST_LANGUAGES at most
    schema = ", ".join([*(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(sent.value)
        for batch in batches:
            found = [compressors.predict(t.as_py()) for t in batch.column(text)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[*keep, "lang_pred", "score", "accepted"])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """True for a quarter of the documents; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    content = dictionaries(documents.where(~held_out()))
    found = identified(documents.select("doc_id", "text"), content)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op2_language": op2_language}
SQL: dict[str, str] = {}
