"""Zones of structured documents and zone-weighted ranking."""

from __future__ import annotations

import xml.etree.ElementTree as Tree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lexgrid.functions import text as T

#: The weight of each zone.
WEIGHTS = {"Filename": 0.2, "Authors": 0.1, "Title": 0.4, "Epigraph": 0.1, "Body": 0.2}
_BOOK = "/FictionBook/description/title-info"
_NAMES = "*[self::first-name or self::last-name or self::middle-name or self::nickname]/text()"


def strip_breaks(text: Column | str) -> Column:
    return F.regexp_replace(text, r"<br\s*/?>", " ")


@F.pandas_udf(BooleanType())
def well_formed(text: pd.Series) -> pd.Series:
    """Whether a text is XML: xpath would end the job on one that is not."""

    def ok(x: str | None) -> bool:
        try:
            Tree.fromstring(x or "")
        except (Tree.ParseError, ValueError):
            return False
        return True

    return text.map(ok)


def _listed(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))


def segments(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, quarantined documents) of doc_id, name and text.

    Segments have doc_id, kind and text.  Names ending in .fb2 are read as
    XML, all others as plain text; every part of the name is a Filename.
    """
    book = F.col("name").endswith(".fb2")
    ok = ~book | well_formed("text")
    path = lambda p: F.xpath("text", F.lit(p))
    authors = F.concat(path(f"{_BOOK}/author[first-name and last-name]/{_NAMES}"), path(f"{_BOOK}/author[not(first-name and last-name)]/nickname/text()"))
    xml = F.concat(_listed("Title", path(f"{_BOOK}/book-title/text()")), _listed("Authors", authors), _listed("Body", path("/FictionBook/body//section/p/text()")))
    plain = F.array(F.struct(F.lit("Body").alias("kind"), F.col("text").alias("text")))
    kinds = "array<struct<kind:string,text:string>>"
    name = _listed("Filename", F.filter(F.split("name", "/"), lambda p: p != ""))
    checked = documents.withColumn("_ok", ok)
    good = checked.where("_ok").select("doc_id", F.explode(F.concat(name.cast(kinds), F.when(book, xml.cast(kinds)).otherwise(plain.cast(kinds)))).alias("s"))
    return good.select("doc_id", "s.kind", "s.text"), checked.where("not _ok").drop("_ok")


def page_segments(pages: DataFrame) -> DataFrame:
    """Segments of web pages (page_id, url, html): HTML is not XML, so zones are cut by patterns."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    article = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_replace(F.regexp_replace(article, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " ")
    parts = F.filter(F.split("url", "/"), lambda p: p != "")
    zones = F.concat(_listed("Title", F.array(title)), _listed("Body", F.array(body)), _listed("Filename", F.coalesce(parts, F.array().cast("array<string>"))))
    return pages.select(F.col("page_id").alias("doc_id"), F.explode(zones).alias("s")).select("doc_id", "s.kind", "s.text")


def zone_postings(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", "kind", F.explode(T.terms("text")).alias("term")).distinct().select("term", "doc_id", "kind")


def weight(kind: Column | str, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for k, w in (weights or WEIGHTS).items():
        out = F.when(F.col(kind) == k, F.lit(w)).otherwise(out)
    return out


def ranked(zone_postings: DataFrame, term: str) -> DataFrame:
    """doc_id, score (sum of the weights of distinct zones) and kinds of documents with the term, best first."""
    found = zone_postings.where(F.col("term") == term).distinct()
    rows = found.groupBy("doc_id").agg(F.round(F.sum(weight("kind")), 4).alias("score"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return rows.orderBy(F.desc("score"), "doc_id")
