"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and verdict is a built-in expression over the row's own text, so
the operator reads each text once and never shuffles.  A null text counts as
empty: it has no words and fails the base rule.  Rows are kept as they come,
repeated rows and null ids included.  Other columns are left alone, whatever
their names in passing(); in measured() and judged() a column named like one
of theirs (_m, _base_failed, _failed) gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import table

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the and of to in a is that it for was on with as at by be are this from or "
    "de la le les et un une des en que qui dans du pour pas sur au avec il elle est "
    "el los las y del se un una por con no su para es lo al "
    "der die das und in den von zu mit ist im nicht ein eine als auch auf für dem"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes while least <= numerator / denominator <= most; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    least: float = float("-inf")
    most: float = float("inf")

    def failed(self) -> Column:
        ratio = F.try_divide(F.col(self.numerator).cast("double"), F.col(self.denominator).cast("double"))
        return F.coalesce((ratio < F.lit(self.least)) | (ratio > F.lit(self.most)), F.lit(False))


#: The production thresholds, over the measures of `measured`.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.06),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.6),
    Rule("shouting", "n_upper", "n_letters", most=0.5),
)


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with a struct column _m of all measures (longs).

    Three-word windows are compared by a 64-bit hash: the window's hash and
    position are sorted, and a window repeats if a neighbour has its hash.
    """
    names = [c for c in documents.columns if c not in ("_m", "_base_failed", "_failed")]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    step = documents.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), 1))
    n = F.size("_w")
    hashed = F.transform(
        F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)).alias("h"), i.alias("at")),
    )
    step = step.withColumn("_s", F.sort_array(hashed))
    none = F.lit(None).cast("struct<h:bigint,at:int>")
    later = F.concat(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.array(none))
    earlier = F.concat(F.array(none), F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))))
    step = step.withColumn("_n", F.zip_with("_s", later, lambda a, b: F.when(a["h"] == b["h"], a["at"])))
    step = step.withColumn("_p", F.zip_with("_s", earlier, lambda a, b: F.when(a["h"] == b["h"], a["at"])))
    starts = F.sort_array(F.filter(F.zip_with("_n", "_p", lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()))
    step = step.withColumn("_a", starts)
    gaps = F.zip_with(
        F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0))),
        F.slice("_a", 1, F.greatest(F.size("_a") - 1, F.lit(0))),
        lambda b, a: F.least(b - a, F.lit(3)),
    )
    repeated = F.when(F.size("_a") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    step = step.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    letters = F.regexp_replace("_t", r"[^\p{L}]+", "")
    stops = [w for w in dict.fromkeys(STOP_WORDS)]
    measures = {
        "n_words": n,
        "word_chars": F.length(F.translate("_t", SEPARATORS, "")),
        "n_symbols": F.length("_t") - F.length(F.translate("_t", SYMBOLS, "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeated,
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(stops))),
        "n_letters": F.length(letters),
        "n_upper": F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")),
    }
    step = step.withColumn("_m", F.struct(*[e.cast("long").alias(k) for k, e in measures.items()]))
    return step.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "_m")


def judged(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with _m, _base_failed and _failed (names of the failed rules; empty for a kept document)."""
    step = measured(documents, text)
    m = lambda k: F.col(f"_m.{k}")
    base = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    own = [F.when(Rule(r.name, f"_m.{r.numerator}", f"_m.{r.denominator}", r.least, r.most).failed(), F.lit(r.name)) for r in rules]
    names = F.array_compact(F.array(F.when(F.col("_base_failed"), F.lit("base")), *own)) if rules else F.array_compact(F.array(F.when(F.col("_base_failed"), F.lit("base"))))
    return step.withColumn("_base_failed", base).withColumn("_failed", names)


def passing(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns only, whatever their names."""
    names = documents.columns
    inner = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    # the row number keeps the filter above the projection: pushed below, it would repeat every measure's expression
    found = judged(inner, f"c{names.index(text)}").withColumn("_row", F.monotonically_increasing_id())
    return found.where((F.size("_failed") == 0) & (F.col("_row") >= 0)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", *[F.col(f"_m.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"), (F.size("_failed") == 0).alias("kept"),
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

MEASURES_SQL = rf"""
t AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM d) GROUP BY r),
l AS (SELECT r, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.r, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda s: length(s))), 0) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l.l) AS n_lines,
    len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w.w, lambda s: lower(s) IN ({_STOP_SQL}))) AS n_stop_words,
    length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM w JOIN l USING (r) LEFT JOIN p USING (r)),
j AS (SELECT t.*, m.* EXCLUDE (r), m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words AS base_failed,
    {" OR ".join(f"coalesce({r.numerator} / nullif({r.denominator}, 0) < {r.least!r}, false)" for r in RULES if r.least > float("-inf"))} OR
    {" OR ".join(f"coalesce({r.numerator} / nullif({r.denominator}, 0) > {r.most!r}, false)" for r in RULES if r.most < float("inf"))} AS rule_failed
  FROM t JOIN m USING (r))"""

SQL = {
    "op6_quality_rules": f"""WITH {MEASURES_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR rule_failed) AS kept FROM j"""
}
QUERIES = {"op6_quality_rules": op6_quality_rules}
