"""Personal data by weak supervision, in built-in expressions only.

Base spans of four kinds come from fixed patterns and checks.  The method adds
spans: looser candidates get votes of regex, gazetteer and context labelers
(+1, -1, 0 to abstain); expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability and a probability for every
pattern; and a logistic span classifier is trained on these probabilities.
Candidates that it accepts join the base spans, which always stay.

Looser candidates are looked for in the text without the base spans, so they
never overlap one of their kind.  The classifier sees features of the span
itself beside the votes: its length, its share of digits, how many characters
it has that differ, and what stands before it.

Vote patterns are counted over all documents by a pre-aggregated group-by; the
driver gets one row per pattern, at most KINDS x 3^labelers x the product of
FEATURES' sizes, some hundreds in practice.  Texts are scanned once: candidates
without texts are written to the shared folder, and both training and the
verdicts read them from there.

Positions are running sums made in blocks of matches, so a text of n matches
costs n^1.5 small steps at most.

A null text is empty and has no spans.  Rows are kept one by one, null ids and
repeated rows included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import staged, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns in forms that match the same spans in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # runs of fewer than 12 digits fail the check and are passed over; a run starts at a digit that no earlier one of it precedes
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates, beside base matches that fail their checks.
LOOSE = {
    "card": r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_-])(?:[A-Za-z]{2,6}[_-]){0,2}(?=[A-Za-z]{0,40}[0-9])[0-9A-Za-z]{24,64}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
GUARD = {"email": "@", "phone": r"\+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "secret": r"[0-9A-Za-z]{24}"}
#: First characters of tokens that services hand out.
TOKEN_PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ ghu_ ghr_ glpat- xoxa- xoxb- xoxp- xoxr- sk_live_ sk_test_ pk_live_ pk_test_ sk- rk_live_ npm_ pypi- dop_v1_ shpat_ hf_ SG- key- eyJ".split()
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TOP_DOMAINS = "com org net edu gov mil int info biz io ai co uk de fr es it nl eu us ca au ch at be pl ru jp cn br in mx".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mail|correo|courriel|adresse)\W{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|from|client)\W{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|tarjeta|carte|karte|account|iban)\W{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|teléfono|téléphone|telefon)\W{0,12}$",
    "secret": r"(?i)(?:token|secret|api|key|password|passwd|pwd|auth|bearer)\W{0,6}$",
}
LABELERS = ("regex", "gazetteer", "context", "edges", "shape")
#: Sizes of the span features: length in eights, share of digits in quarters, differing characters in fours, kind of the character before.
FEATURES = (8, 5, 6, 5)
BLOCK = 64
BEFORE = 32
EM_STEPS, FIT_STEPS, FIT_RATE = 60, 400, 0.5
ACCEPT = 0.5


_MATCH = "struct<gap:int,text:string,before:string,after:string>"
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def matches(text: str, pattern: str, guard: str) -> Column:
    """Array of (gap, text, before, after) of a pattern's leftmost matches: code points since the last one, and what stands around."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    n = F.size(match)
    each = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), n), match, lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("before"), m.alias("text"))),
        F.slice(gaps, F.lit(2), n),
        lambda x, after: F.struct(x["gap"].alias("gap"), x["text"].alias("text"), x["before"].alias("before"), F.left(after, F.lit(1)).alias("after")),
    )
    return F.when(F.col(text).rlike(guard), each).otherwise(F.array().cast(f"array<{_MATCH}>"))


def placed(each: str) -> Column:
    """Matches as an array of (start, end, text, before, after), in code points.

    Starts are running sums.  Spark has none for arrays, and a fold that appends
    copies its array at each step; so sums run within blocks of matches as long
    as there are blocks, and over the blocks.
    """
    n = F.size(each)
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.when(n > 0, F.sequence(F.lit(1), n, size)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(each, i, size))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["text"])
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    inner = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add))

    def shift(state: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((state["at"] + b["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(inner, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), shift)["out"])


def masked(text: str, pattern: str, each: str, kind: str) -> Column:
    """The text with its base spans overwritten, at their length."""
    gaps = F.split(F.col(text), pattern, -1)
    filled = F.transform(F.transform(each, lambda x: x["text"]), lambda m: F.when(valid(kind, m), F.repeat(F.lit("\x00"), F.length(m))).otherwise(m))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(each)), filled, lambda g, m: F.concat(g, m))
    return F.when(F.size(each) > 0, F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))).otherwise(F.col(text))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(text: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check."""
    d = digits(text)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def valid(kind: str, text: Column) -> Column:
    """The base check of a kind."""
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def votes(kind: str, x: Column) -> Column:
    """One vote of each of LABELERS on a candidate."""
    text, before, after = x["text"], x["before"], x["after"]
    yes, no, skip = F.lit(1), F.lit(-1), F.lit(0)
    listed = {
        "email": F.element_at(F.split(F.lower(text), r"\."), -1).isin(TOP_DOMAINS),
        "ip": ~text.rlike(r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."),
        "card": text.rlike("^[3-6]"),
        "phone": F.expr("false"),
        "secret": text.rlike("^(?:" + "|".join(TOKEN_PREFIXES) + ")"),
    }[kind]
    if kind == "phone":
        code = F.regexp_extract(text, r"^\+([0-9]{1,3})", 1)
        listed = code.isin(CALLING_CODES) | F.left(code, F.lit(2)).isin(CALLING_CODES) | F.left(code, F.lit(1)).isin(CALLING_CODES)
    shape = {
        "email": text.rlike(r"^[^@]{1,64}@[^@]{3,}\.[A-Za-z]{2,}$"),
        "ip": F.length(text).between(7, 15),
        "card": F.length(digits(text)).isin(13, 15, 16),
        "phone": text.rlike(r"[0-9]{4}$"),
        "secret": text.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    }[kind]
    strict = valid(kind, text) if kind != "secret" else text.rlike("[0-9].*[0-9].*[0-9]")
    edge = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    return F.array(
        F.when(strict, yes).otherwise(no), F.when(listed, yes).otherwise(no if kind != "secret" else skip),
        F.when(before.rlike(CUES[kind]), yes).otherwise(skip), F.when(edge, no).otherwise(yes), F.when(shape, yes).otherwise(no),
    )


def features(x: Column) -> Column:
    """The places of a candidate in the classes of FEATURES."""
    text, before = x["text"], x["before"]
    n = F.length(text)
    differ = F.size(F.array_distinct(F.split(F.left(text, F.lit(64)), "")))
    prior = F.when(before == "", 0).when(before.rlike(r"[\s]$"), 1).when(before.rlike(r"[:=\"'(\[<]$"), 2).when(before.rlike(r"[\p{L}0-9]$"), 3).otherwise(4)
    classes = (n / 8, 4 * F.length(digits(text)) / n, differ / 4, prior)
    return F.array(*[F.least(c, F.lit(size - 1)).cast("int") for c, size in zip(classes, FEATURES)])


def candidates(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep plus _c: array of (start, kind, end, base, votes, features), kind being its place in KINDS."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    step = documents.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = []
    for k, kind in enumerate(KINDS):
        source = "t"
        for patterns, name in ((BASE, f"base_{kind}"), (LOOSE, f"loose_{kind}")):
            if kind not in patterns:
                continue
            step = step.withColumn(f"{name}_m", matches(source, patterns[kind], GUARD[kind])).withColumn(name, placed(f"{name}_m"))
            if patterns is BASE and kind in LOOSE:
                source = f"left_{kind}"
                step = step.withColumn(source, masked("t", BASE[kind], f"{name}_m", kind))

            def candidate(x: Column) -> Column:
                return F.struct(
                    x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), (valid(kind, x["text"]) if patterns is BASE else F.lit(False)).alias("base"),
                    votes(kind, x).alias("votes"), features(x).alias("features"),
                )

            parts.append(F.transform(name, candidate))
    return step.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.concat(*parts).alias("_c"))


#: (kind, votes, features, number of candidates)
Patterns = list[tuple[int, tuple[int, ...], tuple[int, ...], int]]


def estimated(patterns: Patterns) -> dict[tuple[int, tuple[int, ...]], float]:
    """P(personal) of each (kind, votes), by expectation-maximisation with one reliability per kind and labeler.

    Reliabilities start at 0.8 and have a prior of two right votes in three
    that keeps a labeler's vote from turning around on few candidates.
    """
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        counts: dict[tuple[int, ...], int] = {}
        for k, v, _, n in patterns:
            if k == kind:
                counts[v] = counts.get(v, 0) + n
        right, share = [0.8] * len(LABELERS), 0.5
        belief: dict[tuple[int, ...], float] = {}
        for _ in range(EM_STEPS):
            for v in counts:
                a, b = math.log(share), math.log(1 - share)
                for r, x in zip(right, v):
                    if x:
                        a, b = a + math.log(r if x > 0 else 1 - r), b + math.log(1 - r if x > 0 else r)
                belief[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
            total = sum(counts.values())
            share = min(0.99, max(0.01, (sum(n * belief[v] for v, n in counts.items()) + 1) / (total + 2)))
            for i in range(len(LABELERS)):
                good = sum(n * (belief[v] if v[i] > 0 else 1 - belief[v]) for v, n in counts.items() if v[i])
                cast = sum(n for v, n in counts.items() if v[i])
                right[i] = min(0.99, max(0.05, (good + 20) / (cast + 30)))
        out |= {(kind, v): p for v, p in belief.items()}
    return out


def inputs(votes: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    """A bias, each vote, and a 1 at the class of each feature."""
    return [1.0, *map(float, votes), *(1.0 if place == f else 0.0 for f, size in zip(features, FEATURES) for place in range(size))]


def classifier(patterns: Patterns, belief: dict[tuple[int, tuple[int, ...]], float]) -> list[list[float]]:
    """Per kind: weights of `inputs`, fitted to the soft labels."""
    weights = [[0.0] * (1 + len(LABELERS) + sum(FEATURES)) for _ in KINDS]
    for kind, w in enumerate(weights):
        rows = [(inputs(v, f), belief[k, v], n) for k, v, f, n in patterns if k == kind]
        total = sum(n for *_, n in rows)
        used = [i for i in range(len(w)) if any(x[i] for x, *_ in rows)]
        rows = [([x[i] for i in used], p, n / total) for x, p, n in rows]
        found = [0.0] * len(used)
        for _ in range(FIT_STEPS if rows else 0):
            slope = [1e-3 * x for x in found]
            for x, p, share in rows:
                z = sum(a * b for a, b in zip(found, x))
                e = (1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) - p) * share
                slope = [s + e * a for s, a in zip(slope, x)]
            found = [a - FIT_RATE * s for a, s in zip(found, slope)]
        for i, a in zip(used, found):
            w[i] = a
    return weights


def accepted(c: Column, weights: list[list[float]]) -> Column:
    """Whether the classifier takes a candidate."""
    def score(w: list[float]) -> Column:
        z = F.lit(w[0])
        for i in range(len(LABELERS)):
            z = z + F.lit(w[1 + i]) * F.get(c["votes"], i)
        at = 1 + len(LABELERS)
        for i, size in enumerate(FEATURES):
            z = z + F.get(F.array(*map(F.lit, w[at : at + size])), F.get(c["features"], i))
            at += size
        return z

    z = F.lit(None).cast("double")
    for kind, w in enumerate(weights):
        z = F.when(c["kind"] == kind, score(w)).otherwise(z)
    return z >= math.log(ACCEPT / (1 - ACCEPT))


def spans(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep plus _base and _spans: arrays of (start, kind, end) in order, of base spans and of all spans."""
    got = staged(candidates(documents, keep, text), "pii")
    counted = got.select(F.explode("_c").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    patterns = [(r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in sorted(counted.collect())]
    weights = classifier(patterns, estimated(patterns))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.sort_array(F.transform(F.filter("_c", lambda c: c["base"]), span))
    every = F.sort_array(F.array_distinct(F.transform(F.filter("_c", lambda c: c["base"] | accepted(c, weights)), span)))
    return got.select(*keep, base.alias("_base"), every.alias("_spans"))


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return got.select("doc_id", *counts, F.sha2(written("_base").cast("binary"), 256).alias("base_sha256"), written("_spans").alias("spans"), F.size("_spans").cast("long").alias("n_spans"))


QUERIES = {"op8_pii": op8_pii}
SQL: dict[str, str] = {}
