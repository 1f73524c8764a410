"""Whole queries against plain Python versions of them."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from lexgrid.llm import decontamination, jaccard_join, language, line_dedup, quality_classifier, quality_rules
from tests.llm.test_operators import EDGE, components, folded, shingles, write

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, rows, path):
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    return str(path)


# language -------------------------------------------------------------------------------------------------------------


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_language(rows):
    """op2 with one compressor call for each text and language, and no sampling (below the sample's bound)."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    length = 2 * language.DICTIONARY_BYTES // language.SAMPLE_DOCUMENTS
    sample = collections.defaultdict(list)
    for i, t, g in rows:
        if not held[i] and t is not None and g is not None:
            at = max(1, len(t) // 2 - length // 2) - 1
            key = ("language sample", t) if i is None else ("language sample", i, t)
            sample[g].append((spark_hash(*key) % (1 << 30), t[at : at + length]))
    content = {g: b"\n".join(t.lower().encode() for _, t in sorted(v))[: language.DICTIONARY_BYTES] for g, v in sample.items()}
    out = []
    for i, t, _ in rows:
        best, score = "und", 0.0
        if t and any(map(str.isalpha, t)) and content:
            sizes = {}
            for g in sorted(content):
                d = zstandard.ZstdCompressionDict(content[g], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                low = t.lower()
                sizes[g] = sum(len(c.compress(low[k : k + language.BLOCK].encode())) for k in range(0, len(low), language.BLOCK))
            (a, best), *rest = sorted((n, g) for g, n in sizes.items())
            second = rest[0][0] if rest else len(t.lower().encode())
            score = max(0.0, 1 - a / second)
        out.append((i, held[i], best, score))
    return out


def test_language_by_plain_compressors(spark, tmp_path, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs if len(r.text or "") < 4000][:90]
    rows += [(10_000 + k, t, None) for k, t in enumerate([None, "", " \n", "123 45", "é", "x" * 9000])] + [(None, "the cat and the dog", None), rows[0]]
    got = language.op2_language(spark, written(spark, rows, tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.held_out, r.lang_pred, r.score) for r in got))) == sorted(map(repr, plain_language(rows)))


# decontamination ------------------------------------------------------------------------------------------------------


def plain_fold(t):
    return " ".join((t or "").lower().split())


def best_match(item, text):
    """Least edit distance of item to any part of text, by the full table."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    at = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (at != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def plain_leaks(rows, items):
    out = []
    for (i, t), (k, x) in itertools.product(rows, items):
        text, item = plain_fold(t), plain_fold(x)
        if not item or not text:
            continue
        if len(item) < 24:
            if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])" if item[0].isalnum() and item[-1].isalnum() else re.escape(item), text):
                out.append((i, k, 0))
        elif (d := best_match(item, text)) <= int(0.05 * len(item)):
            out.append((i, k, d))
    return out


def test_decontamination_by_distance_to_every_item(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(4, 40)))) for k in range(14)] + [(20, None), (21, ""), (22, "tiny one"), (22, "tiny one"), (None, "an item without an id but long")]

    def cut(t, n):
        t = list(t)
        for _ in range(n):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["#"], [t[at], "q"]])
        return "".join(t)

    rows = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    for i in range(40, 120):
        k, x = items[rng.randrange(14)]
        rows.append((i, f"{word()} {cut(x, rng.randrange(2 + len(x) // 12)).upper()}\n {word()}"))
    rows += [(200, None), (201, ""), (202, "a Tiny  ONE"), (202, "a Tiny  ONE"), (None, "an item without an id but lon")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id, r.distance) for r in decontamination.op3_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_leaks(rows, items)))
    assert len({d for *_, d in got}) > 3


# quality classifier ---------------------------------------------------------------------------------------------------


def plain_features(text):
    text = text or ""
    words = set()
    now = ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.add(now)
            now = ""
    n, split = max(1, len(text.split())), text.split()
    count = lambda chars: sum(c in chars for c in text)
    shape = {
        "size": int(math.log2(len(split) + 1)), "symbols": int(8 * min(1.0, count("#*$%&|<>") / n)), "pipes": int(8 * min(1.0, count("|") / n)), "bangs": int(8 * min(1.0, count("!") / n)),
        "upper": int(8 * sum(w.isupper() for w in split) / n), "distinct": int(8 * len(words) / n), "stops": int(20 * min(1.0, count(".,") / n)), "length": min(12, max(1, len(text)) // n),
    }
    return {zlib.crc32(w.encode()) for w in words} | {zlib.crc32(f"#{k}={v}".encode()) for k, v in shape.items()}


def loss(model, rows):
    """Penalised mean negative log likelihood, one document at a time."""
    total = 0.0
    for grade, found in rows:
        score = sum(model.weights.get(int(f), 0.0) for f in found)
        tail = [1.0, *(1 / (1 + math.exp(t - score)) for t in model.thresholds), 0.0]
        total -= math.log(max(1e-9, tail[grade] - tail[grade + 1]))
    return total / len(rows) + quality_classifier.PENALTY / 2 * sum(w * w for w in model.weights.values())


def test_quality_classifier_is_near_a_minimum():
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        grade = rng.randrange(3)
        rows.append((grade, np.array(sorted({rng.randrange(10 * grade, 10 * grade + 20) for _ in range(6)}))))
    model = quality_classifier.fit(rows)
    assert model.thresholds == sorted(model.thresholds)
    at = loss(model, rows)
    h = 1e-4
    for f in [*model.weights][:12]:
        up, down = (loss(quality_classifier.Ordinal({**model.weights, f: model.weights[f] + s}, model.thresholds), rows) for s in (h, -h))
        assert abs(up - down) / (2 * h) < 5e-3
    for k in range(2):
        moved = [[t + s * (i == k) for i, t in enumerate(model.thresholds)] for s in (h, -h)]
        up, down = (loss(quality_classifier.Ordinal(model.weights, m), rows) for m in moved)
        assert abs(up - down) / (2 * h) < 5e-3
    assert at < loss(quality_classifier.Ordinal({}, model.thresholds), rows)


def test_quality_classifier_by_plain_scoring(spark, tmp_path, small_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    docs += [(i, t, None) for i, t in EDGE if i is None or i > 13]
    graded = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()]
    graded += [(None, 1, 0), (5, None, None), (10**9, 0, 1)]
    folder = written(spark, docs, tmp_path)
    spark.createDataFrame(graded, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    grade = lambda q, x: 0 if x == 1 else 1 if q == 0 else 2 if (q, x) == (1, 0) else None
    rows = [(g, np.array(sorted(plain_features(t)))) for i, t, _ in docs for k, q, x in graded if i is not None and i == k and (g := grade(q, x)) is not None]
    model = quality_classifier.fit(rows)
    got = quality_classifier.op7_quality_classifier(spark, folder).collect()
    want = []
    for i, t, _ in docs:
        score = sum(model.weights.get(f, 0.0) for f in plain_features(t))
        tails = [1 / (1 + math.exp(min(700.0, t - score))) for t in model.thresholds]
        want.append((-1 if i is None else i, round(sum(tails), 6), round(tails[0], 6), round(tails[1], 6), tails[1] >= quality_classifier.SELECT))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.expected_grade, 6), round(r.p_low, 6), round(r.p_good, 6), r.selected) for r in got) == sorted(want)


@pytest.mark.parametrize("docs, labels", [([], []), ([], [(1, 1, 0)]), ([(1, "a b", "en")], []), ([(1, None, None), (1, None, None)], [(1, 1, 0)])])
def test_quality_classifier_of_little(spark, tmp_path, docs, labels):
    folder = written(spark, docs, tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_classifier.op7_quality_classifier(spark, folder).collect()
    assert len(got) == len(docs) and all(0 <= r.p_good <= r.p_low <= 1 for r in got)


# values of edge cases -------------------------------------------------------------------------------------------------


def test_edge_values(spark, tmp_path):
    folder = write(spark, EDGE, tmp_path)
    texts = [t for _, t in EDGE]
    roots = components([shingles(t) for t in texts])
    least = lambda i: min((EDGE[j][0] for j in range(len(EDGE)) if roots[j] == roots[i] and EDGE[j][0] is not None), default=None)
    want = [(EDGE[i][0], len(shingles(t)), least(i) if shingles(t) else EDGE[i][0]) for i, t in enumerate(texts)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op4_jaccard_join(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    got = line_dedup.op10_line_dedup(spark, folder).collect()
    lines = {i: sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")) for i, t in EDGE if i not in (None, 5, 6)}
    assert {r.doc_id: r.n_lines for r in got if r.doc_id not in (None, 5, 6)} == lines
    kept = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, ""), (2, ""), (3, " \n\t "), (4, "one"), (5, ""), (6, dict(EDGE)[6]), (8, ""), (13, "l1 aaa\nl2 bbb\n\n"))}
    assert {r.doc_id: r.kept_sha256 for r in got if r.doc_id in kept} == kept


# clashing names -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("stage", [quality_rules.passing, line_dedup.deduplicated, jaccard_join.deduplicated])
def test_stages_keep_columns_of_any_name(spark, stage):
    names = ["_t", "_w", "_m", "_row", "_rid", "_doc", "_removed", "_base_failed", "_failed", "c0", "rid", "doc", "removed", "regions", "n", "_key", "_clash_id", "line", "component"]
    text = "The cat and the dog of the house were in the garden with all of the birds that are in it. " * 4
    docs = spark.createDataFrame([(i, text + " ".join(f"own{i}{k} of the" for k in range(40)), *[7] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == 7 for r in rows for n in names)


# pipeline -------------------------------------------------------------------------------------------------------------


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 50:
        return False
    three = collections.defaultdict(list)
    for k in range(len(words) - 2):
        three[tuple(words[k : k + 3])].append(k)
    repeated = {k + j for at in three.values() if len(at) > 1 for k in at for j in range(3)}
    if 100 * len(repeated) > 50 * len(words):
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() and c.lower() != c for c in letters)
    n = len(words)
    return (
        2 <= sum(map(len, words)) / n <= 14 and sum(c in "#*$%&|<>" for c in text) / n <= 0.1 and sum(w.lower() in quality_rules.STOP_WORDS for w in words) / n >= 0.06
        and (len(lines) - len({*lines})) / max(1, len(lines)) <= 0.6 and (not letters or upper / len(letters) <= 0.5)
    )


def plain_lines(rows):
    places = [(i, k, folded(x)) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    distinct = [*dict.fromkeys(x for *_, x in places)]
    n = line_dedup.SHINGLE
    roots = dict(zip(distinct, components([{x[a : a + n] for a in range(max(1, len(x) - n + 1))} for x in distinct])))
    seen, gone = set(), collections.defaultdict(set)
    for i, k, x in places:
        if roots[x] in seen:
            gone[i].add(k)
        seen.add(roots[x])
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows]


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    first, out = set(), []
    for row, s, root in zip(rows, sets, components(sets)):
        if not s or root not in first:
            out.append(row)
        if s:
            first.add(root)
    return out


def plain_clean(rows, items):
    kept = []
    for i, t in rows:
        text = plain_fold(t)
        for x in items:
            item = plain_fold(x)
            budget = int(0.05 * len(item))
            cuts = [len(item) * p // (budget + 1) for p in range(budget + 2)]
            # a text without any piece has more edits than the budget; only others need the table
            if item and any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) and best_match(item, text) <= budget:
                break
        else:
            kept.append((i, t))
    return kept


def test_pipeline_by_plain_versions(spark, small_dir):
    import corpus_pipeline

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    items = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    assert all(len(plain_fold(x)) >= 24 for x in items)
    rows = plain_clean(plain_groups(plain_lines([r for r in rows if plain_rules(r[1])])), items)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, small_dir).collect()} == want


def test_pipeline_of_edge_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    good = "The cat and the dog of the house were in the garden with the birds that are in it"
    own = lambda k: " ".join(f"{w}{k} of the" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split())
    rows = [(1, own(1)), (1, own(2)), (None, own(3)), (None, own(4)), (2, None), (3, ""), (4, good), (5, own(1)), (6, own(5)), (6, own(5))]
    for k, part in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9) for i, t in part], DOCUMENTS + ", _rid int").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, own(4)), (2, None)] if part else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
        # 5 is blank after line dedup, 1 and 2 of the same id both stay, one of 6 goes, 4 and the short and empty ones fail the rules
        assert got == (collections.Counter({1: 2, None: 1, 5: 1, 6: 1}) if part else {})
