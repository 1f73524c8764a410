"""Base spans against a plain implementation of the fixed patterns."""

import hashlib
import random
import re
import time

from lexgrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            s = m.group()
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: luhn(s), "phone": lambda: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "a@b@c.d.e mail: joe.x+1@mail7.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 0256.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 1 2",
    "é👩 +1 (663) 555-6869 tel +49 30 1234567 +1 2", 'token = "04dbebab91ab856804dbebab91ab8568" x', "1" * 3000 + " " + "1 " * 3000, "a." * 3000 + "@x.y", "+1" + " 2" * 4000,
    "4465758382889437 4465758382889437", "x@y.z" * 50, "...1..2.3.4", "5.6.7.8@a.b",
]


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)], texts[r.doc_id][:80]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert {*line.split(",")} - {""} <= {*r.spans.split(",")}


def test_texts(spark, tmp_path):
    spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, _c int").write.parquet(f"{tmp_path}/documents.parquet")
    check(pii.op8_pii(spark, str(tmp_path)).collect(), dict(enumerate(TEXTS)))


def test_corpus(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, small_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    secrets = [d for d, t in texts.items() if "token = " in t]
    found = {r.doc_id for r in rows if "secret:" in r.spans}
    assert found >= {*secrets} and len(found) <= len(secrets) + 2


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op8_pii(spark, str(tmp_path)).count() == 0


def test_reliabilities_follow_agreement():
    patterns = [(0, (1, 1, 0, 1, 1), (1, 0, 0, 0), 900), (0, (-1, -1, 0, 1, -1), (1, 0, 0, 0), 100), (0, (1, 1, 1, 1, 1), (1, 0, 0, 0), 50)]
    belief = pii.estimated(patterns)
    assert belief[0, (1, 1, 0, 1, 1)] > 0.9 > 0.1 > belief[0, (-1, -1, 0, 1, -1)]


def test_base_patterns_by_fuzzing(spark, tmp_path):
    rng = random.Random(8)
    parts = ["1", "23", "4111 1111 1111 1111", "5-5", "9", " ", "-", ".", "..", "@", "a", "x.y", "%", "+", "+1", "(", ")", "255", "256", "0", "\n", "é", "_", "  ", "--", "4539578763621486", "a@b.co", "1.2.3.4"]
    texts = dict(enumerate("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(3000)))
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(pii.op8_pii(spark, str(tmp_path)).collect(), texts)


def test_long_numeric_texts_take_seconds(spark, tmp_path):
    numbers = " ".join(f"{i:05d}," for i in range(140_000))
    cards = ", ".join(["4539578763621486"] * 3000) + " 1234567890123456x" * 3000
    ips = " ".join(f"10.0.{i % 256}.{i % 255}" for i in range(30_000))
    texts = dict(enumerate([numbers, cards, ips]))
    spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    rows = pii.op8_pii(spark, str(tmp_path)).collect()
    took = time.monotonic() - began
    check(rows, texts)
    assert took < 240


def test_added_spans(spark, tmp_path):
    """Votes on cards that fail the check and on secrets, and none on what looks like neither."""
    secret = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    texts = {i: f'the api token = "{secret(i)}" is here' for i in range(40)}
    texts |= {i: f"plain words and number {i} of them" for i in range(40, 80)}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.n_spans) for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    assert all(got[i] == (f"secret:{texts[i].index(secret(i))}:{texts[i].index(secret(i)) + 32}", 1) for i in range(40))
    assert all(got[i] == ("", 0) for i in range(40, 80))
