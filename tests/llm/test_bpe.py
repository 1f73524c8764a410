"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexgrid.llm.bpe import Bpe, digests, op1_bpe, with_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "Hello, World!", "it's we've I'LL don't 'tis", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ Σ İstanbul Straße ⅷ Ⅷ", "éclair éclair",
    "日本語のテキスト 漢字", "emoji 👩‍👩‍👧 🎉🎉", "x" * 5000, "ab" * 700 + " c", "１２３ 12345 ½", "tab\tnew\nline\x0b\x0c\r\x85  z", "!!!???...", "​zero", "<|endoftext|", "\x00\x01",
]


@pytest.fixture(scope="module")
def both():
    return Bpe(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    mine, theirs = both
    ids = mine.encode(text)
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
    assert mine.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_texts(both, text):
    same(both, text)


def test_random_words(both):
    rng = random.Random(3)
    for _ in range(400):
        same(both, "".join(rng.choice("abcdefghijklmnop ,.'ÀÉß0-") for _ in range(rng.randrange(1, 300))))


def test_scan_and_heap_agree(both):
    rng = random.Random(5)
    for most in [60] * 200 + [600] * 20:
        parts = [both[0].first[b] for b in "".join(rng.choice("thean") for _ in range(rng.randrange(2, most))).encode()]
        assert both[0]._scan(list(parts)) == both[0]._heap(list(parts))


def test_corpus(spark, small_dir):
    theirs = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, small_dir).collect():
        want = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 8), (2, "", None)], "doc_id long, text string, ids int")
    rows = with_ids(d, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 0, ""), (1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (2, 0, "")]
    assert digests(d.limit(0), PATH).count() == 0
