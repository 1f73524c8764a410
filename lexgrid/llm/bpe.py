"""BPE encoding and decoding with a contiguous rank array.

A short word is held as its part boundaries plus the rank of each adjacent
pair.  The lowest rank is found by scanning the array, its boundary is
deleted, and the two neighbouring ranks are looked up again, until no pair has
a rank.  A word of more than LONG symbols takes a heap over linked parts, which
gives the same merges without a quadratic scan.

Reads tokenizer files of the kind: BPE with word ends, NFC, white space folded,
lower case, split by a pattern, byte-level alphabet.  Strings of special tokens
in a text become their ids, as in the tokenizers library; the ids it adds
around a text are not added.  A null text is empty: no ids, empty decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexgrid.llm.shared import table

#: Words with more symbols than this take the heap.
LONG = 128
#: Encoded words kept per Python worker; the store is emptied when full.
WORDS_KEPT = 400_000
#: Words of more characters than this are encoded but not kept.
KEPT_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        chars = byte_alphabet()
        self.first = [vocab[c] for c in chars]
        self.final = [vocab[c + self.end] for c in chars]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.text: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.pieces = [self.text.get(i, "").encode() for i in range(max(self.text) + 1)]
        self.kept: dict[str, bytes] = {}

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.first[b] for b in data[:-1]] + [self.final[data[-1]]]
        return self._scan(parts) if len(parts) <= LONG else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        ranks, none = self.ranks, (1 << 60, 0)
        pairs = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = (best[1],)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get((best[1], parts[i + 1]), none)
            if i:
                pairs[i - 1] = ranks.get((parts[i - 1], best[1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*self.ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        queue = [(rank, i, new, p) for rank, new, i, p in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (found := self.ranks.get(p := (parts[left], parts[right]))):
                    heapq.heappush(queue, (found[0], left, found[1], p))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered by itself
        return self.word.findall(text.lower())

    def _packed(self, text: str) -> bytes:
        kept, out = self.kept, self.words(text)
        try:
            return b"".join([kept[w] for w in out])
        except KeyError:
            for w in {*out}.difference(kept):
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                ids = np.array(self.encode_word(w), dtype="<u4").tobytes()
                if len(w) <= KEPT_LENGTH:
                    kept[w] = ids
            return b"".join([kept[w] if w in kept else np.array(self.encode_word(w), dtype="<u4").tobytes() for w in out])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._packed(text)
        return b"".join(
            np.array([self.specials[part]], dtype="<u4").tobytes() if i % 2 else self._packed(part)
            for i, part in enumerate(self.special.split(text))
        )

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: their tokens, special ones too, joined by spaces."""
        pieces = self.pieces
        return b" ".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@cache
def loaded(path: str) -> Bpe:
    """The tokenizer of a file, once per Python worker."""
    return Bpe(path)


def with_ids(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """documents plus n_tokens (long), ids (binary, u32 little-endian) and decoded (string).

    One pass without a shuffle; a row's outputs depend on its own text alone.
    Columns of the input with those names are replaced.
    """
    keep = [c for c in documents.columns if c not in ("n_tokens", "ids", "decoded")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in keep]).schema), "n_tokens bigint", "ids binary", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(text).to_pylist()]
                decoded = [bpe.decode(i).decode() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded"],
                )

    return documents.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)


def digests(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row: the real ids and decoded text stay in the worker."""
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = []
            for t in batch.column(text):
                ids = bpe.encode(t.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(key, text).mapInArrow(run, schema)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), production_path())


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
