"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 low quality, 2 good.  All grades share one
weight per hashed text feature (words present in the text, and a few binned
measures of its shape); thresholds in ascending order turn the score into
P(grade > k) by the logistic link.  The expected grade is the sum of these tail
probabilities, and a document is selected if P(grade > 1) is at least SELECT.

A null or empty text has only its shape features.  Labels that are null, and
labels of documents that do not exist, are not learned from.  Of repeated rows
each is scored alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import table

#: Documented bound of the labelled sample, about.
TRAINING_ROWS = 12_000
#: A feature is learned if so many documents of the sample have it.
LEAST_DOCUMENTS = 5
STEPS, RATE, PENALTY = 300, 0.05, 3e-4
SELECT = 0.6
GRADES = 3
_WORD = regex.compile(r"\p{L}+")


def features(text: str | None) -> set[int]:
    """Hashed features of a text: 32-bit hashes of its distinct words, and of its binned shape."""
    text = text or ""
    split = text.split()
    words = {*_WORD.findall(text.lower())}
    n, chars = max(1, len(split)), max(1, len(text))
    upper = sum(map(str.isupper, split))
    shape = (
        ("size", int(math.log2(len(split) + 1))),
        ("symbols", int(8 * min(1.0, sum(map(text.count, "#*$%&|<>")) / n))),
        ("pipes", int(8 * min(1.0, text.count("|") / n))),
        ("bangs", int(8 * min(1.0, text.count("!") / n))),
        ("upper", int(8 * upper / n)),
        ("distinct", int(8 * len(words) / n)),
        ("stops", int(20 * min(1.0, (text.count(".") + text.count(",")) / n))),
        ("length", min(12, chars // n)),
    )
    return {*(zlib.crc32(w.encode()) for w in words), *(zlib.crc32(f"#{k}={v}".encode()) for k, v in shape)}


@dataclass
class Ordinal:
    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, text: str | None) -> list[float]:
        """P(grade > k) for each k but the last grade."""
        get = self.weights.get
        score = math.fsum([get(f, 0.0) for f in features(text)])
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def fit(rows: list[tuple[int, np.ndarray]]) -> Ordinal:
    """Full-batch Adam on the negative log likelihood of the grades; thresholds are a first one plus positive gaps."""
    rng_order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1].tobytes()))
    grades = np.array([rows[i][0] for i in rng_order])
    if len(rows) == 0:
        return Ordinal({}, [0.0, 0.0])
    index = np.concatenate([rows[i][1] for i in rng_order])
    owner = np.repeat(np.arange(len(rows)), [len(rows[i][1]) for i in rng_order])
    names, index, seen = np.unique(index, return_inverse=True, return_counts=True)
    keep = seen >= LEAST_DOCUMENTS
    place = np.cumsum(keep) - 1
    owner, index = owner[keep[index]], place[index[keep[index]]]
    names = names[keep]
    n, k = len(rows), len(names)
    share = [np.clip((grades > g).mean(), 0.01, 0.99) for g in range(GRADES - 1)]
    cut = np.array([math.log((1 - s) / s) for s in share])
    params = np.concatenate([np.zeros(k), [cut[0]], np.log(np.maximum(np.diff(cut), 0.1))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, STEPS + 1):
        w, base, gaps = params[:k], params[k], np.exp(params[k + 1 :])
        theta = base + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, w[index], n) if len(index) else np.zeros(n)
        tail = sigmoid(score[:, None] - theta[None, :])
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        upper, lower = full[at, grades], full[at, grades + 1]
        p = np.maximum(upper - lower, 1e-9)
        slope_u, slope_l = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = -(slope_u - slope_l)
        by_theta = np.zeros(GRADES - 1)
        for g in range(GRADES - 1):
            by_theta[g] = (slope_u[grades == g + 1]).sum() - (slope_l[grades == g]).sum()
        grad = np.concatenate([np.bincount(index, by_score[owner], k) / n + PENALTY * w, [by_theta.sum() / n], [by_theta[g + 1 :].sum() * gaps[g] / n for g in range(GRADES - 2)]])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    theta = params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1 :]))])
    return Ordinal({int(f): float(x) for f, x in zip(names, params[:k]) if x}, [float(t) for t in theta])


def grade(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels with doc_id, quality and toxic."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", g.cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())


def trained(documents: DataFrame, graded: DataFrame) -> Ordinal:
    """Learns from about TRAINING_ROWS labelled documents chosen by a hash of their ids.

    Only chosen documents are joined to their grades, and only their hashed
    features reach the driver.
    """
    n = graded.count()
    span = 1 << 30
    chosen = F.pmod(F.xxhash64(F.lit("ratings"), "doc_id"), F.lit(span)) < min(span, span * TRAINING_ROWS // max(1, n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int64()))], names=["grade", "features"])

    sample = documents.select("doc_id", "text").where(chosen).join(graded.where(chosen), "doc_id").select("grade", "text")
    got = sample.mapInArrow(run, "grade int, features array<bigint>").toArrow()
    return fit([(g, np.array(f, dtype=np.int64)) for g, f in zip(got.column("grade").to_pylist(), got.column("features").to_pylist())])


def scored(documents: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, expected_grade, p_low (P(grade > 0)), p_good (P(grade > 1)) and selected.  No shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # as many weights as the bounded sample has features
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, expected_grade double, p_low double, p_good double, selected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            tails = [model.tails(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([sum(t) for t in tails], pa.float64()), *(pa.array([t[g] for t in tails], pa.float64()) for g in range(2)), pa.array([t[-1] >= SELECT for t in tails], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "expected_grade", "p_low", "p_good", "selected"])

    return documents.select(key, text).mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(documents, trained(documents, grade(table(spark, sf_dir, "labels"))))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
SQL: dict[str, str] = {}
