r"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, of BITS bits, of its words (`\w+`, lower
case), of neighbouring words and of words with one between them. Each feature counts
once, so a few telling words weigh as much in a long text as in a short one. FTRL-proximal
keeps a rate for each coordinate and an L1 penalty, so most weights are exactly zero; the
others are few, their number is at most that of the features of the training rows, and
they are sent to every task.

Training reads at most SAMPLE_ROWS labelled rows, those of the smallest hash of doc_id:
features are made where the texts are, and go to one task in a fixed order, so a model
comes out the same each time. Of rows that share a doc_id the text of the smallest hash
takes part. A row takes
part only if crc32(doc_id as text) mod 3 is not 1. Scoring covers every row in one pass
without a shuffle.

Defined cases: a null text counts as empty and gets the score of the intercept; a null
doc_id is scored, and held_out is null for it; a repeated row is scored as often as it
comes; without labels of both classes every score is BASE; an empty table gives an empty
result; columns other than doc_id and text are never looked at, and `clean_rows` returns
them untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_labels, keep_rows, map_texts, table, text_or_empty, word_hashes

BITS = 22
SAMPLE_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.0
#: Toxic rows are few; an error on one weighs this much.
TOXIC_WEIGHT = 2.0
THRESHOLD = 0.7
#: The score where nothing can be learned.
BASE = 0.0
WORD = re.compile(r"\w+")
_PAIR, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def features(text: str) -> np.ndarray:
    """Hashes, repeats included."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    parts = [h * _MIX]
    if len(h) > 1:
        parts.append((h[:-1] * _PAIR + h[1:]) * _MIX)
    if len(h) > 2:
        parts.append((h[:-2] * _SKIP + h[2:]) * _MIX)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Weights by feature (dense, mostly zero) and an intercept."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.at, self.values, self.intercept = at.astype(np.int32), weights.astype(np.float32), intercept
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, text: str) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.values
        found = features(text)
        found = np.unique(found[self._dense[found] != 0])
        z = float(self._dense[found].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def distinct_features(text: str) -> np.ndarray:
    return np.unique(features(text)).astype(np.int32)


def train(rows: list[np.ndarray], y: list[int]) -> Model | None:
    """FTRL-proximal over the rows' distinct features in the given order, EPOCHS times; None without both classes."""
    if len(set(y)) < 2:
        return None
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last coordinate is the intercept, without L1
    last = 1 << BITS
    for _ in range(EPOCHS):
        for x, label in zip(rows, y, strict=True):
            x = np.append(x, np.int32(last))
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            push = np.sign(zx) * np.maximum(np.abs(zx) - L1, 0)
            push[-1] = zx[-1]
            w = -push / ((BETA + root) / ALPHA + L2)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -30), 30))) - label
            g *= TOXIC_WEIGHT if label else 1.0
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
    push = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    push[-1] = z[-1]
    w = -push / ((BETA + np.sqrt(n)) / ALPHA + L2)
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]))


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model | None:
    """A model of at most `limit` labelled rows (toxic 1), none of them held out."""
    few = F.broadcast(bounded_labels(labels.where(remainder() != 1), "toxic", limit))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(few, "doc_id").select("doc_id", "label", F.xxhash64("text").alias("th"), "text")
    made = map_texts(rows, ["doc_id", "label", "th"], "text", lambda texts: {"x": [distinct_features(t).tobytes() for t in texts]}, "x binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("th", "x", "label")).alias("r"))
    ordered = one.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("r.x", "r.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            rows += (np.frombuffer(x, np.int32) for x in b.column(0).to_pylist())
            y += b.column(1).to_pylist()
        if model := train(rows, y):
            yield pa.RecordBatch.from_arrays([pa.array([model.at.tobytes()]), pa.array([model.values.tobytes()]), pa.array([model.intercept])], names=["at", "w", "b"])

    got = ordered.mapInArrow(run, "at binary, w binary, b double").collect()
    return Model(np.frombuffer(bytes(got[0]["at"]), np.int32), np.frombuffer(bytes(got[0]["w"]), np.float32), got[0]["b"]) if got else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        m = sent.value
        return {"score": [BASE if m is None else m.score(t) for t in texts]}

    out = map_texts(docs, ["doc_id"], "text", run, "score double")
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with a score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, "text", lambda texts: [sent.value is None or sent.value.score(t) < threshold for t in texts])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
