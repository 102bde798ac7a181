"""Quality scores: logistic regression on hashed word n-grams.

Words and runs of marks are tokens; a word in capitals throughout counts as one
common token, since its spelling tells less than its case, and so does a token
that follows itself as a pair. Single tokens and pairs of neighbours are hashed into ``2**BITS`` slots, counted, and scaled to
unit length. Weights are learned by follow-the-regularised-leader updates,
which keep most of them at exactly zero; a score is a sparse dot product.

Cases: null and empty texts have no features and get the score of the bias;
very long texts are read whole; repeated rows get equal scores; without any
label all scores are 0.5; an empty table gives no rows; conflicting labels of
one id count as the lower one, and of several texts of one id the smallest is learned from; further columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, fold, only
from ridgeline.llm.registry import query
from ridgeline.llm.sampling import training_sample

BITS = 18
TRAIN_DOCS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
CAPITALS = 0x9E3779B97F4A7C15
REPEATED = np.uint64(0x165667B19E3779F9)
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text, of unit length; empty without tokens."""
    h = xxhash.xxh3_64_intdigest
    one = np.array([CAPITALS if len(w) > 1 and w.isupper() else h(w.lower()) for w in TOKEN.findall((text or "").encode())], dtype=np.uint64)
    two = np.where(one[:-1] == one[1:], REPEATED, (one[:-1] * PAIR) ^ (one[1:] >> np.uint64(7)))
    slots, counts = np.unique(np.concatenate([one, two]) >> np.uint64(64 - BITS), return_counts=True)
    values = counts.astype(np.float64)
    return slots.astype(np.intp), values / np.sqrt((values * values).sum()) if len(values) else values


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        slots, values = features(text)
        z = self.bias + float(self.weights[slots] @ values)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


def train(texts: list[str | None], labels: list[int]) -> Classifier:
    """Follow the regularised leader, one example at a time; the bias is not penalised."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        one = np.where(at == size, 0.0, L1)
        w = -(z[at] - np.sign(z[at]) * one) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(at == size, 0.0, L2))
        return np.where(np.abs(z[at]) <= one, 0.0, w)

    rows = []
    for t in texts:
        slots, values = features(t)
        rows.append((np.append(slots, size), np.append(values, 1.0)))
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0))) - labels[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Classifier(w[:size].astype(np.float32), float(w[size]))


def score_rows(docs: DataFrame, model: Classifier) -> DataFrame:
    """All columns of ``docs`` (``text`` among them) with ``score`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")


def learn(docs: DataFrame, labels: DataFrame, eligible: Column, bound: int = TRAIN_DOCS) -> Classifier:
    """From (doc_id, text) and (doc_id, quality); ``eligible`` is a condition on ``doc_id``."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & eligible).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most ``bound`` ids, so they may be sent to every task
    some = training_sample(marks, F.lit(True), bound, "quality")
    seen = docs.where(eligible).join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r["text"] for r in seen], [int(r["quality"]) for r in seen])


def in_training(doc_id: Column) -> Column:
    return fold(doc_id, 5) != 0


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned outside the held-out fifth."""
    docs = only(documents(spark, sf_dir), doc_id="doc_id", text="text")
    labels = only(documents(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    model = learn(docs, labels, in_training(F.col("doc_id")))
    scored = score_rows(docs, model)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
