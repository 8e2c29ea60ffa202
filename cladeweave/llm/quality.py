"""Quality scores: supervised subword embeddings averaged per document with a softmax output.

Features are hashed words, word pairs and character (byte) n-grams.  Their vectors are averaged over
the whole document and a softmax layer gives the classes; both are learned by numpy stochastic
gradient descent on the driver, on at most ``bound`` labelled rows.  The layers after the average are
linear up to the softmax, so for scoring each bucket's vector is projected once on the difference of
the two class rows: the scores are the same and one number a bucket travels to the executors.

Defined results: a null or empty text has an average of zero and gets the score of the bias; repeated
rows are scored each; without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm import features

FEATURES = features.HashedText(sizes=(2, 3), bits=16, lower=False, merge_punctuation=False, words=True)
DIMENSIONS = 8
CUT = 0.3


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, epochs: int = 6, rate: float = 1.0, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, class rows and class biases."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << bits, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, counts = rows[k]
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            h = share @ vectors[at] if len(at) else np.zeros(DIMENSIONS)
            logits = out @ h + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            done += 1
            if len(at):
                # Vectors move by their share of the average, enlarged to the scale of one feature.
                vectors[at] -= np.minimum(share * 50, 1)[:, None] * (step * (p @ out)).astype(np.float32)
            out -= step * np.outer(p, h)
            bias -= 0.1 * step * p
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, bound: int = 6000, label: str = "quality") -> tuple[np.ndarray, float]:
    """One number for each bucket, and the bias, whose logistic is the probability of label 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    got = features.sample_features(docs, features.sample_ids(rows, bound), lambda c: features.counted(c, FEATURES))
    if len({y for y, _, _ in got}) < 2:
        return np.zeros(1 << FEATURES.bits, dtype=np.float32), 0.0
    vectors, out, bias = train([(int(y == 1), at, n) for y, at, n in got], FEATURES.bits)
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        table, bias = sent.value

        def of(column: pa.Array) -> dict[str, pa.Array]:
            p = 1 / (1 + np.exp(-np.clip(features.mean_scores(column, FEATURES, table[:, None])[:, 0] + bias, -35, 35)))
            return {"score": pa.array(p), "predicted": pa.array((p >= CUT).astype(np.int32))}

        return of

    return features.score_rows(docs, scorer, "score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> DataFrame:
    return score(docs, fit(docs, labels, bound))
