"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are words, their beginnings, word pairs and pairs that skip one word.  A term that a document has
twice or more, or four times or more, is a further feature each (``AGAIN``): insulting stems come up again
and again where others mention them once.  The model is fitted on the driver on a bounded,
class-balanced sample of labelled rows (``bound`` rows of each class), in ``ORDERS`` random orders, whose weights are
averaged: where few rows are toxic, one order alone varies by several per cent of them.  Per-coordinate learning rates and
L1 leave few non-zero weights, which are sent to the executors; every document is then scored on its
whole text.

Defined results: a null or empty text has only the bias; repeated rows are scored each; rows without
label or id are never learned; of an id with several labels the smallest counts; without labelled rows
of both classes every score is the neutral 0.5 - the smallest step below, so nothing is predicted toxic.
Documents need the columns ``doc_id`` and ``text``; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.llm import features, spans
from cladeweave.llm.shared import lean

BITS = 20
STEMS = (5, 7, 9)
#: Counts from which on a term is a further feature.
AGAIN = (2, 4)
#: Labelled rows of each class that are learned at most; orders of the rows whose weights are averaged.
BOUND = 4000
ORDERS = (7, 8, 9)
#: L1 of the fitted model, chosen by four folds of the rows that are learned from.
L1 = 6.0
U = np.uint64


def term_groups(buf: np.ndarray, offs: np.ndarray) -> Iterator[features.Group]:
    """Buckets of words, their beginnings, word pairs and pairs that skip one word.

    Case and punctuation are dropped.  Beginnings (of ``STEMS`` bytes) let inflected and compound
    forms that the sample lacks share the weight of those it has.
    """
    starts, ends, of = spans.word_spans(buf, offs, spans.PUNCT)
    c = spans.prefix_hash(buf, True)
    h = spans.span_hash(c, starts, ends)
    top = U(64 - BITS)
    yield (h >> top).astype(np.uint32), of
    for n in STEMS:
        stem = spans.span_hash(c, starts, np.minimum(ends, starts + n))
        yield (spans.mix64(stem + U(n)) >> top).astype(np.uint32), of
    for gap in (1, 2):
        (a, b), at = features.pairs_within(h, of, gap)
        yield (spans.mix64(a * spans.PLACE[gap] + b) >> top).astype(np.uint32), at


def again(terms: np.ndarray, least: int) -> np.ndarray:
    """The buckets of the features "this term ``least`` times or more"."""
    return (spans.mix64(terms.astype(U) + U(least << 32)) >> U(64 - BITS)).astype(np.uint32)


def distinct_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf, offs = spans.text_buffers(pc.utf8_lower(column))
    for lo, hi in spans.slices(offs):
        groups = list(term_groups(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
        for d in range(hi - lo):
            terms, counts = np.unique(np.concatenate([b[at[d] : at[d + 1]] for b, at in groups]), return_counts=True)
            found = np.unique(np.concatenate([terms, *(again(terms[counts >= c], c) for c in AGAIN)]))
            yield found, np.ones(len(found), dtype=np.int64)


@dataclass
class Ftrl:
    """Binary FTRL-proximal with indicator features; the last coordinate is the bias."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    size: int = (1 << BITS) + 1

    def fit(self, rows: list[tuple[int, np.ndarray]], epochs: int = 3, seed: int = 7) -> np.ndarray:
        z, n = np.zeros(self.size), np.zeros(self.size)
        order = np.random.default_rng(seed)
        bias = np.array([self.size - 1], dtype=np.int64)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                y, terms = rows[k]
                at = np.concatenate((terms, bias))
                w = self._weights(z[at], n[at])
                w[-1] = -z[at[-1]] / ((self.beta + np.sqrt(n[at[-1]])) / self.alpha)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                root = np.sqrt(n[at])
                z[at] += g - (np.sqrt(n[at] + g * g) - root) / self.alpha * w
                n[at] += g * g
        out = self._weights(z, n)
        out[-1] = -z[-1] / ((self.beta + np.sqrt(n[-1])) / self.alpha)
        return out

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, label: str = "toxic", least_documents: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero buckets, their weights, and the bias.

    Terms in fewer than ``least_documents`` documents of the sample are not learned.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    got = features.sample_features(docs, features.sample_ids(rows, bound, by="label", most_labels=features.MOST_LABELS), distinct_terms)
    if len({y for y, _, _ in got}) < 2:
        return np.empty(0, np.int64), np.empty(0), -1e-9
    seen = np.zeros(1 << BITS, dtype=np.int32)
    for _, terms, _ in got:
        seen[terms] += 1
    rows = [(y, terms[seen[terms] >= least_documents]) for y, terms, _ in got]
    del got
    by_class = {c: [r for r in rows if r[0] == c] for c in sorted({y for y, _ in rows})}
    most = max(map(len, by_class.values()))
    # Where one class has fewer rows than the bound, they are learned as often as it takes to balance.
    balanced = [r for own in by_class.values() for r in own * (most // len(own))]
    weights = np.mean([Ftrl(l1=L1).fit(balanced, seed=order) for order in ORDERS], axis=0)
    at = np.flatnonzero(weights[:-1])
    return at, weights[at], float(weights[-1])


def probabilities(column: pa.Array, tables: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each whole text of a column.

    ``tables`` has a row of weights of the terms and one for each count in ``AGAIN``, by the term's bucket.
    """
    buf, offs = spans.text_buffers(pc.utf8_lower(column))
    total = np.full(len(offs) - 1, bias)
    weighs = tables.any(axis=0)
    for lo, hi in spans.slices(offs):
        docs_at, terms = [], []
        for buckets, begins in term_groups(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
            hit = np.flatnonzero(weighs[buckets])
            docs_at.append(np.searchsorted(begins, hit, "right") - 1)
            terms.append(buckets[hit])
        key, counts = np.unique((np.concatenate(docs_at) << BITS) | np.concatenate(terms).astype(np.int64), return_counts=True)
        doc, term = key >> BITS, key & ((1 << BITS) - 1)
        np.add.at(total, lo + doc, tables[0][term])
        for weights, least in zip(tables[1:], AGAIN, strict=True):
            many = counts >= least
            np.add.at(total, lo + doc[many], weights[term[many]])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _dense(model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model[0]] = model[1]
    every = np.arange(1 << BITS, dtype=np.uint32)
    return np.stack([table, *(table[again(every, c)] for c in AGAIN)])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        tables = _dense(sent.value)

        def of(column: pa.Array) -> dict[str, pa.Array]:
            p = probabilities(column, tables, sent.value[2])
            return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

        return of

    return features.score_rows(docs, scorer, "score double, predicted int")


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    return score(docs, fit(docs, labels, bound))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """``docs`` without the documents that are predicted toxic, in one pass and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _dense(sent.value)
        for b in batches:
            yield b.filter(pa.array(probabilities(b.column(at), tables, sent.value[2]) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
