"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family chooses the family; within it a machine for
each pair of languages votes.  Features are hashed byte n-grams of whole texts, as shares of all
n-grams of a document.  The machines are fitted on at most ``bound`` documents of each of the ``most_labels`` commonest
languages (and 12,000 documents in all), whatever else the column holds; the averaged weights travel to the executors, where every document is scored.

Defined results: a text that is null or has no letter is ``und`` with score 0; repeated rows are
scored each; rows without language are never learned; without any learned language every row is
``und``.  A language that no family lists is a family of its own.  Of languages with equal votes the larger margins
decide, and then the first by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm import features

FEATURES = features.HashedText(sizes=(1, 2, 3, 4), bits=16, lower=True, merge_punctuation=True)
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
}
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, epochs: int = 6, penalty: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine by averaged stochastic subgradient steps on the hinge loss."""
    rng = np.random.default_rng(seed)
    weights = {1: 0.5 * len(signs) / max((signs > 0).sum(), 1), -1: 0.5 * len(signs) / max((signs < 0).sum(), 1)}
    # The iterate after a step is ``scale * w``; ``so_far`` adds up scales, so that coordinates are averaged when they change.
    w, total, last, scale, so_far, bias, bias_sum, t = np.zeros(size), np.zeros(size), np.zeros(size), 1.0, 0.0, 0.0, 0.0, 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            t += 1
            (at, x), y = rows[k], signs[k]
            step = 1 / (penalty * (t + 1e4))
            margin = y * (w[at] @ x * scale + bias)
            scale *= 1 - step * penalty
            if margin < 1:
                total[at] += w[at] * (so_far - last[at])
                last[at] = so_far
                w[at] += step * y * weights[int(y)] * x / scale
                bias += 0.01 * step * penalty * y * weights[int(y)]
            so_far += scale
            bias_sum += bias
    total += w * (so_far - last)
    return total / max(t, 1), bias_sum / max(t, 1)


@dataclass(frozen=True)
class Model:
    """Columns of ``table``: first a machine for each family, then one for each pair."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    table: np.ndarray
    bias: np.ndarray


def _unit(at: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at.astype(np.int64), counts / max(counts.sum(), 1) * scale[at]


def fit(docs: DataFrame, bound: int = 1500, lang: str = "lang", most_labels: int = features.MOST_LABELS) -> Model | None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("label"))
    got = features.sample_features(docs, features.sample_ids(rows, bound, by="label", most_labels=most_labels), lambda c: features.counted(c, FEATURES))
    langs = sorted({y for y, _, _ in got})
    if not langs:
        return None
    size = 1 << FEATURES.bits
    mean = np.zeros(size)
    for _, at, n in got:
        mean[at] += n / max(n.sum(), 1)
    mean /= len(got)
    scale = 1 / np.sqrt(mean + 1e-5)  # common n-grams do not outweigh the others
    x = [_unit(at, n, scale) for _, at, n in got]
    families = sorted({family_of(y) for y in langs})
    members = {f: [y for y in langs if family_of(y) == f] for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    columns = []
    for f in families:
        signs = np.array([1 if family_of(y) == f else -1 for y, _, _ in got])
        columns.append(svm(x, signs, size) if len(families) > 1 else (np.zeros(size), 1.0))
    for a, b in pairs:
        own = [k for k, (y, _, _) in enumerate(got) if y in (a, b)]
        columns.append(svm([x[k] for k in own], np.array([1 if got[k][0] == a else -1 for k in own]), size))
    table = np.stack([w * scale for w, _ in columns], axis=1).astype(np.float32)
    return Model(families, members, pairs, table, np.array([b for _, b in columns]))


def decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of margins."""
    squash = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -35, 35)))
    k = len(model.families)
    family = margins[:, :k].argmax(axis=1)
    certainty = squash(margins[np.arange(len(margins)), family]) if k > 1 else np.ones(len(margins))
    votes = {y: np.zeros(len(margins)) for m in model.members.values() for y in m}
    chance = {y: np.ones(len(margins)) for y in votes}
    for j, (a, b) in enumerate(model.pairs, k):
        m = margins[:, j]
        # Whole votes first; margins decide between equal numbers of votes.
        votes[a] += (m >= 0) + 1e-3 * np.tanh(m)
        votes[b] += (m < 0) - 1e-3 * np.tanh(m)
        chance[a] = np.minimum(chance[a], squash(m))
        chance[b] = np.minimum(chance[b], squash(-m))
    names, scores = np.empty(len(margins), dtype=object), np.zeros(len(margins))
    for j, f in enumerate(model.families):
        rows = np.flatnonzero(family == j)
        best = np.stack([votes[y][rows] for y in model.members[f]], axis=1).argmax(axis=1)
        for i, y in enumerate(model.members[f]):
            own = rows[best == i]
            names[own], scores[own] = y, certainty[own] * chance[y][own]
    return list(names), scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> dict[str, pa.Array]:
        model = sent.value  # one object for all batches of a worker
        known = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in column], dtype=bool)
        if model is None:
            known[:] = False
            names, scores = ["und"] * len(column), np.zeros(len(column))
        else:
            names, scores = decide(model, features.mean_scores(column, FEATURES, model.table) + model.bias)
        return {"lang_pred": pa.array([n if k else "und" for n, k in zip(names, known, strict=True)], pa.string()), "score": pa.array(np.where(known, scores, 0.0))}

    return features.score_rows(docs, lambda: of, "lang_pred string, score double")


def identify(docs: DataFrame, bound: int = 1500) -> DataFrame:
    return predict(docs, fit(docs, bound))
