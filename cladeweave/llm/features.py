"""Hashed text features of whole documents, and bounded labelled samples.

A feature group is a pair ``(buckets, offsets)``: hashed feature ids of all documents of a slice, in
order, and where each document's ids begin.  Bucket numbers do not depend on where a document
stands, so neither do scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.llm import spans
from cladeweave.llm.shared import cut, fold_of, lean

Group = tuple[np.ndarray, np.ndarray]


def byte_fold(lower: bool, merge_punctuation: bool) -> np.ndarray:
    """A byte table: white space (and, if asked, punctuation) as one code, digits as one code."""
    codes = np.arange(256, dtype=np.uint32)
    codes[48:58] = 48
    codes[spans.WHITE] = 32
    if merge_punctuation:
        codes[spans.PUNCT] = 32
    if lower:
        codes[65:91] += 32
    return codes


@dataclass(frozen=True)
class HashedText:
    """Byte n-grams, words and word pairs, hashed into ``2**bits`` buckets each kind alike."""

    sizes: tuple[int, ...]
    bits: int
    lower: bool
    merge_punctuation: bool
    words: bool = False

    def groups(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[Group]:
        codes = byte_fold(self.lower, self.merge_punctuation)[buf]
        lengths = np.diff(offs)
        shift = np.uint32(32 - self.bits)
        ends = np.repeat(offs[1:], lengths)
        place = np.arange(len(buf))
        code = codes.copy()
        for n in range(1, max(self.sizes, default=0) + 1):
            if n > 1:
                code = code[:-1] | (codes[n - 1 :] << np.uint32(8 * (n - 1))) if len(code) else code
            if n in self.sizes:
                mixed = (code ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(2654435761)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(2246822519)
                inside = place[: len(code)] + n <= ends[: len(code)]
                at = np.zeros(len(offs), dtype=np.int64)
                np.cumsum(np.maximum(lengths - n + 1, 0), out=at[1:])
                yield (mixed >> shift)[inside], at
        if self.words:
            starts, stops, of = spans.word_spans(buf, offs, spans.WHITE)
            h = spans.span_hash(spans.prefix_hash(buf, self.lower), starts, stops)
            top = np.uint64(64 - self.bits)
            yield (h >> top).astype(np.uint32), of
            # A pair hash by difference: a word said twice has the same bucket whatever the word is.
            pair, at = pairs_within(h, of, 1)
            yield (spans.mix64(pair[0] - pair[1]) >> top).astype(np.uint32), at


def pairs_within(h: np.ndarray, of: np.ndarray, gap: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Items of ``h`` and those ``gap`` places later in the same document; offsets of the pairs."""
    counts = np.diff(of)
    kept = np.maximum(counts - gap, 0)
    first = spans.ranges(of[:-1], kept)
    at = np.zeros(len(of), dtype=np.int64)
    np.cumsum(kept, out=at[1:])
    return (h[first], h[first + gap]), at


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one or more columns) for each document."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def mean_scores(column: pa.Array, features: HashedText, table: np.ndarray) -> np.ndarray:
    """Mean of ``table`` rows over all features of each document (0 for a document without any)."""
    buf, offs = spans.text_buffers(column)
    found = []
    for lo, hi in spans.slices(offs):
        o, part = offs[lo : hi + 1] - offs[lo], buf[offs[lo] : offs[hi]]
        total, n = np.zeros((hi - lo, table.shape[1])), np.zeros(hi - lo)
        for buckets, at in features.groups(part, o):
            total += np.stack([sums(table[:, m][buckets], at) for m in range(table.shape[1])], axis=1)
            n += np.diff(at)
        found.append(total / np.maximum(n, 1)[:, None])
    return np.concatenate(found) if found else np.zeros((0, table.shape[1]))


def counted(column: pa.Array, features: HashedText) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each document."""
    buf, offs = spans.text_buffers(column)
    for lo, hi in spans.slices(offs):
        o, part = offs[lo : hi + 1] - offs[lo], buf[offs[lo] : offs[hi]]
        groups = list(features.groups(part, o))
        for d in range(hi - lo):
            yield np.unique(np.concatenate([b[at[d] : at[d + 1]] for b, at in groups]), return_counts=True)


#: Distinct buckets that stand for a document that is learned from; values of ``by`` and sampled rows of all values together.
MOST_TERMS = 1 << 14
MOST_LABELS = 256
MOST_ROWS = 12_000


def thinned(buckets: np.ndarray, counts: np.ndarray, most: int = MOST_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """A document's features, or the ``most`` of them with the least hashes: the same buckets stay in all long documents."""
    if len(buckets) <= most:
        return buckets, counts
    kept = np.sort(np.argpartition(spans.mix64(buckets.astype(np.uint64)), most)[:most])
    return buckets[kept], counts[kept]


def sample_ids(labelled: DataFrame, bound: int, by: str | None = None, most_labels: int | None = None) -> DataFrame:
    """At most ``bound`` labelled rows (of each value of ``by``) outside the held-out fold.

    ``labelled(doc_id, label)``; rows are taken in the order of a hash of their id, so the sample does
    not depend on partitioning.  The result is bounded, by rows for each value.
    From a value's count follows below which hash about ``bound`` rows lie, so that no more than these meet
    in the task of a value.  ``most_labels`` keeps the commonest values (equal counts: the first by name) and lowers
    ``bound`` to keep the rows of all within ``MOST_ROWS``; without it every value has rows, however many there are.
    """
    rows = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold_of("doc_id") != 0)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if by is None:
        return rows.orderBy(*order).limit(bound)
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    if most_labels is not None:
        counts = cut(counts.orderBy(F.desc("n"), "label").limit(most_labels))
        bound = min(bound, max(1, MOST_ROWS // max(1, counts.count())))
        counts = F.broadcast(counts)
    share = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    near = rows.join(counts, "label").where(share * F.col("n") <= 1.2 * bound + 100).drop("n")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= bound).drop("rank")


def sample_features(docs: DataFrame, sample: DataFrame, make: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """``(label, buckets, counts)`` of the sampled documents, in the order of their ids.

    Only the sample's features reach the driver: at most the sample's rows times ``MOST_TERMS`` buckets (``thinned``).
    Every sampled document is learned from, and repeated ids are learned each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [thinned(*r) for r in make(part.column(1))]
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array([x.astype("<u4").tobytes() for x, _ in rows], pa.binary()), pa.array([b"" if (n == 1).all() else n.astype("<u4").tobytes() for _, n in rows], pa.binary())],  # indicators have no counts
                    names=["doc_id", "label", "buckets", "counts"],
                )

    kind = dict(sample.dtypes)["label"]
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", "label")
        .mapInArrow(lean(run), f"doc_id long, label {kind}, buckets binary, counts binary")
        .toArrow()
        .sort_by("doc_id")
    )
    out = []
    for y, b, n in zip(found["label"], found["buckets"], found["counts"], strict=True):
        buckets, counts = np.frombuffer(b.as_buffer(), "<u4"), np.frombuffer(n.as_buffer(), "<u4")
        out.append((y.as_py(), buckets, counts if len(counts) else np.broadcast_to(np.uint32(1), len(buckets))))
    return out


def score_rows(docs: DataFrame, scorer: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], schema: str) -> DataFrame:
    """``doc_id, held_out`` and the columns that a score makes of each whole text.

    ``scorer`` is called once in each task, so tables that it builds serve all batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in batches:
            made = score(b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), *made.values()], names=["doc_id", "held_out", *made])

    held_out: Column = (fold_of("doc_id") == 0).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id long, held_out boolean, {schema}")
