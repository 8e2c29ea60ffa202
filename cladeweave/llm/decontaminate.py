"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment of words.

1. The benchmark is taken in blocks of bounded size (one block for any usual benchmark); a block's
   index is all that is sent to the executors, so its size is checked by construction.
2. The words of a block are counted over all documents (partial counts in every task).  An n-gram of
   two or three words is a rare seed if, with these frequencies, it would stand at a given place by
   chance with probability ``chance`` or less.  Rarity is computed from its words, not from how often
   it occurs, so a passage that leaked into a third of the corpus keeps its seeds.  Items without any
   rare seed use all their n-grams.  An item of one word has that word as its seed; if the word is not
   rare, it counts only in documents that consist of it.
3. Every document is scanned whole.  Seeds place an item on diagonals of the document; around them
   windows of the document are aligned with the item (match 1, other word or gap -0.6), batched over
   all windows of a slice.  A pair whose best score is ``least_score`` of the item's words or more is
   a leak.

Defined results: null or empty texts and items without words match nothing; rows of one document id and
item id are reported as one, with the best score and the first place, also if ids repeat or are null;
words are lower-cased and cut at ASCII non-alphanumerics.  Documents of ``keep_clean`` need a column
``text``; rows that repeat stay or go alike, and extra columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm import spans
from cladeweave.llm.shared import lean

U = np.uint64
SEED_SIZES = (1, 2, 3)
PENALTY = 0.6
BLOCK_CHARS = 16_000_000
FILTER_BITS = 20


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and word offsets of each slice of a column."""
    buf, offs = spans.text_buffers(pc.utf8_lower(column))
    for lo, hi in spans.slices(offs):
        o, part = offs[lo : hi + 1] - offs[lo], buf[offs[lo] : offs[hi]]
        starts, ends, of = spans.word_spans(part, o, spans.PUNCT)
        yield lo, spans.span_hash(spans.prefix_hash(part, True), starts, ends), of


class Lookup:
    """Places of hashes in a sorted table, behind a small bitmap."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bitmap = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bitmap[(table & U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of members of ``h`` and their places in the table."""
        maybe = np.flatnonzero(self.bitmap[(h & U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.table):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.table, h[maybe]), len(self.table) - 1)
        hit = self.table[at] == h[maybe]
        return maybe[hit], at[hit]


@dataclass
class Items:
    """Benchmark items of one block as word hashes."""

    ids: list[int]
    words: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, rows: list[tuple[int, str | None]]) -> Items:
        parts = list(_words(pa.array([t for _, t in rows], pa.string())))
        words = np.concatenate([w for _, w, _ in parts]) if parts else np.empty(0, U)
        lengths = np.concatenate([np.diff(of) for _, _, of in parts]) if parts else np.empty(0, np.int64)
        return cls([i for i, _ in rows], words, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64))

    def seeds(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, item and place of every n-gram of ``size`` words."""
        counts = np.maximum(np.diff(self.of) - size + 1, 0)
        at = spans.ranges(self.of[:-1], counts)
        item = np.repeat(np.arange(len(counts)), counts)
        return spans.shingle_hash(self.words, size)[at] if len(at) else np.empty(0, U), item, at - self.of[item]


def word_chances(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> np.ndarray:
    """Share of each word of a sorted vocabulary among all words of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(Lookup(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(sent.value.table), dtype=np.int64), 0
        for b in batches:
            for _, h, _ in _words(b.column(0)):
                counts += np.bincount(sent.value.find(h)[1], minlength=len(counts))
                total += len(h)
        at = np.append(np.flatnonzero(counts), -1)
        yield pa.record_batch([pa.array(at), pa.array(np.append(counts[at[:-1]], total))], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    out = np.full(len(vocabulary), 0.5)
    for k, n in found.items():
        if k >= 0:
            out[k] = n
    return out / max(found.get(-1, 0), 1)


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each window with its item."""
    best = np.zeros(len(windows))
    order = np.argsort([len(w) * len(i) for w, i in zip(windows, items, strict=True)], kind="stable")
    for lo in range(0, len(order), 256):
        own = order[lo : lo + 256]
        width, height = max(len(items[k]) for k in own), max(len(windows[k]) for k in own)
        item, window = np.zeros((len(own), width), dtype=U), np.ones((len(own), height), dtype=U)
        used_i, used_w = np.zeros((len(own), width), dtype=bool), np.zeros((len(own), height), dtype=bool)
        for r, k in enumerate(own):
            item[r, : len(items[k])], used_i[r, : len(items[k])] = items[k], True
            window[r, : len(windows[k])], used_w[r, : len(windows[k])] = windows[k], True
        h, top = np.zeros((len(own), width + 1)), np.zeros(len(own))
        slope = PENALTY * np.arange(width + 1)
        for i in range(height):
            same = (item == window[:, i, None]) & used_i & used_w[:, i, None]
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(same, 1.0, -PENALTY), h[:, 1:] - PENALTY)
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(top, h.max(axis=1), out=top)
        best[own] = top
    return best


@dataclass
class Index:
    """What the executors need of a block: its items and its seeds by size.

    A table has seed hashes, and for each the begin of its places; items, places in them, and whether the
    seed counts only in a document of that many words.
    """

    items: Items
    tables: list[tuple[int, Lookup, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    least_score: float


def build_index(docs: DataFrame, rows: list[tuple[int, str | None]], least_score: float, chance: float, text_col: str) -> Index:
    items = Items.read(rows)
    vocabulary = np.unique(items.words)
    log_p = np.log(word_chances(docs, vocabulary, text_col))[np.searchsorted(vocabulary, items.words)] if len(vocabulary) else np.empty(0)
    index = []
    for size in SEED_SIZES:
        h, item, place = items.seeds(size)
        if size == 1:
            alone = np.diff(items.of)[item] == 1
            h, item, place = h[alone], item[alone], place[alone]
        first = items.of[item] + place
        index.append([h, item, place, sum(log_p[first + j] for j in range(size)) <= math.log(chance) if len(h) else np.empty(0, bool)])
    usable = np.zeros(len(items.ids), dtype=bool)
    for _, item, _, rare in index:
        usable[item[rare]] = True
    tables = []
    for size, (h, item, place, rare) in zip(SEED_SIZES, index, strict=True):
        keep = rare | ~usable[item]
        h, item, place, whole = h[keep], item[keep], place[keep], ~rare[keep] & (size == 1)
        order = np.argsort(h, kind="stable")
        unique, begin = np.unique(h[order], return_index=True)
        tables.append((size, Lookup(unique), np.append(begin, len(h)), item[order], place[order], whole[order]))
    return Index(items, tables, least_score)


def leaks_of(column: pa.Array, index: Index) -> list[tuple[int, int, float, int]]:
    """Row, item, score and first word of every leak in a column of whole texts."""
    items, out = index.items, []
    lengths = np.diff(items.of)
    for row, h, of in _words(column):
        hits = []
        for size, lookup, begins, item, place, whole in index.tables:
            at, seed = lookup.find(spans.shingle_hash(h, size))
            doc = np.searchsorted(of, at, "right") - 1
            inside = at + size <= of[doc + 1]
            at, seed, doc = at[inside], seed[inside], doc[inside]
            counts = begins[seed + 1] - begins[seed]
            post = spans.ranges(begins[seed], counts)
            doc, at = np.repeat(doc, counts), np.repeat(at, counts)
            counted = ~whole[post] | (of[doc + 1] - of[doc] == size)
            hits.append(np.stack((doc, item[post], at - place[post]))[:, counted])
        hits = np.unique(np.concatenate(hits, axis=1), axis=1)
        if not hits.shape[1]:
            continue
        # Windows around the diagonals of one document and item; close ones become one.
        doc, item, diagonal = hits
        slack = np.maximum(4, lengths[item] // 3)
        lo = np.maximum(diagonal - slack, of[doc])
        hi = np.minimum(diagonal + lengths[item] + slack, of[doc + 1])
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new)) - 1
        windows = [h[x:y] for x, y in zip(lo[begin], hi[end], strict=True)]
        scores = align(windows, [items.words[items.of[i] : items.of[i + 1]] for i in item[begin]])
        rows = zip(doc[begin], item[begin], scores, lo[begin] - of[doc[begin]], strict=True)
        out += [(row + int(d), int(i), float(s / lengths[i]), int(x)) for d, i, s, x in rows if s >= index.least_score * lengths[i]]
    return out


def _indexes(docs: DataFrame, benchmark: DataFrame, least_score: float, chance: float, text_col: str) -> Iterator[Index]:
    """An index for each block of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        yield build_index(docs, rows, least_score, chance, text_col)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, chance: float = 2e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, first_word``: one row for each document and item that it leaks.

    ``score`` is the best alignment score as a share of the item's words; ``first_word`` is where the
    first aligned window of the document begins.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _indexes(docs, benchmark, least_score, chance, text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if found := leaks_of(b.column(1), sent.value):
                    at, item, score, word = zip(*found, strict=True)
                    ids = sent.value.items.ids
                    yield pa.record_batch(
                        [b.column(0).take(pa.array(at)), pa.array([ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(word, pa.int64())],
                        names=["doc_id", "item_id", "score", "first_word"],
                    )

        found = rows.mapInArrow(lean(run), "doc_id long, item_id long, score double, first_word long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"), F.min("first_word").alias("first_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, chance: float = 2e-6) -> DataFrame:
    """``docs`` without the documents that leak an item, in one pass for each block, without a shuffle."""
    at, kept = docs.columns.index("text"), docs
    for index in _indexes(docs, benchmark, least_score, chance, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[row for row, _, _, _ in leaks_of(b.column(at), sent.value)]] = False
                yield b.filter(pa.array(keep))

        kept = kept.mapInArrow(lean(run), docs.schema)
    return kept
