"""Exact Jaccard similarity join of word-shingle sets as a metric-space join.

The Jaccard distance ``d = 1 - |x & y| / |x | y|`` is a metric.  Two documents link when
``d <= r`` with ``r = 1 - threshold``.

**Why the pivots of the first level are slices.**  Whole documents are poor first pivots: two
unrelated documents have distance 1 to nearly every pivot, so all of them tie and every window holds
everything (figures are in the README).  The first level therefore takes as pivots the slices of
documents: the universe of shingle hashes is cut into ``K`` ranges, and a slice of a document is the
set of its shingles in one range.  A document lies in the region of each of its slices.  If
``d(x, y) <= r`` then ``|x ^ y| <= D = (1 - t) / t * min(|x|, |y|)``, so with ``K > D`` ranges at
least one slice is the same set in both and the pair meets in its region: nothing is lost.  ``K``
follows from the size class, and a document also visits the classes of all smaller sizes that a
partner may have.  Slices that are empty count only where a document has no more than ``D`` others.

**Windows.**  Two documents of a region can only link if their sizes allow it and if the L1 distance
of their count vectors (shingles counted in hash ranges, more of them for longer texts) is at most
``D``: the map from sets to count vectors does not enlarge differences, so this window loses nothing.
A region's members are dealt into blocks; each block is cut into the connected parts of its window graph, balls around the parts
(centre, radius, sizes) stand for them, and balls of different blocks are joined unless the triangle
inequality parts them.  Parts that share documents are joined to one region.

**Voronoi regions and recursion.**  The documents of each region are joined exactly, by pivots among
them.  Every document goes to its nearest pivot ``p`` and is replicated to pivot ``q`` if
``d(x, q) - d(x, p) <= 2r``; by the triangle inequality every link lies within the cell of one of its
ends.  Documents that link with their pivot are one component already, and only those within ``r`` of
the distance of a document that does not are compared further.  Cells recurse with new pivots until they
are leaves; cells that do not separate are compared pair by pair.  Regions of up to ``memory_nodes``
documents are joined so in a task; larger ones in rounds over all tasks, first their distances to the
pivots, then their cells as new regions.

Equal sets are one node throughout, so a group of copies leaves a task as one document.  Sets are the
same if 128 bits of hashes agree; shingles are told apart by 64 bits.  (Two different shingles of one
pair of documents are taken for one with a chance of about ``n**2 / 2**64``.)

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and
is its own component.  A text with fewer words than a shingle has its whole word sequence as its one
shingle.  Equal rows link with each other.  A row without id links only with rows of an equal set,
and its component is null if those have no id either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm import spans
from cladeweave.llm.components import components
from cladeweave.llm.shared import LAST_ID, bitmap_bits, ceil_div, cut, discard, join_counted, keep_decided, lean, require, split_by_ids

U = np.uint64
#: Bits of a slice's signature.  Slices of one signature only meet, so a chance match costs a comparison and no link; of so many
#: rows, random bytes that do not compress, this is what the join shuffles most.
SIGNATURE_BITS = 40
#: Shingles of all sets for a round of the slices' shuffle, and rounds at most.
ROUND_SHINGLES, MOST_ROUNDS = 1 << 25, 8
HOT_ROWS = 1 << 12
MOST_HOT = 100_000
CHUNK_ROWS, CHUNK_SHARE = 1 << 20, 1 << 12
MEMORY_NODES = 1024
MEMORY_SHINGLES = 1 << 21
BLOCK_NODES = 512
PIVOTS = 8
MOST_PIVOTS = 1024
LEAF = 4
SENT_ROWS = 500_000
MOST_CLASHES = 10_000
CLASS_GROWTH = 1.6


@dataclass(frozen=True)
class Slicing:
    """Size classes and range counts for links with ``den * |x & y| >= num * |x | y|``."""

    num: int
    den: int
    bounds: list[int] = field(default_factory=lambda: [1])
    counts: list[int] = field(default_factory=list)

    def differences(self, size: int) -> int:
        """Most shingles in which a set of ``size`` and a linked one at least as large differ."""
        return (self.den - self.num) * size // self.num

    def _reach(self, size: int) -> None:
        while self.bounds[-1] <= size:
            low = self.bounds[-1]
            high = max(low + 1, int(low * CLASS_GROWTH) + 1)
            most = self.differences(high - 1)
            self.counts.append(most + 3 + most // 25)
            self.bounds.append(high)

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """``(class, ranges, D)`` of every class in which a set of ``size`` may have a partner."""
        self._reach(size)
        smallest = ceil_div(self.num * size, self.den)
        lo = int(np.searchsorted(self.bounds, smallest, "right")) - 1
        hi = int(np.searchsorted(self.bounds, size, "right")) - 1
        found = [(c, self.counts[c], self.differences(min(size, self.bounds[c + 1] - 1))) for c in range(lo, hi + 1)]
        return [x for x in found if x[2] > 0]


def set_key(h: np.ndarray, seed: int = 0xC2B2AE3D27D4EB4F) -> int:
    """A 64-bit key of a sorted shingle set."""
    terms = np.append(spans.mix64(h ^ U(seed)), spans.mix64(np.array([len(h)], dtype=U)))
    return int(spans.mix64(terms.sum(dtype=U, keepdims=True)).view(np.int64)[0])


@dataclass(frozen=True)
class Keys:
    """What tells sets apart: shingles of ``k`` words, a key of ``bits`` bits, and the keys that clash.

    Every set has a second, independent key.  Where sets of one key differ in it, their nodes are named by
    both.  Fewer bits only make clashes, for tests.
    """

    k: int
    bits: int = 64
    clash: frozenset[int] = frozenset()

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        return shingle_sets(column, self.k)

    def first(self, h: np.ndarray) -> int:
        return set_key(h) >> (64 - self.bits)

    def second(self, h: np.ndarray) -> int:
        return set_key(h, 0x8EBC6AF09C88C6E3)

    def node(self, h: np.ndarray) -> int:
        key = self.first(h)
        if key in self.clash:
            both = np.array([key, self.second(h)], dtype=np.int64).view(U)
            key = int(spans.mix64(both[:1] + spans.mix64(both[1:])).view(np.int64)[0])
        return key


def slice_signatures(h: np.ndarray, slicing: Slicing) -> np.ndarray:
    """Signatures of all slices of a sorted shingle set, over its classes."""
    out = []
    mixed = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(spans.mix64(h ^ U(0x27D4EB2F165667C5)), out=mixed[1:])
    high = h >> U(32)
    for c, ranges, most in slicing.classes(len(h)):
        at = (high * U(ranges)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sums = mixed[np.append(first[1:], len(h))] - mixed[first]
        places = at[first]
        if len(first) <= most:  # only then can a link rest on empty slices alone
            empty = np.setdiff1d(np.arange(ranges, dtype=U), places, assume_unique=True)
            sums, places = np.concatenate((sums, np.zeros(len(empty), dtype=U))), np.concatenate((places, empty))
        out.append(spans.mix64(sums + spans.mix64((U(c) << U(40)) + places + U(1))))
    return (np.concatenate(out) >> U(64 - SIGNATURE_BITS)).view(np.int64) if out else np.empty(0, np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text: A-Z lower-cased, words cut at white space."""
    buf, offs = spans.text_buffers(column)
    for lo, hi in spans.slices(offs):
        o = offs[lo : hi + 1] - offs[lo]
        part = buf[offs[lo] : offs[hi]]
        starts, ends, of = spans.word_spans(part, o, spans.WHITE)
        words = spans.span_hash(spans.prefix_hash(part, True), starts, ends)
        shingles = spans.shingle_hash(words, k)
        for a, z in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if z - a >= k:
                h = np.sort(shingles[a : z - k + 1])
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            else:
                yield spans.whole_hash(words[a:z]) if z > a else np.empty(0, U)


def _document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _nodes(rows: DataFrame, keys: Keys, slicing: Slicing) -> tuple[DataFrame, Keys]:
    """``doc_id, node, n, sigs``: the key and size of each document's set, and the packed signatures of its slices; and the keys with those that clash.

    Texts are cut into shingles once for all of these.  Equal sets of a task bring their signatures once.  Of the order of ``documents**2 / 2**65``
    keys clash by chance, so the driver gets no more than a few.
    """

    def described(keys: Keys) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                found: list[tuple] = []
                for h in keys.sets(b.column(1)):
                    node, sigs = keys.node(h), None
                    if len(h) and node not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(node)
                        sigs = slice_signatures(h, slicing).tobytes()
                    found.append((node, keys.second(h), len(h), sigs))
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "node", "second", "n", "sigs"])

        return cut(rows.mapInArrow(lean(run), "doc_id long, node long, second long, n long, sigs binary"))

    made = described(keys)
    clash = made.where("n > 0").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a != b").select("node")
    found = clash.limit(MOST_CLASHES + 1).collect()
    require(len(found) <= MOST_CLASHES, "too many set keys clash")
    if not found:
        return made, keys
    discard(made)
    keys = replace(keys, clash=frozenset(r[0] for r in found))
    return described(keys), keys


def _signatures(folder: DataFrame, rounds: int = 1, turn: int = 0) -> DataFrame:
    """``sig, node`` of each slice whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            if rounds > 1:
                sigs = [x[x % rounds == turn] for x in sigs]
            if sigs:
                node = np.repeat(b.column(0).to_numpy(), [len(x) for x in sigs])
                yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(node)], names=["sig", "node"])

    return folder.where("sigs IS NOT NULL").select("node", "sigs").mapInArrow(lean(run), "sig long, node long")


def _hot(folder: DataFrame, least: int) -> DataFrame:
    """``sig, salts``: signatures with ``least`` rows or more, and over how many shares each is dealt; ``MOST_HOT`` rows at most.

    Tasks count their signatures in chunks and report those with more than ``1 / CHUNK_SHARE`` of a chunk, so
    what has no such share anywhere isn't found; it fills no task either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            sig, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(2, size // CHUNK_SHARE)
            return pa.record_batch([pa.array(sig[many]), pa.array(n[many].astype(np.int64))], names=["sig", "n"])

        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.int64))
                size += len(held[-1])
            if size >= CHUNK_ROWS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = folder.where("sigs IS NOT NULL").select("sigs").mapInArrow(lean(run), "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "sig").limit(MOST_HOT).select("sig", F.ceil(F.col("n") / least).cast("long").alias("salts"))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))), len(sorted_keys))


def _meeting(batches: Iterator[pa.RecordBatch], block_nodes: int) -> Iterator[pa.RecordBatch]:
    """``region, block, many, node``: members of the slices that more than one node has, in sorted rows.

    Slices with the same members make one region.  Members of a region are dealt into blocks of
    ``block_nodes``; a run that is longer than a few blocks leaves block by block, so memory holds no
    whole hot slice.  Rows that are marked ``hot`` are a share of a slice whose others are in other tasks: all leave
    in blocks, which are numbered by task.
    """
    hold = _hold(block_nodes)
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    hot_blocks = 0
    seen: set[int] = set()
    carry_sig, carry_node = np.empty(0, np.int64), np.empty(0, np.int64)
    begun: list[int] = []  # the slice that has left in part, and its blocks so far

    def made(region: np.ndarray, block: np.ndarray, many: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(region), pa.array(block), pa.array(many), pa.array(node)], names=["region", "block", "many", "node"])

    def part_of(sig: int, node: np.ndarray, first: int) -> pa.RecordBatch:
        name = spans.mix64(np.array([sig], dtype=np.int64).view(U)).view(np.int64)[0]
        return made(np.full(len(node), name), first + np.arange(len(node)) // block_nodes, np.ones(len(node), dtype=bool), node)

    def complete(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
        runs = _runs(sig)
        sizes = np.diff(runs)
        members = np.add.reduceat(spans.mix64(node.view(U)), runs[:-1]) ^ sizes.astype(U)
        _, first = np.unique(members, return_index=True)
        first = first[sizes[first] > 1]
        fresh = [k for k, m in zip(first.tolist(), members[first].tolist(), strict=True) if m not in seen]
        if len(seen) > 1 << 18:
            seen.clear()
        seen.update(members[fresh].tolist())
        if not fresh:
            return None
        chosen = np.array(fresh)
        at = spans.ranges(runs[chosen], sizes[chosen])
        inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
        return made(np.repeat(members[chosen].view(np.int64), sizes[chosen]), inner // block_nodes, np.repeat(sizes[chosen] > block_nodes, sizes[chosen]), node[at])

    hot_sig, hot_node = np.empty(0, np.int64), np.empty(0, np.int64)

    def hot_part(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal hot_sig, hot_node, hot_blocks
        runs = _runs(hot_sig)
        for a, z in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            over = last or z < len(hot_sig)
            full = z if over else a + (z - a - 1) // block_nodes * block_nodes  # the newest row stays, to drop its repeats
            if full > a:
                yield part_of(int(hot_sig[a]), hot_node[a:full], (task << 32) + hot_blocks)
                hot_blocks += ceil_div(full - a, block_nodes)
            if not over:
                hot_sig, hot_node = hot_sig[full:], hot_node[full:]
                return
        hot_sig, hot_node = hot_sig[:0], hot_node[:0]

    for b in batches:
        if b.num_columns > 2 and b.num_rows:
            hot = b.column(2)
            share = b.filter(hot)
            hot_sig, hot_node = np.concatenate((hot_sig, share.column(0).to_numpy())), np.concatenate((hot_node, share.column(1).to_numpy()))
            new = np.concatenate(([True], (hot_sig[1:] != hot_sig[:-1]) | (hot_node[1:] != hot_node[:-1]))) if len(hot_sig) else np.empty(0, bool)
            hot_sig, hot_node = hot_sig[new], hot_node[new]
            yield from hot_part(False)
            b = b.filter(pc.invert(hot))
        if not b.num_rows:
            continue
        sig, node = np.concatenate((carry_sig, b.column(0).to_numpy())), np.concatenate((carry_node, b.column(1).to_numpy()))
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        last = int(_runs(sig)[-2])
        if begun:
            end = int(np.searchsorted(sig != begun[0], True)) if sig[0] == begun[0] else 0
            if end < len(sig):  # the long run is over
                if end:
                    yield part_of(begun[0], node[:end], begun[1])
                begun = []
                sig, node, last = sig[end:], node[end:], last - end
        if last and (out := complete(sig[:last], node[:last])) is not None:
            yield out
        carry_sig, carry_node = sig[last:], node[last:]
        if len(carry_sig) >= hold:
            full = (len(carry_sig) - 1) // block_nodes * block_nodes  # the newest row stays, to drop its repeats
            first = begun[1] if begun else 0
            yield part_of(int(carry_sig[0]), carry_node[:full], first)
            begun = [int(carry_sig[0]), first + full // block_nodes]
            carry_sig, carry_node = carry_sig[full:], carry_node[full:]
    yield from hot_part(True)
    if begun and len(carry_sig):
        yield part_of(begun[0], carry_node, begun[1])
    elif len(carry_sig) and (out := complete(carry_sig, carry_node)) is not None:
        yield out


def _hold(block_nodes: int) -> int:
    """Rows of a slice from which on it leaves block by block."""
    return max(HOT_ROWS, 4 * block_nodes)


def _members(folder: DataFrame, block_nodes: int, rounds: int = 1) -> DataFrame:
    """``region, block, many, node`` of all documents whose slices meet; a hot slice is dealt over shares by node.

    Each of the ``rounds`` takes a share of the signatures, so that no more than this share of the slices is on disk as a shuffle.
    A round has as much fewer partitions: rows of one node follow each other in a partition and compress, the more the fewer there are.
    """
    spark = folder.sparkSession
    hot, all_parts = F.broadcast(cut(_hot(folder, _hold(block_nodes)))), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_of = [max(ceil_div(all_parts, rounds), min(all_parts, spark.sparkContext.defaultParallelism))] if rounds > 1 else []

    def met(turn: int) -> DataFrame:
        rows = _signatures(folder, rounds, turn).join(hot, "sig", "left")
        rows = rows.select("sig", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(-1)).alias("share"), "node").repartition(*parts_of, "sig", "share")
        dealt = rows.sortWithinPartitions("sig", "share", "node").select("sig", "node", (F.col("share") >= 0).alias("hot"))
        return dealt.mapInArrow(lean(lambda batches: _meeting(batches, block_nodes)), "region long, block long, many boolean, node long")

    if rounds == 1:
        return cut(met(0).distinct())
    parts = [cut(met(turn)) for turn in range(rounds)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = cut(out.distinct())
    discard(*parts)
    return out


def count_vector(h: np.ndarray) -> bytes:
    """Shingles in each of ``V`` hash ranges, an eighth to a quarter as many ranges as shingles (16 at least).

    Unrelated sets of ``n`` shingles then differ by about ``1.1 * sqrt(n * V)``, well above the ``D`` of a
    link whatever ``n`` is.  The counts stand in 1, 2 or 4 bytes each; the first byte says which.
    """
    bits = max(4, (len(h) // 8).bit_length())
    return _packed(np.bincount((h >> U(64 - bits)).astype(np.int64), minlength=1 << bits))


def _packed(counts: np.ndarray) -> bytes:
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _vectors_of(packed: list[bytes]) -> np.ndarray:
    """Count vectors as rows of the coarsest resolution among them; sums of neighbours do not enlarge differences."""
    rows = [np.frombuffer(v, f"<u{v[0]}", offset=1) for v in packed]
    width = min(map(len, rows))
    return np.stack([x if len(x) == width else x.reshape(width, -1).sum(axis=1) for x in rows]).astype(np.int32)


@dataclass
class Balls:
    """Balls in the space of count vectors: centre, radius, and the least and greatest size inside."""

    node: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    vectors: np.ndarray

    def gather(self, slicing: Slicing) -> tuple[list[tuple[int, int]], Balls]:
        """Edges that span the connected parts of the window graph, and one ball around each part.

        Two balls are joined unless sizes or the triangle inequality show that no document of one can
        link with a document of the other, so no link leaves a part.
        """
        order = np.argsort(self.low, kind="stable")
        node, low, high, radius = (x[order].astype(np.int64) for x in (self.node, self.low, self.high, self.radius))
        vectors = self.vectors[order].astype(np.int32)
        left, found, balls = np.arange(len(node)), [], []
        while len(left):
            first, frontier = left[0], [left[0]]
            part, left = [left[0]], left[1:]
            while frontier and len(left):
                x = frontier.pop()
                hi = np.searchsorted(low[left], slicing.den * int(high[x]) // slicing.num, "right")
                near = left[:hi]
                wide = slicing.num * low[x] <= slicing.den * high[near]
                reach = radius[x] + radius[near] + (slicing.den - slicing.num) * np.minimum(high[near], high[x]) // slicing.num
                close = wide & (np.abs(vectors[near] - vectors[x]).sum(axis=1) <= reach)
                if close.any():
                    met = near[close]
                    found += [(int(node[x]), int(node[y])) for y in met]
                    frontier += list(met)
                    part += list(met)
                    left = np.concatenate((near[~close], left[hi:]))
            around = np.abs(vectors[part] - vectors[first]).sum(axis=1) + radius[part]
            balls.append((first, low[part].min(), high[part].max(), around.max()))
        at, lows, highs, radii = (np.array(x, dtype=np.int64) for x in zip(*balls, strict=True)) if balls else (np.empty(0, np.int64),) * 4
        return found, Balls(node[at], lows, highs, radii, vectors[at])


BALLS = "region long, block long, node long, low long, high long, radius long, vector binary"
GATHERED = "a long, b long, region long, node long, low long, high long, radius long, vector binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns of ``BALLS`` of each (region, block), from rows in that order."""
    carry: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns, vectors = [b.column(k).to_numpy() for k in range(6)], b.column(6).to_pylist()
        if carry:
            columns, vectors = [np.concatenate((x, y)) for x, y in zip(carry[:-1], columns, strict=True)], carry[-1] + vectors
        region, block = columns[:2]
        begins = [0, *(np.flatnonzero((region[1:] != region[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for lo, hi in zip(begins, begins[1:], strict=False):
            yield [*(c[lo:hi] for c in columns), _vectors_of(vectors[lo:hi])]
        carry = [*(c[begins[-1] :] for c in columns), vectors[begins[-1] :]]
    if carry:
        yield [*carry[:-1], _vectors_of(carry[-1])]


def _gather(balls: DataFrame, slicing: Slicing, keep: bool) -> DataFrame:
    """Edges of the parts of every block and, with ``keep``, the balls around the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, kept = [], []

        def flush() -> pa.RecordBatch:
            pairs, m = np.array(edges, dtype=np.int64).reshape(-1, 2), sum(len(x.node) for _, x in kept)
            joined = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((np.full(len(x.node), r), x.node, x.low, x.high, x.radius) for r, x in kept), strict=True)] or [np.empty(0, np.int64)] * 5
            vectors = [_packed(v) for _, x in kept for v in x.vectors]
            rows = [pa.concat_arrays([pa.array(pairs[:, k]), pa.nulls(m, pa.int64())]) for k in range(2)]
            rows += [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(x)]) for x in joined]
            rows.append(pa.array([None] * len(pairs) + vectors, pa.binary()))
            return pa.record_batch(rows, names=["a", "b", "region", "node", "low", "high", "radius", "vector"])

        for region, _, *columns in _blocks(batches):
            found, around = Balls(*columns).gather(slicing)
            edges += found
            if keep:
                kept.append((region[0], around))
            if len(edges) + len(kept) >= 1 << 14:
                yield flush()
                edges, kept = [], []
        if edges or kept:
            yield flush()

    return balls.repartition("region", "block").sortWithinPartitions("region", "block").mapInArrow(lean(run), GATHERED)


def _window_edges(members: DataFrame, described: DataFrame, slicing: Slicing, block_nodes: int) -> DataFrame:
    """``a, b``: edges that span the connected parts of the window graph of every region.

    A region's blocks are gathered apart; where a region has several, the balls around their parts are
    dealt into new blocks, until one block holds a region or balls stop to merge.  Then all pairs of the
    blocks that are left are gathered, each pair in a group of its own.  No group holds more than two blocks.
    """
    columns = [c.split()[0] for c in BALLS.split(", ")]

    def balls(which: str) -> DataFrame:
        joined = members.where(which).select("region", "block", "node").join(described, "node")
        return joined.select("region", "block", "node", F.col("n").alias("low"), F.col("n").alias("high"), F.lit(0).cast("long").alias("radius"), "vector")

    edges = [cut(_gather(balls("NOT many"), slicing, False).select("a", "b"))]
    left, deal, before = balls("many"), 0, members.where("many").count()
    while before:
        found = cut(_gather(left, slicing, True))
        edges.append(found.where("a IS NOT NULL").select("a", "b"))
        parts = found.where("region IS NOT NULL").drop("a", "b")
        blocks = parts.groupBy("region").agg(F.ceil(F.count("*") / block_nodes).cast("long").alias("blocks"))
        dealt = parts.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node", F.lit(deal)), F.col("blocks")))
        # A region that one block holds is gathered once more below and is done.
        now, deal = parts.count(), deal + 1
        if now > before // 2:
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
            pairs = dealt.withColumn("other", other).withColumn("block", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
            edges.append(cut(_gather(pairs.select(columns), slicing, False).select("a", "b")))
            break
        edges.append(cut(_gather(dealt.where("blocks = 1").select(columns), slicing, False).select("a", "b")))
        left = dealt.where("blocks > 1").select(columns)
        before = left.count()
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


class Sets:
    """Shingle sets in memory, as places in the sorted list of all their shingles."""

    def __init__(self, sets: list[np.ndarray], slicing: Slicing):
        self.slicing = slicing
        self.sizes = np.array([len(h) for h in sets], dtype=np.int64)
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = at.astype(np.int32)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.marked = np.zeros(len(values), dtype=np.int32)
        self.label = list(range(len(sets)))
        self.edges: list[tuple[int, int]] = []
        self.cells = self.replicas = self.compared = 0

    def root(self, x: int) -> int:
        while self.label[x] != x:
            self.label[x] = self.label[self.label[x]]
            x = self.label[x]
        return x

    def of(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``sets`` and their places one after the other, with begins."""
        sizes = self.sizes[sets]
        if sets[-1] - sets[0] == len(sets) - 1:  # cells are sorted
            places = self.at[self.begins[sets[0]] : self.begins[sets[-1] + 1]]
        else:
            places = self.at[spans.ranges(self.begins[sets], sizes)]
        return sets, places, np.concatenate(([0], np.cumsum(sizes)))

    def distances(self, x: int, others: tuple[np.ndarray, np.ndarray, np.ndarray], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Distance of ``x`` to the sets ``others``, from the ``first`` on, and whether they link; links enter the components."""
        sets, places, begins = others
        own = self.at[self.begins[x] : self.begins[x + 1]]
        self.marked[own] = 1
        common = np.add.reduceat(self.marked[places[begins[first] :]], begins[first:-1] - begins[first])
        self.marked[own] = 0
        self.compared += len(common)
        union = self.sizes[x] + self.sizes[sets[first:]] - common
        linked = self.slicing.den * common >= self.slicing.num * union
        for y in sets[first:][linked].tolist():
            a, b = self.root(x), self.root(y)
            if a != b:
                self.label[max(a, b)] = min(a, b)
                self.edges.append((x, y))
        return 1 - common / union, linked

    def compare(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """All pairs within ``left``, or between ``left`` and ``right``, but of sets whose others are all in their component."""
        others = self.of(left if right is None else right)
        for k, x in enumerate(left.tolist()):
            first, own = (k + 1 if right is None else 0), self.root(x)
            if any(self.root(y) != own for y in others[0][first:].tolist()):
                self.distances(x, others, first)

    def voronoi(self, pivots: int, leaf: int) -> None:
        """Join all sets: regions of pivots, windows by the triangle inequality, recursion.

        Pivots are chosen farthest first, ``pivots`` or as many more as it takes until every set is nearer
        than ``1 - 2r`` to one (unrelated pivots then lie outside its window).  A set belongs to its nearest pivot's region and is replicated
        to that of pivot ``q`` if ``d(x, q) - d(x, p) <= 2r``.  In the region of ``p`` sets that link with
        ``p`` are one component already; of them only the boundary, ``d(x, p) >= d(u, p) - r`` for a set
        ``u`` that does not link, stays to be compared.  Pivots are done.  A region whose cells would
        hold more than half of its pairs again is compared directly.
        """
        r = (self.slicing.den - self.slicing.num) / self.slicing.den + 1e-9
        waiting = [np.arange(len(self.sizes))]
        while waiting:
            cell = waiting.pop()
            first = self.root(int(cell[0]))
            if all(self.root(y) == first for y in cell.tolist()):
                continue
            if len(cell) <= leaf:
                self.compare(cell)
                continue
            chosen, away, links, most = [0], [], [], max(2, len(cell) // 4)
            held = self.of(cell)
            while True:
                d, linked = self.distances(int(cell[chosen[-1]]), held)
                away.append(d)
                links.append(linked)
                nearest = np.min(away, axis=0)
                if len(chosen) == most or nearest.max() <= r or (len(chosen) >= pivots and nearest.max() < 1 - 2 * r):
                    break
                chosen.append(int(nearest.argmax()))
            left = np.ones(len(cell), dtype=bool)
            left[chosen] = False
            cells = []
            for d, linked in zip(away, links, strict=True):
                inside = left & (d - nearest <= 2 * r)
                self.cells += 1
                self.replicas += int((inside & (d > nearest)).sum())
                if (free := inside & ~linked).any():
                    cells.append(cell[free | (inside & (d >= d[free].min() - r))])
            if sum(len(c) ** 2 for c in cells) > len(cell) ** 2 // 2:
                self.compare(cell[left])
            else:
                waiting += cells


def _sets_of(b: pa.RecordBatch, keys: Keys, node: int, text: int) -> Iterator[np.ndarray | None]:
    """The set of each row's text; none where it is not the row's node (another text of a repeated id)."""
    for want, h in zip(b.column(node).to_pylist(), keys.sets(b.column(text)), strict=True):
        yield h if len(h) and keys.node(h) == want else None


def _join_in_memory(rows: DataFrame, keys: Keys, slicing: Slicing, pivots: int, leaf: int) -> DataFrame:
    """``a, b``: spanning links of each group of ``(group, side, node, text)``.

    Where a group has rows of side 1, only pairs of different sides are compared.  Texts travel, as they
    are smaller and compress; their sets are made here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides, nodes, sets = None, [], [], []

        def flush() -> pa.RecordBatch:
            join = Sets(sets, slicing)
            if 1 in sides:
                split = sides.index(1)
                join.compare(np.arange(split), np.arange(split, len(sets)))
            else:
                join.voronoi(pivots, leaf)
            return pa.record_batch([pa.array([nodes[x] for x, _ in join.edges], pa.int64()), pa.array([nodes[y] for _, y in join.edges], pa.int64())], names=["a", "b"])

        for b in batches:
            for g, side, node, h in zip(*(b.column(j).to_pylist() for j in range(3)), _sets_of(b, keys, 2, 3), strict=True):
                if g != group and nodes:
                    yield flush()
                    sides, nodes, sets = [], [], []
                elif h is None or (nodes and nodes[-1] == node and sides[-1] == side):
                    continue  # another document with the same set
                group = g
                if h is not None:
                    sides.append(side)
                    nodes.append(node)
                    sets.append(h)
        if nodes:
            yield flush()

    ordered = rows.select("group", "side", "node", "text").repartition("group").sortWithinPartitions("group", "side", "node")
    return ordered.mapInArrow(lean(run), "a long, b long")


def _voronoi_round(placed: DataFrame, texts: DataFrame, keys: Keys, slicing: Slicing, pivots: int, memory_nodes: int, level: int) -> DataFrame:
    """``region, pivot, node, n, d, linked``: the cells of every large region, replicas included.

    An eighth of a region's nodes, between ``pivots`` and ``MOST_PIVOTS`` and no more than a task can hold,
    are pivots, by a hash.  A region is dealt over tasks by another hash; every task of a region gets the
    pivots first and then streams its sets.  A node that is in the windows of many pivots (it is far from
    all of them) has one row without pivot instead.
    """
    count, held = F.count("*"), F.ceil(MEMORY_SHINGLES * F.count("*") / F.sum("n"))
    number = F.least(F.greatest(F.lit(pivots), F.floor(count / 8)), F.lit(MOST_PIVOTS), F.greatest(F.lit(2), held))
    tasks = F.greatest(F.ceil(count / memory_nodes), F.ceil(F.sum("n") / MEMORY_SHINGLES)).cast("long")
    about = cut(placed.groupBy("region").agg(F.greatest(F.lit(1), F.floor(count / number)).alias("step"), tasks.alias("tasks"), F.min_by("node", F.xxhash64("node", F.lit(level))).alias("first")))
    known = placed.join(about, "region")
    is_pivot = (F.pmod(F.xxhash64("node", F.lit(level)), F.col("step")) == 0) | (F.col("node") == F.col("first"))
    own = known.select("region", F.pmod(F.xxhash64("node", F.lit(-1 - level)), F.col("tasks")).alias("task"), F.lit(1).alias("kind"), "node")
    asked = known.where(is_pivot).select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "node")
    window = 2 * (slicing.den - slicing.num) / slicing.den + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chosen, last, index = None, [], None, None
        for b in batches:
            out = []
            for region, task, kind, node, h in zip(*(b.column(j).to_pylist() for j in range(4)), _sets_of(b, keys, 3, 4), strict=True):
                if place != (region, task):
                    place, chosen, last, index = (region, task), [], None, None
                if h is None or last == (kind, node):
                    continue  # another document with the same set
                last = (kind, node)
                if kind == 0:
                    chosen.append((node, h))
                    continue
                if index is None:
                    sizes = np.array([len(p) for _, p in chosen])
                    values, owner = np.concatenate([p for _, p in chosen]), np.repeat(np.arange(len(chosen)), sizes)
                    order = np.argsort(values, kind="stable")
                    index = values[order], owner[order], sizes
                    del values, owner, order
                lo, hi = np.searchsorted(index[0], h, "left"), np.searchsorted(index[0], h, "right")
                common = np.bincount(index[1][spans.ranges(lo, hi - lo)], minlength=len(chosen))
                union = index[2] + len(h) - common
                d = 1 - common / union
                links = slicing.den * common >= slicing.num * union
                inside = np.flatnonzero(d - d.min() <= window)
                if len(inside) > max(4, math.isqrt(len(chosen))):
                    out.append((region, None, node, len(h), float(d.min()), False))
                    inside = np.flatnonzero(links)
                out += [(region, chosen[j][0], node, len(h), float(d[j]), bool(links[j])) for j in inside]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["region", "pivot", "node", "n", "d", "linked"])

    rows = own.unionByName(asked).join(texts, "node").select("region", "task", "kind", "node", "text")
    rows = rows.repartition("region", "task").sortWithinPartitions("region", "task", "kind", "node")
    return rows.mapInArrow(lean(run), "region long, pivot long, node long, n long, d double, linked boolean")


def _join_large(placed: DataFrame, texts: DataFrame, keys: Keys, slicing: Slicing, pivots: int, leaf: int, memory_nodes: int) -> DataFrame:
    """``a, b``: spanning links of large regions ``placed(region, node, n)``, by rounds of Voronoi cells.

    As in ``Sets.voronoi``, of the sets that link with their pivot only the boundary stays, and pivots are
    done.  Cells that fit are joined in memory; all others get new pivots in the next round.  Nodes that
    are far from all pivots, and all nodes of a region whose cells would hold more than half of its pairs
    again, are compared with every node of the region within the size window, in pairs of blocks.
    """
    r = (slicing.den - slicing.num) / slicing.den + 1e-9
    links, level = [], 0
    while True:
        every = cut(_voronoi_round(placed, texts, keys, slicing, pivots, memory_nodes, level))
        links.append(every.where("linked AND node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        done = every.where("pivot IS NOT NULL AND node = pivot").select("region", "node")
        rest = every.join(done, ["region", "node"], "left_anti")
        far = rest.where("pivot IS NULL").select("region", "node")
        near = rest.join(far, ["region", "node"], "left_anti")
        free = near.where("NOT linked").groupBy("region", "pivot").agg(F.min("d").alias("least"))
        inside = near.join(free, ["region", "pivot"]).where(~F.col("linked") | (F.col("d") >= F.col("least") - r))
        inside = cut(inside.select("region", F.xxhash64("region", "pivot", F.lit(level)).alias("cell"), "node", "n"))
        sizes = inside.groupBy("region", "cell").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
        pairs = sizes.groupBy("region").agg(F.sum(F.col("nodes").cast("double") * F.col("nodes")).alias("pairs"))
        parents = placed.groupBy("region").agg(F.count("*").cast("double").alias("before"))
        stuck = cut(pairs.join(parents, "region").where("pairs > before * before / 2").select("region"))
        small = (F.col("nodes") <= memory_nodes) & (F.col("shingles") <= MEMORY_SHINGLES)
        marked = cut(inside.join(sizes.select("cell", small.alias("small")), "cell").join(stuck, "region", "left_anti"))
        one = marked.where("small").select(F.col("cell").cast("string").alias("group"), F.lit(0).alias("side"), "node")
        links.append(cut(_join_in_memory(one.join(texts, "node"), keys, slicing, pivots, leaf)))
        left = placed.join(done, ["region", "node"], "left_anti")
        direct = cut(left.join(far, ["region", "node"], "left_semi").unionByName(left.join(stuck, "region", "left_semi")).distinct())
        if not direct.isEmpty():
            links.append(cut(_join_blocks(direct, left.join(direct.select("region").distinct(), "region", "left_semi"), texts, keys, slicing, max(1, memory_nodes // 4))))
        placed = marked.where("NOT small").select(F.col("cell").alias("region"), "node", "n")
        if placed.isEmpty():
            break
        level += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _join_blocks(direct: DataFrame, every: DataFrame, texts: DataFrame, keys: Keys, slicing: Slicing, block_nodes: int) -> DataFrame:
    """``a, b``: spanning links between the nodes ``direct`` and ``every`` (both ``region, node, n``) of regions.

    Both are cut into blocks by size class and hash; blocks whose sizes allow links meet, each pair in a
    group of its own.
    """
    size_class = F.floor(F.log(F.col("n")) / math.log(slicing.den / slicing.num + 1e-9)).alias("size_class")

    def blocks(rows: DataFrame) -> DataFrame:
        sized = rows.select("region", "node", "n", size_class)
        parts = F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") * 4 / MEMORY_SHINGLES)).alias("parts")
        counts = sized.groupBy("region", "size_class").agg(parts)
        return cut(sized.join(counts, ["region", "size_class"]).select("region", "size_class", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node"))

    here, there = blocks(direct), blocks(every)
    names = ["region", "size_class", "part"]
    x, y = here.select(names).distinct().alias("x"), there.select(names).distinct().alias("y")
    near = (F.col("x.region") == F.col("y.region")) & (F.abs(F.col("x.size_class") - F.col("y.size_class")) <= 1)
    group = F.concat_ws("/", "x.region", "x.size_class", "x.part", "y.size_class", "y.part").alias("group")
    pairs = cut(x.join(y, near).select(group, F.struct("x.*").alias("one"), F.struct("y.*").alias("two")))
    sides = pairs.select("group", "one.*").join(here, names).select("group", F.lit(0).alias("side"), "node")
    sides = sides.unionByName(pairs.select("group", "two.*").join(there, names).select("group", F.lit(1).alias("side"), "node"))
    return _join_in_memory(sides.join(texts, "node"), keys, slicing, PIVOTS, LEAF)


def _chosen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted(doc_id, ...)``.

    A table of a checked size is sent to all tasks.  Beyond it a bitmap of hashed ids, of a fixed size, is
    sent (``bitmap_bits``), so that only rows that may be wanted are shuffled; a crowded bitmap lets more of them pass.
    """
    if (n := wanted.count()) <= SENT_ROWS:
        return rows.join(F.broadcast(wanted), "doc_id")
    _, maybe, key = split_by_ids(rows, F.col("doc_id"), wanted.select("doc_id"), bitmap_bits(n))
    return maybe.drop(key).join(wanted, "doc_id")


def _vectors(rows: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """``node, n, vector``: size and count vector of the documents of ``wanted(doc_id)``, and of a few others
    that the bitmap of ids lets pass; no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(keys.node(h), len(h), count_vector(h)) for h in keys.sets(b.column(0)) if len(h)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", "vector"])

    maybe = split_by_ids(rows, F.col("doc_id"), wanted.select("doc_id"), bitmap_bits(wanted.count()))[1]
    return maybe.select("text").mapInArrow(lean(run), "node long, n long, vector binary").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
    memory_nodes: int = MEMORY_NODES, block_nodes: int = BLOCK_NODES, pivots: int = PIVOTS, leaf: int = LEAF, key_bits: int = 64,
) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Documents link when ``den * |x & y| >= num * |x | y|`` over their sets of ``k``-word shingles;
    the component id is the smallest id that links reach, and that document is kept.  ``memory_nodes``
    (sets that a task joins), ``block_nodes`` (vectors that a task gathers), ``pivots``, ``leaf`` and
    ``key_bits`` change the work, never the result.
    """
    found, _ = _components_of_rows(docs, Keys(k, key_bits), num, den, id_col, text_col, memory_nodes, block_nodes, pivots, leaf)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components_of_rows(
    docs: DataFrame, keys: Keys, num: int, den: int, id_col: str, text_col: str,
    memory_nodes: int = MEMORY_NODES, block_nodes: int = BLOCK_NODES, pivots: int = PIVOTS, leaf: int = LEAF,
) -> tuple[DataFrame, Keys]:
    """Per document ``doc_id, n, component_id, node, first``: its set and the smallest ``(id, node)`` of its
    component; and the keys that name nodes."""
    slicing = Slicing(num, den)
    rows = _document_rows(docs, id_col, text_col)
    folder, keys = _nodes(rows, keys, slicing)
    keepers = cut(folder.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("docs")))
    shingles = keepers.agg(F.sum("n")).first()[0] or 0
    members = _members(folder, block_nodes, min(MOST_ROUNDS, max(1, ceil_div(shingles, ROUND_SHINGLES))))
    slim = cut(folder.drop("sigs"))
    discard(folder)
    folder = slim
    wanted = cut(keepers.join(members.select("node").distinct(), "node", "left_semi").where("doc_id IS NOT NULL"))
    # Sets are made again from the texts where they are needed: hashes are larger and do not compress.
    vectors = cut(_vectors(rows, wanted, keys))
    edges = cut(_window_edges(members, vectors, slicing, block_nodes).where("a != b").distinct())
    discard(members, vectors)
    regions = components(edges).select("node", F.col("root").alias("region"))
    discard(edges)
    placed = cut(regions.join(wanted.select("node", "doc_id", "n"), "node"))
    discard(wanted)
    sizes = placed.groupBy("region").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    small = (F.col("nodes") <= memory_nodes) & (F.col("shingles") <= MEMORY_SHINGLES)
    marked = cut(placed.join(sizes.select("region", small.alias("small")), "region").select("region", "node", "doc_id", "n", "small"))
    one = marked.where("small").select(F.col("region").cast("string").alias("group"), F.lit(0).alias("side"), "node", "doc_id")
    links = [cut(_join_in_memory(_chosen(rows, one), keys, slicing, pivots, leaf))]
    large = marked.where("NOT small").select("region", "node", "doc_id", "n")
    if not large.isEmpty():
        texts = cut(_chosen(rows, large.select("doc_id", "node")).select("node", "text"))
        links.append(cut(_join_large(large.drop("doc_id"), texts, keys, slicing, pivots, leaf, memory_nodes)))
        discard(texts)
    links = links[0].unionByName(links[-1]) if len(links) > 1 else links[0]
    labels = components(links).select("node", F.col("root").alias("label"))
    discard(placed, marked)
    name = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "node")
    tied = cut(keepers.join(labels, "node"))
    ids = cut(tied.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(name).alias("first"), F.count("*").alias("nodes")))
    named = join_counted(tied.select("label", "node", "docs"), ids, "label", "nodes", tied.count()).select("node", "docs", "component_id", "first")
    alone = keepers.join(tied.select("node"), "node", "left_anti").select("node", "docs", F.col("doc_id").alias("component_id"), name.alias("first"))
    named = cut(named.unionByName(alone))
    total = named.agg(F.sum("docs")).first()[0] or 0
    found = join_counted(folder.where("n > 0"), named, "node", "docs", total).select("doc_id", "n", "component_id", "node", "first")
    empty = folder.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "node", name.alias("first"))
    return found.union(empty), keys


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row, the one with the smallest id, of each component.

    Rows are told apart by id and set, as ids may repeat or be missing.  Rows without shingles all stay.
    """
    number = F.coalesce("doc_id", F.lit(LAST_ID))
    found, keys = _components_of_rows(docs, Keys(k), num, den, id_col, text_col)
    rows = found.where("n > 0").groupBy(number.alias("id"), "node").agg(F.max((number == F.col("first.id")) & (F.col("node") == F.col("first.node"))).alias("kept"), F.count("*").alias("rows"))
    decided = rows.where("NOT kept OR rows > 1").select("id", "node", "kept")
    return keep_decided(docs, id_col, text_col, decided, lambda texts: pa.array([keys.node(h) for h in keys.sets(texts)], pa.int64()))
