"""Hard negatives of anchors: exact integer scores by a two-dimensional block product, then top lists by tile.

Rows become blocks of ``ROWS`` and anchors blocks of ``ANCHORS``, each cut into chunks of its dimensions.  The
blocks are dealt over a grid: a chunk of an anchor block meets the same chunk of every row block in one cell of
its grid row, so anchors are sent once for each column of the grid and rows once for each row.  A cell
multiplies chunks to partial int64 tiles; a shuffle adds the tiles of all chunks.  Summed tiles are written once and
read twice: for the best rows of each anchor's own label (its positives), and then for the best rows of other
labels within the window that each positive's score opens.  Each tile gives its own top lists; windows with a
rank limit, which Spark applies before it shuffles, merge them.

Anchors are worked off in panels, so the tiles that are on disk at a time stay within ``tile_bytes`` and the windows that are
sent within ``WINDOWS``.  Blocks are shuffled to their cells without a join: their copies for each column of the grid grow with anchors
times rows, but the planner goes by the size before they are made, so it would send them from the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.llm.shared import bound_batches, ceil_div, cut, discard, lean

ROWS, ANCHORS = 4096, 128
#: Dimensions of a chunk, unless a vector would then have more than ``MOST_CHUNKS`` of them.
CHUNK, MOST_CHUNKS = 32, 8
SCALE = 256.0
TILE_BYTES = 1 << 40
#: Windows of a panel, unless one block of anchors has more.
WINDOWS = 1 << 16

_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(SCALE * x)`` of every component as an int64 matrix of ``width`` columns, and which rows count.

    Rows that are null or hold a null or non-finite component don't; shorter rows are filled with zeros.  A
    component beyond 64 bits raises.
    """
    out, ok = np.zeros((len(vectors), width)), np.ones(len(vectors), bool)
    sizes = np.array([x if x is not None else -1 for x in vectors.value_lengths().to_pylist()])
    flat = vectors.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    row = np.repeat(np.arange(len(vectors)), np.maximum(sizes, 0))
    place = np.arange(len(values)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
    bad = ~np.isfinite(values) | np.asarray(flat.is_null())
    ok[sizes < 0] = False
    ok[row[bad]] = False
    out[row, place] = np.where(bad, 0.0, np.floor(SCALE * np.where(bad, 0.0, values)))
    if np.abs(out).max(initial=0.0) >= 2.0**62:
        raise ValueError("a component times 256 does not fit into 64 bits")
    return out.astype(np.int64), ok


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in int64, exact: in doubles where every sum is below 2^53, in integers otherwise; what does not fit raises."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max((abs(x) for x in exact.ravel()), default=0) >= 1 << 63:
        raise ValueError("a score does not fit into 64 bits")
    return exact.astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<i8").tobytes()


def _ints(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<i8")


def _tile_bytes(x: np.ndarray) -> bytes:
    """Scores in 32 bits where all fit, else in 64."""
    return np.ascontiguousarray(x, dtype="<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _tile(x: pa.Scalar, n: int, m: int) -> np.ndarray:
    packed = x.as_buffer()
    return np.frombuffer(packed, "<i4" if len(packed) == 4 * n * m else "<i8").reshape(n, m)


def _blocks(rows: DataFrame, count: int, size: int, width: int, chunk: int) -> DataFrame:
    """``block, chunk, ids, labels, data``: blocks of up to ``size`` rows, sorted by id, as packed int64."""
    parts = min(ceil_div(max(count, 1), size), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, waiting = 0, [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held, waiting
            ids, labels, data = (np.concatenate([h[k] for h in held]) for k in range(3))
            at = 0
            while waiting - at >= size or (last and at < waiting):
                own = slice(at, min(at + size, waiting))
                order = np.argsort(ids[own], kind="stable")
                block = (TaskContext.get().partitionId() << 32) | made
                packed = [_bytes(data[own][order, c * chunk : (c + 1) * chunk]) for c in range(ceil_div(width, chunk))]
                n = len(packed)
                yield pa.record_batch(
                    [pa.array([block] * n), pa.array(range(n), pa.int32()), pa.array([_bytes(ids[own][order])] * n), pa.array([_bytes(labels[own][order])] * n), pa.array(packed, pa.binary())],
                    names=["block", "chunk", "ids", "labels", "data"],
                )
                made, at = made + 1, own.stop
            held, waiting = [(ids[at:], labels[at:], data[at:])], waiting - at

        for b in batches:
            data, ok = quantised(b.column(2), width)
            held.append((b.column(0).to_numpy()[ok], b.column(1).to_numpy()[ok], data[ok]))
            waiting += int(ok.sum())
            if waiting >= size:
                yield from blocks(False)
        if waiting:
            yield from blocks(True)

    return rows.repartition(parts).mapInArrow(lean(run), "block long, chunk int, ids binary, labels binary, data binary")


def _tiles(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], chunks: int) -> DataFrame:
    """``block, ids, labels, other_ids, other_labels, tile``: summed scores of each anchor block with each row block."""
    down, across = grid
    here = lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")
    left = anchors.withColumn("down", here(down)).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = rows.withColumn("across", here(across)).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    # By number: few bytes of blocks are large tiles, and partitions merged by bytes would leave cores idle.
    cell, partitions = ["down", "across", "chunk"], int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select(*cell, "side", "block", "ids", "labels", "data")
    met = both.repartition(min(partitions, 2 * down * across * chunks), *cell).sortWithinPartitions(*cell, "side")
    names = ["block", "other", "ids", "labels", "other_ids", "other_labels", "tile"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []  # the anchors of a cell come first, and a panel has few
        for b in batches:
            for k in range(b.num_rows):
                *key, side, block, ids, labels = (b.column(c)[k].as_py() for c in range(7))
                if key != own:
                    own, held = key, []
                data = _ints(b.column(7)[k]).reshape(len(ids) // 8, -1)
                if not side:
                    held.append((block, ids, labels, data.copy()))
                    continue
                for anchor_block, anchor_ids, anchor_labels, anchor_data in held:
                    kept = [x if not key[2] else None for x in (anchor_ids, anchor_labels, ids, labels)]  # one chunk brings them
                    tile = _tile_bytes(product(anchor_data, data))
                    yield pa.record_batch([pa.array([anchor_block]), pa.array([block]), *(pa.array([x], pa.binary()) for x in (*kept, tile))], names=names)

    def add(parts: pa.Table) -> pa.Table:
        kept = [next(x.as_py() for x in parts[c] if x.is_valid) for c in names[2:6]]
        n, m = len(kept[0]) // 8, len(kept[2]) // 8
        total, most = np.zeros((n, m), dtype=np.int64), 0
        for part in parts["tile"]:
            one = _tile(part, n, m)
            most += int(np.abs(one).max(initial=0))
            if most >= 1 << 63:
                raise ValueError("a score does not fit into 64 bits")
            total += one
        return pa.table([pa.array([parts["block"][0].as_py()]), *(pa.array([x], pa.binary()) for x in kept), pa.array([_tile_bytes(total)], pa.binary())], names=["block", *names[2:]])

    partial = met.mapInArrow(lean(multiply), "block long, other long, ids binary, labels binary, other_ids binary, other_labels binary, tile binary")
    return partial.groupBy("block", "other").applyInArrow(add, "block long, ids binary, labels binary, other_ids binary, other_labels binary, tile binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(block, ids, labels, other_ids, other_labels, tile, further column)`` of each tile."""
    for b in batches:
        for k in range(b.num_rows):
            block, *packed, tile = (b.column(c)[k] for c in range(6))
            ids, labels, other_ids, other_labels = (_ints(x) for x in packed)
            yield block.as_py(), ids, labels, other_ids, other_labels, _tile(tile, len(ids), len(other_ids)), b.column(6)[k].as_py() if b.num_columns > 6 else None


def _record(columns: list[list], names: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=names.split())


def _best(rows: DataFrame, by: list[str], score: str, other: str, most: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, embedding)``.

    A row's score is the inner product of its vector with the anchor's, each component floored after times 256; higher scores come
    first, ties by smaller id.  Anchors are rows whose id ``every`` divides; their positives the first ``positives`` rows of another id and the
    same label; for each, the first ``negatives`` rows of another label with ``low <= 100 * negative_score / positive_score <= high``
    (as integers, so a negative positive score opens no window).

    Rows without id, label or vector, or with a null or non-finite component, take no part; missing components count as zero.  Rows
    that repeat an id are rows of their own: candidates each, and anchors each.  An anchor without positives or negatives
    gives no rows, and so does an empty table.  A score that does not fit into 64 bits raises.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("embedding"))).first()
    if not n_anchors:
        return spark.createDataFrame([], _OUT)
    width = max(width, 1)
    chunk = max(CHUNK, ceil_div(width, MOST_CHUNKS))
    blocks = cut(_blocks(rows, n, ROWS, width, chunk))
    anchors = cut(_blocks(rows.where(is_anchor), n_anchors, ANCHORS, width, chunk))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, min(ceil_div(n_anchors, ANCHORS), round((cells * n_anchors / n) ** 0.5)))
    grid = (down, max(1, min(ceil_div(n, ROWS), ceil_div(cells, down))))
    panels = max(ceil_div(8 * n * n_anchors * (1 + ceil_div(width, chunk)), tile_bytes), ceil_div(n_anchors * positives, WINDOWS))
    panels = max(1, min(ceil_div(n_anchors, ANCHORS), panels))
    out = None
    for panel in range(panels):
        own = anchors.where(F.pmod(F.xxhash64("block", F.lit("panel")), F.lit(panels)) == panel) if panels > 1 else anchors
        tiles = cut(_tiles(own, blocks, grid, ceil_div(width, chunk)))
        windows = cut(_windows(tiles, positives))
        found = cut(_found(tiles, windows, negatives, low, high))
        discard(tiles, windows)
        out = found if out is None else out.unionByName(found)
    return out


def _windows(tiles: DataFrame, positives: int) -> DataFrame:
    """``block, windows``: the positives of the anchors of each block, ``ANCHORS * positives`` at most."""

    def own_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, other_ids, other_labels, tile, _ in _each(batches):
            columns: list[list] = [[] for _ in range(5)]
            for slot in range(len(ids)):
                may = np.flatnonzero((other_labels == labels[slot]) & (other_ids != ids[slot]))
                first = may[np.argsort(-tile[slot, may], kind="stable")[:positives]]
                for column, value in zip(columns, ([block] * len(first), [slot] * len(first), [ids[slot]] * len(first), other_ids[first], tile[slot, first]), strict=True):
                    column.extend(value)
            yield _record(columns, "block slot anchor_id positive_id positive_score")

    listed = tiles.mapInArrow(lean(own_label), "block long, slot long, anchor_id long, positive_id long, positive_score long")
    best = _best(listed, ["block", "slot"], "positive_score", "positive_id", positives, "place")
    return best.groupBy("block").agg(F.collect_list(F.struct("slot", "place", "positive_id", "positive_score")).alias("windows"))


def _found(tiles: DataFrame, windows: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The result for the anchors of some tiles and their windows, which are few enough to send."""
    met = tiles.join(F.broadcast(windows), "block").select(*tiles.columns, "windows")

    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, other_ids, other_labels, tile, opened in _each(batches):
            columns: list[list] = [[] for _ in range(8)]
            by_slot: dict[int, list] = {}
            for w in opened:
                by_slot.setdefault(w["slot"], []).append(w)
            for slot, own in by_slot.items():
                may = np.flatnonzero(other_labels != labels[slot])
                may = may[np.argsort(-tile[slot, may], kind="stable")]
                falling = -tile[slot, may]
                for w in own:
                    p = w["positive_score"]
                    least, most = -((-low * p) // 100), high * p // 100
                    begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    first = may[begin : min(end, begin + negatives)]
                    k = len(first)
                    for column, value in zip(columns, ([block] * k, [slot] * k, [w["place"]] * k, [ids[slot]] * k, [w["positive_id"]] * k, [p] * k, other_ids[first], tile[slot, first]), strict=True):
                        column.extend(value)
            yield _record(columns, "block slot place anchor_id positive_id positive_score negative_id negative_score")

    listed = met.mapInArrow(lean(other_label), "block long, slot long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _best(listed, ["block", "slot", "place"], "negative_score", "negative_id", negatives, "rank")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
