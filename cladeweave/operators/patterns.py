"""Distinct columns of alignments with weights, and bootstrap replicates as vectors of weights.

Columns that hold the same states in all sequences say the same; a replicate that draws columns with replacement is then
a weight for each distinct column, and no replicate is written out.  Columns are told apart by two 64-bit hashes of their states other than
gaps, made in the tasks that read the sequences and combined by exclusive or, so a column never becomes a row of its cells.  A sequence
that is shorter than its marker ends in gaps; ``ord`` names the sequences of a marker; rows without marker have no replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.operators import distances, sites

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _column_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``marker, pos, h1, h2`` of each marker's columns over the sequences of a batch."""
    for b in batches:
        held: dict = {}
        for marker, own, seq in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            codes = np.frombuffer((seq or "").encode("utf-32-le"), "<u4").astype(U)
            table = held.get(marker)
            if table is None or table.shape[1] < len(codes):
                wide = np.zeros((2, len(codes)), U)
                if table is not None:
                    wide[:, : table.shape[1]] = table
                table = held[marker] = wide
            start = _mixed(np.array([own], dtype=np.int64).view(U))
            for lane in range(2):
                table[lane, : len(codes)] ^= np.where(codes == U(45), U(0), _mixed(start + codes * U(2) + U(lane)))
        for marker, table in held.items():
            n = table.shape[1]
            yield pa.record_batch([pa.array([marker] * n, pa.string()), pa.array(np.arange(1, n + 1, dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in table)], names=["marker", "pos", "h1", "h2"])


def site_patterns(aln: DataFrame) -> DataFrame:
    """``marker, pos, pattern``: for every column the first one of the marker that is the same."""
    rows = aln.select(F.col("marker").cast("string").alias("marker"), F.col("ord").cast("long"), F.upper("seq"))
    columns = rows.mapInArrow(_column_hashes, "marker string, pos int, h1 long, h2 long").groupBy("marker", "pos").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    own = F.coalesce(F.xxhash64("marker"), F.lit(0)).alias("m")
    first = columns.groupBy("marker", "h1", "h2").agg(F.min("pos").alias("pattern")).select(own, "h1", "h2", "pattern")
    return columns.select("marker", own, "pos", "h1", "h2").join(first, ["m", "h1", "h2"]).select("marker", "pos", "pattern")


def replicate_weights(aln: DataFrame, patterns: DataFrame, replicates: int, seed: int = 111) -> DataFrame:
    """``marker, replicate, pattern, weight``: how often each replicate of ``sites.bootstrap_columns`` draws each pattern."""
    drawn = sites.bootstrap_columns(aln, replicates, seed).select("marker", "replicate", F.explode("columns").alias("pos"))
    counts = drawn.groupBy("marker", "replicate", "pos").agg(F.count("*").alias("n"))
    met = counts.join(patterns, ["marker", "pos"])
    return met.groupBy("marker", "replicate", "pattern").agg(F.sum("n").alias("weight"))


def replicate_statistics(aln: DataFrame, weights: DataFrame) -> DataFrame:
    """``marker, replicate`` and the statistics of ``sites.marker_stats`` of each replicate, from one profile and its weights."""
    held = aln.where("seq IS NOT NULL")
    taxa = held.groupBy("marker").agg(F.count("*").alias("n_taxa"))
    profile = sites.site_table(held).withColumnRenamed("pos", "pattern")
    met = weights.join(profile, ["marker", "pattern"]).join(taxa, "marker")
    full = met.withColumn("gaps", F.col("gaps") + F.col("n_taxa") - F.col("cells")).withColumn("cells", F.col("n_taxa"))
    return full.groupBy("marker", "replicate", "n_taxa").agg(*sites.concatenation_columns(F.col("weight")))


def _placed_with_weights(aln: DataFrame, patterns: DataFrame, weights: DataFrame, block: int) -> DataFrame:
    """``distances.placed`` of sequences that are reduced to their distinct columns; a pair of blocks gets the weights of all replicates before them (side -1)."""
    firsts = patterns.select("marker", "pos", (F.col("pos") == F.col("pattern")).alias("keep"))
    short = sites.keep_columns(aln.where("seq IS NOT NULL"), firsts)
    placed = distances.placed(short, block)
    # Weights in the order of the patterns, zero where a replicate has none of a pattern.
    every = patterns.where("pos = pattern").select("marker", "pattern").join(weights.select("marker", "replicate").distinct(), "marker")
    dense = every.join(weights, ["marker", "replicate", "pattern"], "left").groupBy("marker", "replicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("pattern", F.coalesce("weight", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("w"))
    groups = placed.select("marker", "lo", "hi").distinct().join(dense, "marker")
    none = F.lit(None)
    rows = placed.select("marker", "lo", "hi", "side", "ord", "seq", none.cast("array<long>").alias("w")).unionByName(groups.select("marker", "lo", "hi", F.lit(-1).alias("side"), F.col("replicate").cast("long").alias("ord"), none.cast("string").alias("seq"), "w"))
    # By number, as in ``placed``.
    partitions = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "marker", "lo", "hi").sortWithinPartitions("marker", "lo", "hi", "side", "ord")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """Key, replicates with their weights, and rows ``side, ord, seq`` of each pair of blocks."""
    key, drawn, held = None, [], []
    for b in batches:
        for marker, lo, hi, side, o, seq, w in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if (marker, lo, hi) != key:
                if held:
                    yield key, drawn, held
                key, drawn, held = (marker, lo, hi), [], []
            if side < 0:
                drawn.append((o, w))
            else:
                held.append((side, o, seq or ""))
    if held:
        yield key, drawn, held


def replicate_pair_counts(aln: DataFrame, patterns: DataFrame, weights: DataFrame, block: int = 512) -> DataFrame:
    """``marker, replicate, ord_i, ord_j, valid, transitions, transversions``: as ``distances.pair_counts`` of every replicate.

    Sequences travel once, reduced to their distinct columns; a pair of blocks gets the weights of all replicates with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, drawn, held in _groups(batches):
            for replicate, w in drawn:
                for first, second, counts in distances.pairs_of(key, held, np.asarray(w, dtype=np.float32)):
                    yield pa.record_batch(
                        [pa.array([key[0]] * len(first), pa.string()), pa.array([replicate] * len(first), pa.int64()), pa.array(first), pa.array(second), *map(pa.array, counts)],
                        names=["marker", "replicate", "ord_i", "ord_j", "valid", "transitions", "transversions"],
                    )

    ordered = _placed_with_weights(aln, patterns, weights, block)
    return ordered.mapInArrow(run, "marker string, replicate long, ord_i long, ord_j long, valid long, transitions long, transversions long")


def replicate_pair_distances(aln: DataFrame, patterns: DataFrame, weights: DataFrame, which: str, gamma_shape: float = 1.0, block: int = 4096, places: int | None = None) -> DataFrame:
    """``marker, replicate, ord_i, ord_j`` and a distance: as ``distances.pair_distances`` of every replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, drawn, held in _groups(batches):
            codes, ords, sides = distances.coded(held)
            for replicate, w in drawn:
                # A sequence that is shorter than its marker ends in gaps, and so do those of a pair of blocks.
                used = np.asarray(w, dtype=np.int64)[: codes.shape[1]]
                for first, second, packed, packing in distances.packed_parts(codes, ords, sides, key[1] == key[2], which != "jc69", used):
                    yield distances.part_of([key[0], replicate], key[1] == key[2], first, second, distances.looked_up(packing, packed, which, gamma_shape, places))

    ordered = _placed_with_weights(aln, patterns, weights, block)
    return distances.one_by_one(ordered.mapInArrow(run, f"marker string, replicate long, {distances.PARTS}"), ["marker", "replicate"], which)
