"""Per-site and per-sequence statistics of alignments.

An alignment is rows ``marker, name, ord, seq``.  Profiles, the counts of (marker, position, base), are made of whole
batches in the tasks that read them and come before everything by position, so both shuffles are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.functions import names


def explode_sites(aln: DataFrame, *keep: str) -> DataFrame:
    """``marker, pos, base`` (1-based, upper case) of every cell."""
    cells = aln.select("marker", *keep, F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base"))
    return cells.where("base != ''").withColumn("pos", F.col("pos") + 1)


#: Cells of a table of counts that a task holds; beyond it the cells that occur are sorted instead.
TABLE_CELLS = 1 << 22
#: Characters whose cells are laid out at a time; one longer sequence is laid out alone.
SLICE_CELLS = 1 << 22


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``SLICE_CELLS`` characters, so that memory does not depend on how long a batch's texts are."""
    for b in batches:
        ends = np.cumsum(pc.utf8_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_CELLS, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``marker, pos, base, n`` of the sequences of each slice; positions and bases are characters, not bytes."""
    for b in _slices(batches):
        markers = b.column(0).dictionary_encode()
        names = [*markers.dictionary.to_pylist(), None]
        marker = markers.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        lengths = pc.utf8_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(x or "" for x in b.column(1).to_pylist()).encode("utf-32-le"), "<u4")
        if not len(codes):
            continue
        bases, code = np.unique(codes, return_inverse=True)
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        width = int(lengths.max())
        cell = (np.repeat(marker, lengths).astype(np.int64) * width + pos) * len(bases) + code
        if len(names) * width * len(bases) <= TABLE_CELLS:
            counts = np.bincount(cell)
            cell = np.flatnonzero(counts)
            counts = counts[cell]
        else:
            cell, counts = np.unique(cell, return_counts=True)
        place, base = np.divmod(cell, len(bases))
        marker, pos = np.divmod(place, width)
        letters = [chr(x) for x in bases]
        yield pa.record_batch(
            [pa.array(names, pa.string()).take(pa.array(marker)), pa.array((pos + 1).astype(np.int32)), pa.array(letters).take(pa.array(base)), pa.array(counts.astype(np.int64))],
            names=["marker", "pos", "base", "n"],
        )


def base_counts(aln: DataFrame) -> DataFrame:
    """``marker, pos, base, n``: the profile of each marker, counted in tasks and added up; no cell becomes a row.

    Sequences may be ragged or in lower case; a missing one has no cells.
    """
    rows = aln.select(F.col("marker").cast("string").alias("marker"), F.upper("seq").alias("seq"))
    return rows.mapInArrow(_count_cells, "marker string, pos int, base string, n long").groupBy("marker", "pos", "base").agg(F.sum("n").alias("n"))


def _by_site(counts: DataFrame, valid: Column) -> DataFrame:
    v = F.when(valid, F.col("n"))
    return counts.groupBy("marker", "pos").agg(
        F.count(v).alias("states"), F.count_if(valid & (F.col("n") >= 2)).alias("states2"), F.sum(v).alias("valid"), F.sum("n").alias("cells"),
        F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(0)).alias("gaps"), F.sum(F.when(F.col("base") == "N", F.col("n")).otherwise(0)).alias("ns"),
        F.sum(F.when(F.col("base").isin("G", "C"), F.col("n")).otherwise(0)).alias("gc"), F.sum(F.when(F.col("base").isin("A", "C", "G", "T"), F.col("n")).otherwise(0)).alias("acgt"),
        F.sum(v * F.log(v)).alias("nlogn"),
    )


def screening_stats(aln: DataFrame) -> DataFrame:
    """Screening definitions: bases are ACGT, any other state is missing (and a gap).

    A site is informative here if it has two states and any of them twice.
    """
    sites = _by_site(base_counts(aln), F.col("base").isin("A", "C", "G", "T"))
    entropy = F.when(F.col("valid") > 0, F.log("valid") - F.col("nlogn") / F.col("valid"))
    total = F.sum("cells")
    return sites.groupBy("marker").agg(
        F.count("*").alias("total_cols"), F.count_if(F.col("states") > 0).alias("aln_len"), (1 - F.sum("acgt") / total).alias("missing"), (1 - F.sum("acgt") / total).alias("gaps"),
        (F.sum("gc") / F.nullif(F.sum("acgt"), F.lit(0))).alias("gc"), F.count_if(F.col("states") > 1).alias("var_sites"),
        F.count_if((F.col("states") > 1) & (F.col("states2") >= 1)).alias("pi_sites"), F.avg(entropy).alias("entropy"),
    )


def marker_stats(aln: DataFrame) -> DataFrame:
    """Concatenation definitions: states are all but gap and N; informative needs two states twice."""
    taxa = aln.groupBy("marker").agg(F.count("*").alias("n_taxa"))
    return site_table(aln).groupBy("marker").agg(*concatenation_columns()).join(taxa, "marker")


def site_table(aln: DataFrame) -> DataFrame:
    """``marker, pos`` and what ``concatenation_columns`` needs of each column."""
    return _by_site(base_counts(aln), ~F.col("base").isin("-", "N"))


def concatenation_columns(weight: Column | None = None) -> list[Column]:
    """Aggregates over the columns of ``site_table``, each as often as its weight says (once, if there is none)."""
    w = F.lit(1) if weight is None else weight
    total = F.sum(F.col("cells") * w)
    number = lambda which: F.sum(F.when(which, w).otherwise(0)).cast("long")
    return [
        F.sum(w).cast("long").alias("alignment_length"), F.round(100 * F.sum(F.col("ns") * w) / total, 3).alias("missing_pct"), F.round(100 * F.sum(F.col("gaps") * w) / total, 3).alias("gaps_pct"),
        F.round(100 * F.sum(F.col("gc") * w) / F.nullif(F.sum(F.col("acgt") * w), F.lit(0)), 3).alias("gc_pct"), number(F.col("states") > 1).alias("variable_sites"),
        number(F.col("states2") >= 2).alias("parsimony_informative"), number(F.col("states") == 1).alias("invariant_sites"),
    ]


def supermatrix_stats(aln: DataFrame) -> DataFrame:
    """The same over the supermatrix, whose missing markers are gaps; it is never built.

    Absent taxa only add gap cells: the number of taxa times the length, less the cells there are.
    """
    taxa = aln.agg(F.countDistinct("name").alias("n_taxa"))
    sites = site_table(aln).crossJoin(F.broadcast(taxa))
    full = sites.withColumn("gaps", F.col("gaps") + F.col("n_taxa") - F.col("cells")).withColumn("cells", F.col("n_taxa"))
    return full.groupBy("n_taxa").agg(*concatenation_columns()).withColumnRenamed("alignment_length", "total_alignment_length")


def stage_stats(aln: DataFrame) -> DataFrame:
    """Numbers, lengths and mean fractions of N and gap of the sequences of each marker."""
    n = F.length("seq")
    return aln.groupBy("marker").agg(
        F.count("*").alias("n_sequences"), F.min(n).alias("min_sequence_length"), F.max(n).alias("max_sequence_length"), F.avg(n).alias("mean_sequence_length"),
        F.avg(names.count_char("seq", "N") / F.nullif(n, F.lit(0))).alias("mean_fraction_missing"), F.avg(names.count_char("seq", "-") / F.nullif(n, F.lit(0))).alias("mean_fraction_gaps"),
    )


def keep_columns(aln: DataFrame, sites: DataFrame) -> DataFrame:
    """Alignments with only the columns that ``sites(marker, pos, keep)`` keeps.

    A marker's columns are one row, an array of flags, that meets its sequences; cells are not shuffled,
    and sequences with equal, repeated or missing names stay apart.
    """
    flags = F.transform(F.sort_array(F.collect_list(F.struct("pos", "keep"))), lambda c: c["keep"])
    masks = sites.groupBy("marker").agg(flags.alias("_mask"))
    cells = F.zip_with(F.split(F.upper("seq"), ""), "_mask", lambda base, keep: F.when(keep, base).otherwise(""))
    return aln.join(masks, "marker", "left").select("marker", "name", "ord", F.coalesce(F.array_join(cells, ""), F.lit("")).alias("seq"))


def drop_common_gaps(aln: DataFrame) -> DataFrame:
    """Alignments without the columns that are gaps in all rows."""
    held = F.max(F.col("base") != "-").alias("keep")
    return keep_columns(aln, base_counts(aln).groupBy("marker", "pos").agg(held))


def mask_columns(aln: DataFrame, max_gaps: float = 0.8, min_information: float = 0.2) -> DataFrame:
    """Alignments without uninformative columns: an own, documented rule, not an external masker's.

    A column stays if at most ``max_gaps`` of it are gaps and its information, 2 bits less its
    entropy in bits less the small-sample term 3 / (2 ln 2 n), is at least ``min_information``.
    """
    sites = _by_site(base_counts(aln), F.col("base").isin("A", "C", "G", "T"))
    bits = (F.log("valid") - F.col("nlogn") / F.col("valid")) / F.log(F.lit(2.0))
    information = 2 - bits - 3 / (2 * F.log(F.lit(2.0)) * F.col("valid"))
    keep = (F.col("gaps") / F.col("cells") <= max_gaps) & (F.col("valid") > 0) & (information >= min_information)
    return keep_columns(aln, sites.select("marker", "pos", F.coalesce(keep, F.lit(False)).alias("keep")))


def _information(sites: DataFrame) -> DataFrame:
    """``marker, pos, share, bits``: share of gaps and information of each column, corrected for small samples; a column without a base has none."""
    bits = (F.log("valid") - F.col("nlogn") / F.col("valid")) / F.log(F.lit(2.0))
    information = 2 - bits - 3 / (2 * F.log(F.lit(2.0)) * F.col("valid"))
    held = F.when(F.col("valid") > 0, F.greatest(information, F.lit(0.0))).otherwise(0.0)
    return sites.select("marker", "pos", (F.col("gaps") / F.col("cells")).alias("share"), held.alias("bits"))


def conserved_stretches(aln: DataFrame, reach: int = 3, min_information: float = 0.5, max_gaps: float = 0.5, min_length: int = 8) -> DataFrame:
    """``marker, stretch, first, last, n_sites, mean_information``: runs of columns that stay after smoothing.

    An own, documented rule.  A column's information (2 bits less its entropy in bits less the small-sample term
    ``3 / (2 ln 2 n)``, not below 0) is averaged with ``reach`` neighbours on either side; so is its share of gaps.  A column is
    conserved if the means are at least ``min_information`` and at most ``max_gaps``; runs of fewer than ``min_length`` conserved columns go.
    Windows run over the columns of a marker, one row each, whatever its number of sequences.
    """
    columns = _information(_by_site(base_counts(aln), F.col("base").isin("A", "C", "G", "T")))
    near = Window.partitionBy("marker").orderBy("pos").rowsBetween(-reach, reach)
    judged = columns.select("marker", "pos", "bits", ((F.avg("bits").over(near) >= min_information) & (F.avg("share").over(near) <= max_gaps)).alias("keep"))
    # Conserved columns whose place less their rank is the same stand side by side.
    rank = F.row_number().over(Window.partitionBy("marker").orderBy("pos"))
    runs = judged.where("keep").withColumn("island", F.col("pos") - rank)
    found = runs.groupBy("marker", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_sites"), F.avg("bits").alias("mean_information"))
    long = found.where(F.col("n_sites") >= min_length)
    number = F.row_number().over(Window.partitionBy("marker").orderBy("first"))
    return long.select("marker", number.alias("stretch"), "first", "last", "n_sites", "mean_information")


def mask_to_stretches(aln: DataFrame, **rule: float) -> DataFrame:
    """Alignments with only the columns of their ``conserved_stretches``; a marker without any has empty sequences."""
    widths = aln.groupBy("marker").agg(F.max(F.length("seq")).alias("w")).where("w > 0")
    stretches = conserved_stretches(aln, **rule).select("marker", F.explode(F.sequence("first", "last")).alias("pos"), F.lit(True).alias("keep"))
    every = widths.select("marker", F.explode(F.sequence(F.lit(1), "w")).alias("pos"))
    return keep_columns(aln, every.join(stretches, ["marker", "pos"], "left").withColumn("keep", F.coalesce("keep", F.lit(False))))


def filter_sequences(aln: DataFrame, min_non_gap: float = 0.3, max_missing: float = 0.3) -> DataFrame:
    """Every sequence with its coverage, missing fraction and which filter removes it."""
    width = aln.groupBy("marker").agg(F.max(F.length("seq")).alias("_w"))
    non_gap = F.length("seq") - names.count_char("seq", "-")
    missing = names.count_char("seq", "N") / F.nullif(F.length("seq"), F.lit(0))
    low = F.when(F.col("_w") == 0, True).otherwise(F.col("non_gap_sites_after_masking") < F.col("_w") * min_non_gap)
    high = F.coalesce(F.col("fraction_missing_after_masking") > max_missing, F.lit(True))
    df = aln.join(width, "marker").withColumn("non_gap_sites_after_masking", non_gap).withColumn("fraction_missing_after_masking", missing)
    df = df.withColumn("removed_low_coverage", low).withColumn("removed_high_missingness", high)
    return df.withColumn("removed_final", F.col("removed_low_coverage") | F.col("removed_high_missingness")).drop("_w")


STAGES = ("raw_input", "mafft_aligned", "common_gap_removed", "masked_alignment", "final_filtered")


def manifest(stages: DataFrame, filtered: DataFrame, masking: bool | None = None) -> DataFrame:
    """One wide row for each marker from ``stage`` rows of ``stage_stats`` and the filter log.

    ``masking`` says whether masking was asked for; if not given, a missing masked stage says that it was not.
    """
    values = {"n_sequences": "n_sequences", "alignment_length": "max_sequence_length", "mean_fraction_missing": "mean_fraction_missing", "mean_fraction_gaps": "mean_fraction_gaps"}
    wide = stages.groupBy("marker").pivot("stage", list(STAGES)).agg(*(F.first(c, True).alias(n) for n, c in values.items()))
    wide = wide.select("marker", *(F.col(f"{s}_{n}").alias(f"{n}_{s}") for n in values for s in STAGES))
    log = filtered.groupBy("marker").agg(F.count_if("removed_low_coverage").alias("_low"), F.count_if("removed_high_missingness").alias("_high"), F.count_if("removed_final").alias("_final"))
    c = lambda n, s: F.col(f"{n}_{s}")
    n, w = "n_sequences", "alignment_length"
    raw, aligned, common, masked, final = STAGES
    share = lambda a, b: a / F.when(b > 0, b)
    zero = lambda x: F.coalesce(x, F.lit(0))
    applied = c(n, masked).isNotNull() if masking is None else F.lit(masking)
    return wide.join(log, "marker", "left").select(
        *wide.columns,
        (c(n, raw) - c(n, final)).alias("n_sequences_removed_total"), zero(F.col("_low")).alias("n_sequences_removed_low_coverage"),
        zero(F.col("_high")).alias("n_sequences_removed_high_missingness"), zero(F.col("_final")).alias("n_sequences_removed_by_filtering"),
        (c(w, aligned) - c(w, common)).alias("n_sites_removed_by_common_gap_removal"), (c(w, common) - c(w, masked)).alias("n_sites_removed_by_masking"), (c(w, aligned) - c(w, final)).alias("n_sites_removed_total_from_mafft"),
        share(c(n, aligned), c(n, raw)).alias("pct_sequences_retained_after_mafft"), share(c(n, common), c(n, raw)).alias("pct_sequences_retained_after_common_gap_removal"),
        share(c(n, masked), c(n, raw)).alias("pct_sequences_retained_after_masking"), share(c(n, final), c(n, raw)).alias("pct_sequences_retained_final"),
        share(c(w, common), c(w, aligned)).alias("pct_sites_retained_after_common_gap_removal"), share(c(w, masked), c(w, aligned)).alias("pct_sites_retained_after_masking"), share(c(w, final), c(w, aligned)).alias("pct_sites_retained_final_vs_mafft"),
        applied.alias("masking_applied"), (zero(c(n, final)) > 0).alias("final_alignment_written"),
        F.when(zero(c(n, final)) == 0, "ZERO_RETAINED").when(~applied, "OK_NO_MASK").otherwise("OK").alias("status"),
    )


def bootstrap_columns(aln: DataFrame, replicates: int, seed: int = 111) -> DataFrame:
    """``marker, replicate, columns``: as many columns as the marker has, drawn with replacement.

    A draw is the MD5 of ``seed:replicate:marker:k`` (its first 60 bits) modulo the width, so that draws
    are independent of each other and the same on every engine.
    """
    widths = aln.groupBy("marker").agg(F.max(F.length("seq")).cast("long").alias("w")).where("w > 0")
    reps = widths.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    name = F.concat_ws(":", F.lit(seed), "replicate", F.coalesce("marker", F.lit("")))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", name, k)), 1, 15), 16, 10).cast("long")
    return reps.select("marker", "replicate", F.transform(F.sequence(F.lit(1).cast("long"), "w"), lambda k: (draw(k) % F.col("w") + 1).cast("int")).alias("columns"))


def resample_columns(aln: DataFrame, replicates: int, seed: int = 111) -> DataFrame:
    """Bootstrap replicates: the drawn columns of every sequence; all sequences of a marker share the draws.

    Sequences shorter than their marker count as ending in gaps; empty markers give no rows.
    """
    draws = bootstrap_columns(aln, replicates, seed)
    cells = F.transform("columns", lambda p: F.substr("seq", p, F.lit(1)))
    full = aln.where("seq IS NOT NULL").join(draws, aln["marker"].eqNullSafe(draws["marker"])).drop(draws["marker"]).withColumn("seq", F.rpad("seq", F.size("columns"), F.lit("-")))
    return full.select("replicate", "marker", "name", "ord", F.array_join(cells, "").alias("seq"))
