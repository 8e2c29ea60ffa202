"""Supermatrix, partition coordinates, occupancy and partition files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.functions import names


def name_crosswalk(headers: DataFrame, name: str = "original_name") -> DataFrame:
    return headers.select("marker", F.col(name).alias("original_name"), names.clean_taxon_name(name).alias("cleaned_name"))


def marker_ranges(aln: DataFrame, collation: str | None = "UNICODE_CI") -> DataFrame:
    """1-based coordinates of the markers in the supermatrix, in case-insensitive order of names.

    There is one row for each marker, so the running sum's single window partition is small.
    """
    sizes = aln.groupBy("marker").agg(F.max(F.length("seq")).cast("long").alias("length"))
    order = [F.collate("marker", collation), F.col("marker")] if collation else [F.col("marker")]
    end = F.sum("length").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("marker", (end - F.col("length") + 1).alias("start"), end.alias("end"))


def supermatrix(aln: DataFrame, ranges: DataFrame) -> DataFrame:
    """``name, seq``: every taxon over all markers, gaps where it has no sequence.

    The cross product is the result itself: taxa times the (short) table of markers.
    """
    grid = aln.select("name").distinct().crossJoin(ranges)
    first = aln.groupBy("marker", "name").agg(F.min_by("seq", "ord").alias("seq"))
    width = F.col("end") - F.col("start") + 1
    cells = grid.join(first, ["marker", "name"], "left").select("name", "start", F.rpad(F.coalesce("seq", F.lit("")), width.cast("int"), F.lit("-")).alias("seq"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "seq"))), lambda c: c["seq"])
    return cells.groupBy("name").agg(F.array_join(ordered, "").alias("seq"))


def full_markers(aln: DataFrame, ranges: DataFrame) -> DataFrame:
    """``marker, name, ord, seq``: every marker with all taxa, gaps where a taxon has no sequence, in the order of names."""
    width = F.col("end") - F.col("start") + 1
    grid = aln.select("name").distinct().crossJoin(ranges.select("marker", width.cast("int").alias("width")))  # the result itself
    first = aln.groupBy("marker", "name").agg(F.min_by("seq", "ord").alias("seq"))
    return grid.join(first, ["marker", "name"], "left").select("marker", "name", F.col("name").alias("ord"), F.rpad(F.coalesce("seq", F.lit("")), F.col("width"), F.lit("-")).alias("seq"))


def partition_files(ranges: DataFrame, alignment: str) -> dict[str, DataFrame]:
    """``ord, line`` of the partition files of four programs, by file name."""
    lines = partition_lines(ranges).withColumn("ord", F.format_string("1%020d", "start"))
    of = lambda name: lines.where(F.col("format") == name).select("ord", "line")
    spark = ranges.sparkSession
    fixed = lambda first, text: spark.createDataFrame([(f"{first}{k:03d}", x) for k, x in enumerate(text)], "ord string, line string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "marker"))), lambda x: x["marker"])
    combined = ranges.agg(F.count("*").alias("n"), F.array_join(ordered, ", ").alias("all")).select(F.lit("2000").alias("ord"), F.concat(F.lit("   partition combined = "), F.col("n").cast("string"), F.lit(": "), "all", F.lit(";")).alias("line"))
    # Sections of a PartitionFinder 2 configuration and of a MrBayes block.
    before = [f"alignment = {alignment};", "branchlengths = linked;", "models = all;", "model_selection = AICc;", "[data_blocks]"]
    return {
        "partition_raxml_ng.txt": of("raxml"),
        "partition_iqtree.part": of("iqtree"),
        "partition_partitionfinder.cfg": fixed("0", before).unionByName(of("partitionfinder")).unionByName(fixed("2", ["[schemes]", "search = greedy;"])),
        "partition_mrbayes.nex": fixed("0", ["#nexus", "begin mrbayes;"]).unionByName(of("mrbayes")).unionByName(combined).unionByName(fixed("3", ["   set partition = combined;", "end;"])),
    }


def occupancy(headers: DataFrame, n_markers: int) -> DataFrame:
    """Markers of each species and their share of all markers."""
    return headers.groupBy("species").agg(F.count("*").alias("retained_markers"), F.round(100 * F.count("*") / n_markers, 2).alias("pct_markers"))


def occupancy_matrix(headers: DataFrame, markers: list[str]) -> DataFrame:
    """Species by marker matrix of accessions; ``-`` where a species lacks a marker."""
    wide = headers.groupBy("species").pivot("marker", markers).agg(F.min_by("sid", "ord"))
    return wide.select("species", *(F.coalesce(F.col(f"`{m}`"), F.lit("-")).alias(m) for m in markers))


def partition_lines(ranges: DataFrame) -> DataFrame:
    """One line of each partition format for each marker: ``format, marker, line``."""
    where = (F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    formats = {
        "raxml": F.concat(F.lit("DNA, "), "marker", F.lit(" = "), *where),
        "iqtree": F.concat(F.lit("DNA, "), "marker", F.lit(" = "), *where),
        "partitionfinder": F.concat("marker", F.lit(" = "), *where, F.lit(";")),
        "mrbayes": F.concat(F.lit("   charset "), "marker", F.lit(" = "), *where, F.lit(";")),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("format"), c.alias("line")) for n, c in formats.items())))
    return ranges.select("marker", "start", pairs.alias("p")).select("p.format", "marker", "start", "p.line")


def clean_partition(lines: DataFrame, column: str = "line") -> DataFrame:
    """Model names before the first comma replaced by ``DNA``."""
    return lines.withColumn(column, F.regexp_replace(column, "^[^,]+,", "DNA,"))
