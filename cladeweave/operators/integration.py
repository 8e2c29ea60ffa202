"""Integration of sequence headers with accession metadata: acceptance, audits, selection.

``headers``: ``marker_key, source_branch, species, fasta_name``; ``metadata``: ``species, marker_key,
sid, is_outgroup``.  The left join fans out where a species has several accessions of a marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.functions import names


def raw_records(headers: DataFrame, metadata: DataFrame) -> DataFrame:
    return headers.join(metadata, ["species", "marker_key"], "left")


def unmatched(raw: DataFrame) -> DataFrame:
    return raw.where("sid IS NULL").select("marker_key", "source_branch", "species", "fasta_name").distinct()


def accepted_species(checklist: DataFrame, name: str = "pureName", compat: bool = False) -> DataFrame:
    squished = F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")
    return checklist.where(names.is_accepted_name(name, compat)).select(names.normalize_species(squished).alias("species")).distinct()


def with_acceptance(raw: DataFrame, accepted: DataFrame, metadata: DataFrame) -> DataFrame:
    """Membership flags (never null) and the record status."""
    outgroup = metadata.where("is_outgroup").select("species").distinct().withColumn("_out", F.lit(True))
    df = raw.join(accepted.withColumn("_acc", F.lit(True)), "species", "left").join(outgroup, "species", "left")
    df = df.select(
        *raw.columns,
        F.col("sid").isNotNull().alias("matched_to_metadata"),
        F.col("_acc").isNotNull().alias("accepted_in_checklist"),
        F.col("_out").isNotNull().alias("is_outgroup_species"),
        (F.col("_acc").isNotNull() | F.col("_out").isNotNull()).alias("accepted_or_outgroup"),
        F.when(F.col("source_branch") == "ingroup", F.col("_acc").isNotNull()).alias("matched_to_checklist"),
    )
    status = (
        F.when(~F.col("matched_to_metadata"), "unmatched_metadata")
        .when(F.col("source_branch") == "outgroup", "accepted_outgroup")
        .when(F.col("accepted_in_checklist"), "accepted_ingroup")
        .when(F.col("source_branch") == "ingroup", "rejected_ingroup")
        .otherwise("other")
    )
    return df.withColumn("record_status", status)


def _duplicate_counts(df: DataFrame, *more) -> DataFrame:
    inside = F.col("source_branch") == "ingroup"
    return (
        df.where("species IS NOT NULL AND marker_key IS NOT NULL")
        .groupBy("marker_key", "species")
        .agg(
            F.count("*").alias("n_records_total"),
            F.count_if(inside).alias("n_records_ingroup"),
            F.count_if(F.col("source_branch") == "outgroup").alias("n_records_outgroup"),
            F.count_if("accepted_or_outgroup").alias("n_records_accepted"),
            F.count_if(inside & ~F.col("accepted_or_outgroup")).alias("n_records_rejected"),
            F.countDistinct("accepted_or_outgroup").alias("n_classes"),
            *more,
        )
    )


def _duplicate_class(mixed: str, ingroup: str, outgroup: str, other: str):
    n, i, o = (F.col(f"n_records_{x}") for x in ("total", "ingroup", "outgroup"))
    return F.when(n <= 1, "unique").when((i > 0) & (o > 0), mixed).when(i > 1, ingroup).when(o > 1, outgroup).otherwise(other)


def duplicate_groups(df: DataFrame) -> DataFrame:
    return _duplicate_counts(df).select(
        "*",
        (F.col("n_classes") > 1).alias("classification_conflict"),
        _duplicate_class("duplicate_mixed", "duplicate_ingroup", "duplicate_outgroup", "duplicate_other").alias("duplicate_class"),
        (F.col("n_records_total") > 1).alias("is_duplicate_species_marker"),
    )


def sequence_registry(df: DataFrame, groups: DataFrame) -> DataFrame:
    more = groups.select("marker_key", "species", "n_records_total", "n_records_ingroup", "n_records_outgroup", "classification_conflict", "duplicate_class", "is_duplicate_species_marker")
    return df.join(more, ["marker_key", "species"], "left")


def select_records(df: DataFrame) -> DataFrame:
    """One record for each species and marker: accepted, then outgroup, then smallest accession and header."""
    kept = ("source_branch", "accepted_in_checklist", "is_outgroup_species", "accepted_or_outgroup")
    order = F.struct(~F.col("accepted_or_outgroup"), ~F.col("is_outgroup_species"), "sid", "fasta_name", "source_branch")
    best = df.where("species IS NOT NULL AND marker_key IS NOT NULL AND sid IS NOT NULL").groupBy("species", "marker_key")
    best = best.agg(F.min_by(F.struct("sid", "fasta_name", *kept), order).alias("r"))
    return best.select("species", "marker_key", "r.*")


def marker_matrix(selected: DataFrame, markers: list[str]) -> DataFrame:
    """Accepted species by marker, accessions as cells."""
    kind = F.when(F.col("is_outgroup_species"), "outgroup").otherwise("ingroup").alias("species_class")
    return selected.where("accepted_or_outgroup").select("species", kind, "marker_key", "sid").groupBy("species", "species_class").pivot("marker_key", markers).agg(F.min("sid"))


def duplicate_resolution(df: DataFrame, selected: DataFrame) -> DataFrame:
    label = F.when(F.col("accepted_or_outgroup"), "accepted_or_outgroup").otherwise("rejected")
    groups = _duplicate_counts(
        df, names.unique_sorted("sid").alias("sid_candidates"), names.unique_sorted("fasta_name").alias("fasta_candidates"), names.unique_sorted("source_branch").alias("source_candidates"), names.unique_sorted(label).alias("accepted_status_candidates")
    ).where("n_records_total > 1")
    chosen = selected.select("marker_key", "species", F.col("sid").alias("sid_selected"), F.col("fasta_name").alias("fasta_selected"), F.col("source_branch").alias("source_selected"), F.col("accepted_or_outgroup").alias("selected_accepted_or_outgroup"))
    out = groups.withColumn("classification_conflict", F.col("n_classes") > 1).withColumn("duplicate_class", _duplicate_class("mixed_ingroup_outgroup", "ingroup_only", "outgroup_only", "other")).drop("n_classes")
    return out.join(chosen, ["marker_key", "species"], "left")


def header_map(df: DataFrame, selected: DataFrame) -> DataFrame:
    """First non-null header of each selected accession (smallest, so that it is defined)."""
    known = df.where("sid IS NOT NULL AND fasta_name IS NOT NULL AND species IS NOT NULL").select("marker_key", "sid", "fasta_name", "species", "source_branch").distinct()
    keys = ["species", "marker_key", "sid", "source_branch"]
    return selected.where("accepted_or_outgroup").select(*keys).join(known, keys, "left").groupBy(*keys).agg(F.min("fasta_name").alias("fasta_name"))


def exported_records(headers: DataFrame, mapped: DataFrame) -> DataFrame:
    """Sequences that leave integration: headers of a marker that are selected somewhere in it."""
    kept = mapped.where("fasta_name IS NOT NULL")
    out = headers.select("marker_key", "fasta_name", "species").join(kept.select("marker_key", "fasta_name").distinct(), ["marker_key", "fasta_name"], "left_semi")
    return out.join(kept.select("marker_key", "species", "fasta_name", "source_branch"), ["marker_key", "species", "fasta_name"], "left")


def _composition(df: DataFrame, stage: str, group, record: str) -> DataFrame:
    """Counts by group and for all groups in one pass."""
    out = df.withColumn("_g", group).groupingSets([["marker_key", "_g"], ["marker_key"]], "marker_key", "_g")
    out = out.agg(F.countDistinct("species").alias("n_species"), F.countDistinct(record).alias("n_records"), F.grouping("_g").alias("_all"))
    return out.select("marker_key", F.lit(stage).alias("stage"), F.when(F.col("_all") == 1, "total").otherwise(F.col("_g")).alias("group"), "n_species", "n_records")


def taxon_composition(df: DataFrame, selected: DataFrame, exported: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_outgroup_species"), "outgroup").otherwise("ingroup")
    branch = F.when(F.col("source_branch") == "outgroup", "outgroup").otherwise("ingroup")
    raw = _composition(df, "raw", F.col("source_branch"), "fasta_name")
    final = _composition(selected.where("accepted_or_outgroup"), "selected", kind, "sid")
    return raw.unionByName(final).unionByName(_composition(exported, "exported", branch, "fasta_name"))


def integration_summary(df: DataFrame, groups: DataFrame, selected: DataFrame, exported: DataFrame) -> DataFrame:
    """Per marker: raw, duplicate, selected and exported numbers and retained percentages."""
    inside, outside, acc = F.col("source_branch") == "ingroup", F.col("source_branch") == "outgroup", F.col("accepted_in_checklist")
    raw = df.groupBy("marker_key").agg(
        F.countDistinct("fasta_name").alias("n_records_raw_total"), F.countDistinct(F.when(inside, F.col("fasta_name"))).alias("n_records_raw_ingroup"), F.countDistinct(F.when(outside, F.col("fasta_name"))).alias("n_records_raw_outgroup"),
        F.countDistinct("species").alias("n_species_raw_total"), F.countDistinct(F.when(inside, F.col("species"))).alias("n_species_raw_ingroup"), F.countDistinct(F.when(outside, F.col("species"))).alias("n_species_raw_outgroup"),
        F.countDistinct(F.when(inside & acc, F.col("species"))).alias("n_species_raw_accepted_ingroup"), F.countDistinct(F.when(inside & ~acc, F.col("species"))).alias("n_species_raw_rejected_ingroup"),
    )
    excess = lambda c: F.sum(F.greatest(F.col(c) - 1, F.lit(0)))
    mixed = (F.col("n_records_ingroup") > 0) & (F.col("n_records_outgroup") > 0)
    duplicated = groups.groupBy("marker_key").agg(
        F.count_if(F.col("n_records_total") > 1).alias("n_species_marker_duplicated"), excess("n_records_total").alias("n_duplicate_records_excess_total"), excess("n_records_ingroup").alias("n_duplicate_records_excess_ingroup"),
        excess("n_records_outgroup").alias("n_duplicate_records_excess_outgroup"), F.sum(F.when(mixed, F.col("n_records_total") - 1).otherwise(0)).alias("n_duplicate_records_excess_mixed"), F.count_if("classification_conflict").alias("n_classification_conflicts"),
    )
    out = F.col("is_outgroup_species")
    final = selected.where("accepted_or_outgroup")
    chosen = final.groupBy("marker_key").agg(
        F.countDistinct("species").alias("n_species_selected_total"), F.countDistinct(F.when(~out, F.col("species"))).alias("n_species_selected_ingroup"),
        F.countDistinct(F.when(out, F.col("species"))).alias("n_species_selected_outgroup"), F.countDistinct("sid").alias("n_records_selected_total"),
    )
    known = final.select("marker_key", "species", "source_branch", "is_outgroup_species").distinct()
    left = exported.join(known, ["marker_key", "species", "source_branch"], "left").groupBy("marker_key").agg(
        F.countDistinct("fasta_name").alias("n_sequences_exported"), F.countDistinct("species").alias("n_species_exported_total"),
        F.countDistinct(F.when(~out, F.col("species"))).alias("n_species_exported_ingroup"), F.countDistinct(F.when(out, F.col("species"))).alias("n_species_exported_outgroup"),
    )
    joined = raw.join(duplicated, "marker_key", "left").join(chosen, "marker_key", "left").join(left, "marker_key", "left")
    filled = joined.select("marker_key", *(F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "marker_key"))
    pct = lambda a, b: F.round(100 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)
    return filled.select(
        "*", pct("n_species_raw_accepted_ingroup", "n_species_raw_ingroup").alias("pct_species_raw_accepted_ingroup"), pct("n_species_exported_total", "n_species_raw_total").alias("pct_species_retained_from_raw"),
        pct("n_sequences_exported", "n_records_raw_total").alias("pct_records_retained_from_raw"),
    )
