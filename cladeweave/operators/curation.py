"""Curation of cluster members: conflicts, keepers, removals, summaries.

Members are rows ``cluster_id, sid, species, parent, ord``; ``ord`` is the order of input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeweave.functions import names


def large_clusters(members: DataFrame, min_species: int, strict: bool = True) -> DataFrame:
    """Members of clusters with more than ``min_species`` species (all clusters if not ``strict``)."""
    if not strict:
        return members
    keep = members.groupBy("cluster_id").agg(F.countDistinct("species").alias("n")).where(F.col("n") > min_species)
    return members.join(keep.select("cluster_id"), "cluster_id", "left_semi")


def accession_conflicts(members: DataFrame) -> DataFrame:
    """Accessions with more than one row: number of rows, clusters and species in input order.

    Rows are first combined by (accession, cluster, species), so lists hold distinct values only.
    """
    pairs = members.groupBy("sid", "cluster_id", "species").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    out = pairs.groupBy("sid").agg(F.sum("n").alias("n_clusters"), names.unique_in_order("cluster_id", "ord", ",").alias("clusters"), names.unique_in_order("species", "ord", ",").alias("species"))
    return out.where("n_clusters > 1")


def _rules(members: DataFrame, preferred: str = "") -> DataFrame:
    """Per accession with more than one row: whether any has the preferred parent, and the smallest cluster."""
    counts = members.groupBy("sid").agg(F.count("*").alias("_n"), F.max(F.coalesce(F.col("parent") == preferred, F.lit(False))).alias("_any"), F.min("cluster_id").alias("_first"))
    return counts.where("_n > 1").drop("_n")


def conflicting_members(members: DataFrame) -> DataFrame:
    """Rows whose accession occurs more than once."""
    return members.join(_rules(members).select("sid"), "sid", "left_semi").select(*members.columns)


def keep_preferred_parent(members: DataFrame, preferred: str) -> DataFrame:
    """Ingroup rule: rows of the preferred parent if an accession has any, else its smallest cluster."""
    chosen = F.when(F.col("_any"), F.coalesce(F.col("parent") == preferred, F.lit(False))).otherwise(F.col("cluster_id") == F.col("_first"))
    return members.join(_rules(members, preferred), "sid").where(chosen).select("cluster_id", "sid").distinct()


def keep_first_ranked(members: DataFrame, preferred: str) -> DataFrame:
    """Outgroup rule: exactly one row for each accession, preferred parent first, then cluster."""
    rank = F.when(F.col("parent") == preferred, 0).otherwise(1)
    best = members.groupBy("sid").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("r"), F.col("cluster_id"))).alias("b")).where("n > 1")
    return best.select(F.col("b.cluster_id").alias("cluster_id"), "sid")


def removals(members: DataFrame, keepers: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic and manual deletions ``cluster_id, sid, reason``; the automatic reason wins."""
    automatic = conflicting_members(members).select("cluster_id", "sid").distinct().join(keepers, ["cluster_id", "sid"], "left_anti")
    both = automatic.withColumn("reason", F.lit("automatic duplicate resolution")).withColumn("_o", F.lit(0))
    both = both.unionByName(manual.select("cluster_id", "sid", "reason").withColumn("_o", F.lit(1)))
    return both.groupBy("cluster_id", "sid").agg(F.min_by("reason", F.struct("_o", "reason")).alias("reason"))


def without(members: DataFrame, deleted: DataFrame) -> DataFrame:
    return members.join(deleted.select("cluster_id", "sid"), ["cluster_id", "sid"], "left_anti")


def annotate_markers(df: DataFrame, description: str, pattern: str, dictionary: DataFrame) -> DataFrame:
    """Add ``genes_text``: markers found in a description, replaced by the dictionary if it knows them.

    The dictionary ``search, replace, ord`` is small by contract; its first row for a key counts.
    """
    first = dictionary.groupBy("search").agg(F.min_by("replace", "ord").alias("replace"))
    found = df.withColumn("_found", names.marker_text(description, pattern))
    return found.join(first, found["_found"] == first["search"], "left").withColumn("genes_text", F.coalesce("replace", "_found")).drop("_found", "search", "replace")


def cluster_markers(df: DataFrame) -> DataFrame:
    """Per cluster: markers, the commonest marker (ties: first in order) and its share of all rows."""
    per = df.groupBy("cluster_id", "genes_text").agg(F.count("*").alias("n"))
    valid = F.coalesce(F.col("genes_text") != "", F.lit(False))
    top = per.groupBy("cluster_id").agg(
        F.array_join(F.array_sort(F.collect_set("genes_text")), "; ").alias("all_markers"),
        F.count("*").alias("n_markers"),
        F.min(F.when(valid, F.struct((-F.col("n")).alias("n"), F.col("genes_text").alias("g")))).alias("t"),
        F.sum("n").alias("n_sequences"),
    )
    species = df.groupBy("cluster_id").agg(F.countDistinct("species").alias("n_species"))
    return top.join(species, "cluster_id").select(
        "cluster_id", "all_markers", "n_markers", F.coalesce("t.g", F.lit("")).alias("top_marker"), (-F.col("t.n") / F.col("n_sequences")).alias("top_marker_freq"), "n_sequences", "n_species"
    )


def species_clusters(df: DataFrame) -> DataFrame:
    """Per species: clusters in order, number of clusters."""
    pairs = df.groupBy("species", "cluster_id").agg(F.min("ord").alias("ord"))
    return pairs.groupBy("species").agg(names.unique_in_order("cluster_id", "ord", ",").alias("clusters"), F.count("cluster_id").alias("n_clusters"))


def accession_matrix(df: DataFrame, clusters: list[int]) -> DataFrame:
    """Species by cluster matrix of the first accession, empty text where there is none."""
    wide = df.groupBy("species").pivot("cluster_id", clusters).agg(F.min_by("sid", "ord"))
    return wide.select("species", *(F.coalesce(F.col(str(c)), F.lit("")).alias(f"cid_{c}") for c in clusters))


def cluster_counts(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Per cluster: species with an accession, deleted rows, and rows that are left."""
    pairs = members.where("sid != ''").groupBy("cluster_id", "species").agg(F.lit(1).alias("one"))
    n_original = pairs.groupBy("cluster_id").agg(F.count("*").alias("n_original"))
    n_removed = deleted.groupBy("cluster_id").agg(F.count("*").alias("n_removed"))
    n_final = without(members, deleted).groupBy("cluster_id").agg(F.count("*").alias("n_final"))
    out = n_original.join(n_removed, "cluster_id", "left").join(n_final, "cluster_id", "left")
    return out.select("cluster_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_original", "n_removed", "n_final")))


def marker_summary(clusters: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Cluster sizes by marker, with the species that the marker has."""
    n = F.col("n_sequences")
    sizes = clusters.groupBy("marker").agg(
        F.count("*").alias("num_clusters"), F.sum(n).alias("num_sequences"), F.avg(n).alias("mean_seq_per_cluster"), F.median(n).alias("median_seq_per_cluster"),
        F.min(n).alias("min_seq_in_cluster"), F.max(n).alias("max_seq_in_cluster"),
    )
    return sizes.join(occupancy.groupBy("marker").agg(F.countDistinct("species").alias("num_species")), "marker", "left")


def first_per_binomial(df: DataFrame, header: str, *order: str | Column) -> DataFrame:
    """The first row of each binomial in an order of rows (cluster files merged into one marker)."""
    columns = df.columns
    rest = F.struct(*columns)
    out = df.groupBy(names.first_binomial(header).alias("_b")).agg(F.min_by(rest, F.struct(*order)).alias("_r"))
    return out.select("_r.*")


def reconcile_taxa(df: DataFrame, header: str, checklist: DataFrame, name: str, compat: bool = False) -> DataFrame:
    """Sequences whose binomial is on the checklist, one for each binomial.

    Checklist names are written with blanks; ``compat`` compares them unchanged, which matches none.
    """
    listed = checklist.select((F.col(name) if compat else F.replace(F.col(name), F.lit(" "), F.lit("_"))).alias("binomial")).distinct()
    keyed = df.withColumn("binomial", names.first_binomial(header))
    return first_per_binomial(keyed.join(listed, "binomial", "left_semi"), "binomial", "ord")
