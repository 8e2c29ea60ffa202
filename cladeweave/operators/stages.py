"""Whole stages of a study: from input tables to all tables of the stage, by name.

Every function checks its inputs, builds plans and runs nothing but what it has to know (external programs
apart); ``write_tables`` writes the results.  Tables that several results read are written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.operators import clades, concatenation, curation, dating, distances, integration, sites, taxa, trees
from cladeweave.operators.guards import require_columns
from cladeweave.operators.lineage import cut
from cladeweave.sources import formats

Tables = dict[str, DataFrame]


def write_tables(tables: Tables, folder: str, mode: str = "error") -> None:
    """Each table as Parquet below ``folder``, under its name."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")


def _assemble(members: DataFrame, metadata: DataFrame, manual: DataFrame, markers: list[str], dictionary: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Tables:
    require_columns(metadata, ["sid", "description"], "metadata")
    require_columns(manual, ["cluster_id", "sid", "reason"], "manual exclusions")
    require_columns(dictionary, ["search", "replace", "ord"], "dictionary")
    described = members.join(metadata.groupBy("sid").agg(F.min("description").alias("description")), "sid", "left")
    raw = cut(curation.annotate_markers(described, "description", names.marker_pattern(markers), dictionary).drop("description"))
    removed = cut(curation.removals(raw, keep(raw), manual))
    clean = cut(curation.without(raw, removed))
    summary = curation.cluster_markers(clean)
    by_marker = clean.join(summary.select("cluster_id", F.col("top_marker").alias("marker")), "cluster_id").where("marker != ''")
    return {
        "members_raw": raw,
        "members_clean": clean,
        "cluster_summary_raw": curation.cluster_markers(raw),
        "cluster_summary_clean": summary,
        "cluster_marker_assignment": summary.select("cluster_id", "top_marker"),
        "cluster_counts": curation.cluster_counts(raw, removed),
        "species_cluster_map": curation.species_clusters(clean),
        "accession_occupancy": by_marker.select("species", F.col("marker").alias("Marker_std"), "sid").distinct(),
        "marker_summary": curation.marker_summary(by_marker.groupBy("marker", "cluster_id").agg(F.count("*").alias("n_sequences")), by_marker),
        "duplicate_conflicts": curation.accession_conflicts(raw),
        "removed": removed,
        "manual_exclusions": manual,
    }


_MEMBER = ["cluster_id", "sid", "species", "parent", "ord"]


def assemble_ingroup(members: DataFrame, metadata: DataFrame, manual: DataFrame, markers: list[str], dictionary: DataFrame, preferred: str = "3593", min_species: int = 50) -> Tables:
    """Curate cluster members of the ingroup: large clusters, markers, one home for each accession, summaries."""
    large = cut(curation.large_clusters(require_columns(members, _MEMBER, "members"), min_species))
    return _assemble(large, metadata, manual, markers, dictionary, lambda m: curation.keep_preferred_parent(m, preferred))


def assemble_outgroup(members: DataFrame, metadata: DataFrame, manual: DataFrame, markers: list[str], dictionary: DataFrame, preferred: str = "3593") -> Tables:
    """The same for outgroups: clusters of all sizes, and exactly one row for each accession."""
    return _assemble(require_columns(members, _MEMBER, "members"), metadata, manual, markers, dictionary, lambda m: curation.keep_first_ranked(m, preferred))


def run_alignment_pipeline(raw: DataFrame, align: Callable[[DataFrame], DataFrame], mask: bool = True, min_non_gap: float = 0.3, max_missing: float = 0.3) -> Tables:
    """Raw sequences ``marker, name, ord, seq`` to filtered alignments and the manifest.

    ``align`` returns the rows with aligned ``seq`` and a ``status``; a marker whose alignment failed has
    one manifest row with that status and no numbers, and the others go on.
    """
    require_columns(raw, ["marker", "name", "ord", "seq"], "sequences")
    clean = raw.withColumn("seq", names.clean_ambiguous("seq"))
    told = cut(align(clean).select("marker", "name", "ord", "seq", "status"))
    failed = told.where("status != 'OK'").groupBy("marker").agg(F.min("status").alias("status"))
    aligned = told.where("status = 'OK'").drop("status").join(failed.select("marker"), "marker", "left_anti")
    if mask:
        common = cut(sites.drop_common_gaps(aligned))
        masked = cut(sites.mask_columns(common))
        log = cut(sites.filter_sequences(masked, min_non_gap, max_missing))
    else:
        common = masked = aligned
        unknown = {"non_gap_sites_after_masking": F.lit(None).cast("int"), "fraction_missing_after_masking": F.lit(None).cast("double")}
        log = aligned.withColumns(unknown | {f"removed_{x}": F.lit(False) for x in ("low_coverage", "high_missingness", "final")})
    final = log.where("NOT removed_final").select("marker", "name", "ord", "seq")
    before = raw.join(aligned.select("marker").distinct(), "marker", "left_semi")
    steps = dict(zip(sites.STAGES, (before, aligned, common, masked, final), strict=True))
    stats = None
    for stage, rows in steps.items():
        found = sites.stage_stats(rows).withColumn("stage", F.lit(stage))
        stats = found if stats is None else stats.unionByName(found)
    done = sites.manifest(stats, log, mask)
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in done.dtypes if c not in ("marker", "status", "masking_applied", "final_alignment_written")]
    errors = failed.select("marker", *blank, F.lit(mask).alias("masking_applied"), F.lit(False).alias("final_alignment_written"), "status")
    return {"aligned": aligned, "final": final, "sequence_filter_log": log, "stage_summary": stats, "manifest": done.unionByName(errors)}


def run_joint_realignment(markers: DataFrame, align: Callable[[DataFrame], DataFrame], min_non_gap: float = 0.3, max_missing: float = 0.3) -> Tables:
    """Realign integrated markers; an alignment that fails is an error that names the markers.

    ``collapsed`` lists markers of which no sequence is left.
    """
    told = cut(align(markers.withColumn("seq", names.clean_ambiguous("seq"))).select("marker", "name", "ord", "seq", "status"))
    failed = [r[0] for r in told.where("status != 'OK'").select(F.concat_ws(": ", "marker", "status")).distinct().limit(20).collect()]
    if failed:
        raise RuntimeError("alignment failed for " + "; ".join(sorted(failed)))
    log = cut(sites.filter_sequences(sites.mask_columns(sites.drop_common_gaps(told.drop("status"))), min_non_gap, max_missing))
    final = log.where("NOT removed_final").select("marker", "name", "ord", "seq")
    collapsed = markers.select("marker").distinct().join(final.select("marker").distinct(), "marker", "left_anti")
    return {"final": final, "sequence_filter_log": log, "collapsed": collapsed}


_MEASURES = ("aln_len", "missing", "gc", "var_sites", "pi_sites", "entropy", "slope", "saturated", "reason")


def run_marker_screening(
    aln: DataFrame, min_columns: int = 50, min_length: int = 200, min_sequences: int = 100, max_missing: float = 0.7, flag_slope: float = 0.3, keep_slope: float = 0.5, multiplier: float = 1.5
) -> Tables:
    """Screen aligned markers ``marker, name, ord, seq``: outlying sequences go, then each marker is kept or not.

    Every state but A, C, G and T counts as missing.  ``summary`` has a row for each marker with its figures before and after outliers
    went, and the reasons; ``retained`` has the sequences of the markers that stay.  Markers of fewer than ``min_columns``
    columns are not judged.
    """
    require_columns(aln, ["marker", "name", "ord", "seq"], "sequences")
    clean = cut(aln.select("marker", "name", "ord", F.regexp_replace(F.upper("seq"), "[^ACGT]", "-").alias("seq")))
    sums = cut(distances.pair_sums(clean))
    above = cut(distances.outliers_of_sums(clean, sums, multiplier).where("is_outlier").select("marker", "ord", "name"))
    kept = cut(clean.join(above, ["marker", "ord"], "left_anti"))
    figures = []
    for rows, found, when in ((clean, sums, "before"), (kept, cut(distances.pair_sums(kept)), "after")):
        stats = sites.screening_stats(rows).join(distances.saturation_of_sums(rows, found, flag_slope), "marker", "left")
        counts = rows.groupBy("marker").agg(F.count("*").alias("n"))
        figures.append((when, cut(stats.join(counts, "marker"))))
    _, after = figures[1]
    decision = distances.decide(after.drop("n", "n_pairs", "slope", "saturated", "reason"), after.select("marker", "slope", "saturated"), kept, min_columns, min_length, min_sequences, keep_slope, max_missing)
    out = clean.groupBy("marker").agg(F.max(F.length("seq")).alias("width"))
    for when, table in figures:
        out = out.join(table.select("marker", F.col("n").alias(f"n_{when}"), *(F.col(c).alias(f"{c}_{when}") for c in _MEASURES)), "marker", "left")
    gone = above.groupBy("marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ";").alias("removed"))
    out = out.join(decision.select("marker", "status", "decision", "decision_reason"), "marker", "left").join(gone, "marker", "left")
    short = F.col("width") < min_columns
    blank = [F.when(~short, F.col(f"{c}_{when}")).alias(f"{c}_{when}") for c in _MEASURES[1:] for when in ("before", "after")]
    summary = cut(
        out.select(
            "marker", F.when(short, "skipped_short_alignment").otherwise(F.col("status")).alias("status"), F.when(short, "NO").otherwise(F.col("decision")).alias("decision"),
            F.when(short, f"alignment_shorter_than_{min_columns}_columns").otherwise(F.col("decision_reason")).alias("decision_reason"),
            F.col("n_before").alias("n_original"), F.when(short, F.col("n_before")).otherwise(F.col("n_after")).alias("n_filtered"), F.when(short, 0).otherwise(F.col("n_before") - F.col("n_after")).alias("n_removed"),
            *(F.when(short, F.col("width")).otherwise(F.col(f"aln_len_{when}")).alias(f"aln_len_{when}") for when in ("before", "after")), *blank, F.when(short, "-").otherwise(F.coalesce("removed", F.lit("-"))).alias("removed"),
        )
    )
    retained = kept.join(summary.where("decision = 'YES'").select("marker"), "marker", "left_semi")
    return {"summary": summary, "outliers": above, "retained": retained}


def run_concatenation_pipeline(aln: DataFrame, records: DataFrame | None = None) -> Tables:
    """Markers ``marker, name, ord, seq`` (names as in their files) to the supermatrix, its partitions and all tables.

    Of names that are the same once cleaned, the first sequence of a marker counts.  ``records`` (``species, source_branch, accepted_or_outgroup``,
    species as names of files) adds the class of each species to its summary.  ``write_concatenation`` writes the files.
    """
    require_columns(aln, ["marker", "name", "ord", "seq"], "sequences")
    named = aln.select("marker", "ord", F.col("name").alias("original_name"), names.clean_taxon_name("name").alias("name"), names.header_accession("name").alias("sid"), F.upper("seq").alias("seq"))
    first = cut(named.groupBy("marker", "name").agg(F.min_by(F.struct("ord", "seq", "sid"), "ord").alias("r")).select("marker", "name", "r.*"))
    ranges = cut(concatenation.marker_ranges(first))
    markers = [r[0] for r in ranges.orderBy("start").select("marker").collect()]  # one column each
    held = first.select(F.col("name").alias("species"), "marker", "ord", "sid")
    summary = concatenation.occupancy(held, len(markers)).join(concatenation.occupancy_matrix(held, markers), "species")
    if records is not None:
        require_columns(records, ["species", "source_branch", "accepted_or_outgroup"], "records")
        classes = records.groupBy(names.clean_taxon_name("species").alias("species")).agg(F.min(F.struct(F.col("source_branch").alias("species_class"), "accepted_or_outgroup")).alias("c"))
        summary = summary.join(classes.select("species", "c.*"), "species", "left").select("species", "species_class", "accepted_or_outgroup", *summary.columns[1:])
    return {
        "taxon_name_crosswalk": named.select("marker", "original_name", F.col("name").alias("cleaned_name")),
        "marker_statistics": sites.marker_stats(first),
        "marker_ranges": ranges,
        "supermatrix_statistics": sites.supermatrix_stats(first),
        "final_species_alignment_summary": summary,
        "supermatrix": cut(concatenation.supermatrix(first, ranges)),
        "individual_markers": concatenation.full_markers(first, ranges),
    }


def write_concatenation(tables: Tables, folder: str, mode: str = "error") -> None:
    """The tables of ``run_concatenation_pipeline`` and its files: three alignment formats, four partition formats, a FASTA file for each marker."""
    matrix, ranges = tables["supermatrix"], tables["marker_ranges"]
    drawn = {"supermatrix", "individual_markers"}
    for name, table in tables.items():
        if name not in drawn:
            table.write.mode(mode).csv(f"{folder}/final_tables/{name}", header=True, nullValue="", emptyValue="")
    at = f"{folder}/concatenated_alignments"
    fasta = matrix.select(F.col("name").alias("ord"), F.format_string(">%s\n%s", "name", "seq").alias("line"))
    for name, lines in {"supermatrix.fasta": fasta, "supermatrix.phy": formats.phylip_lines(matrix), "supermatrix.nex": formats.nexus_lines(matrix)}.items():
        formats.write_lines(lines, f"{at}/{name}", mode)
    for name, lines in concatenation.partition_files(ranges, "supermatrix.phy").items():
        formats.write_lines(lines, f"{at}/{name}", mode)
    formats.write_fasta(tables["individual_markers"], f"{folder}/individual_markers", mode)


def run_dating(
    best: str, replicates: DataFrame, run: Callable[[str, str], str], config: str, outgroup: list[str], n: int | None = None, seed: int = 2025, factor: float = 100.0, primings: int = 100
) -> Tables:
    """Date the best tree and its replicates ``tree_no, newick``, and unite their ages.

    Unrooted trees (three or more branches at the root) are rooted on the outgroup tips that they have, and branch
    lengths are multiplied by ``factor``.  The best tree is primed, cross-validated and dated; ``n`` replicates, drawn without replacement, are
    dated in tasks with its options and smoothing.  ``run(configuration, name)`` executes the dating program, whose name for the tree's file is
    the tree itself in ``treefile``.  ``clade_ages`` has the mean age and shortest interval of each clade of the dated best tree.
    """
    require_columns(replicates, ["tree_no", "newick"], "replicates")
    spark = replicates.sparkSession
    texts = replicates.select(F.col("tree_no").cast("string").alias("tree_id"), "newick").unionByName(spark.createDataFrame([("best", best)], "tree_id string, newick string"))
    ready = cut(formats.newick_texts(trees.rescale(rooted_where_needed(formats.newick_nodes(texts), outgroup), factor)))
    first = ready.where("tree_id = 'best'").select("newick").first()[0]
    dated, smoothing, options = dating.date_tree(run, config, first, "ML_tree", primings)
    drawn = ready.where("tree_id != 'best'").select(F.col("tree_id").cast("long").alias("tree_no"), "newick")
    told = cut(dating.date_replicates(drawn, run, config, options, smoothing, n, seed, factor=1.0))
    target = formats.newick_nodes(spark.createDataFrame([("best", dated)], "tree_id string, newick string"))
    aged = formats.newick_nodes(told.where("status = 'OK'").select(F.col("tree_no").cast("string").alias("tree_id"), F.col("dated").alias("newick")))
    return {
        "best": spark.createDataFrame([(dated, float(smoothing), options)], "dated string, smoothing double, options array<string>"),
        "replicates": told,
        "clade_ages": clades.clade_age_intervals(cut(target), cut(aged)),
    }


def rooted_where_needed(nodes: DataFrame, outgroup: list[str]) -> DataFrame:
    """``nodes`` with the unrooted trees among them rooted on the outgroup tips that they have."""
    at_root = nodes.join(nodes.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"], "left_semi")
    unrooted = at_root.groupBy("tree_id").agg(F.count("*").alias("branches")).where("branches > 2").select("tree_id")
    columns = ["tree_id", "node_id", "parent_id", "label", "branch_length", "support", "is_tip"]
    turned = trees.reroot(nodes.join(unrooted, "tree_id", "left_semi").select(columns), outgroup).select(columns)
    return nodes.join(unrooted, "tree_id", "left_anti").select(columns).unionByName(turned)


def integrate_and_clean_markers(headers: DataFrame, metadata: DataFrame, checklist: DataFrame, name: str = "pureName") -> Tables:
    """Headers of both branches and accession metadata to accepted, selected and exported records, with audits."""
    require_columns(headers, ["marker_key", "source_branch", "species", "fasta_name"], "headers")
    require_columns(metadata, ["species", "marker_key", "sid", "is_outgroup"], "metadata")
    require_columns(checklist, [name], "checklist")
    if headers.where("source_branch = 'ingroup'").isEmpty():
        raise ValueError("no ingroup headers")
    known = metadata.select("species", "marker_key", "sid", "is_outgroup").distinct()
    raw = integration.raw_records(headers, known)
    flagged = cut(integration.with_acceptance(raw, integration.accepted_species(checklist, name), known))
    groups, selected = cut(integration.duplicate_groups(flagged)), cut(integration.select_records(flagged))
    mapped = cut(integration.header_map(flagged, selected))
    exported = cut(integration.exported_records(headers, mapped))
    keys = [r[0] for r in headers.select("marker_key").distinct().orderBy("marker_key").collect()]  # one column each
    return {
        "sequence_registry": integration.sequence_registry(flagged, groups),
        "unmatched_metadata": integration.unmatched(raw),
        "duplicate_groups": groups,
        "duplicate_resolution": integration.duplicate_resolution(flagged, selected),
        "selected_records": selected,
        "selected_header_map": mapped,
        "species_marker_matrix": integration.marker_matrix(selected, keys),
        "marker_taxon_composition": integration.taxon_composition(flagged, selected, exported),
        "marker_summary": integration.integration_summary(flagged, groups, selected, exported),
        "exported_records": exported,
    }


def validate_phylogenies(nodes: DataFrame, order: DataFrame, checklist: DataFrame, constraints: DataFrame, main: list[str], outgroup: DataFrame | None = None) -> Tables:
    """Compare trees on shared tips: pruning and shared sets by stage, four analyses, distances, tree space.

    ``nodes``: all trees; ``order``: ``tree_id, ord``; ``checklist`` and ``constraints``: ``taxon``; ``main``:
    the trees of the second analysis; ``outgroup``: tips to root on (one column), or ``tree_id, label`` for each tree.
    """
    require_columns(nodes, ["tree_id", "node_id", "parent_id", "label", "branch_length", "support", "is_tip"], "nodes")
    names_of = [r[0] for r in order.orderBy("ord").select("tree_id").collect()]
    tips = cut(nodes.where("is_tip").select(F.col("tree_id").alias("tree"), F.col("label").alias("taxon")).distinct())
    listed = cut(taxa.only_listed(tips, checklist))
    final = cut(taxa.only_listed(listed, constraints))
    rooted = nodes if outgroup is None else cut(trees.reroot(nodes, outgroup))
    sets = cut(taxa.analysis_tips(final, names_of, [t for t in names_of if t in main] or names_of))
    distances = cut(trees.pairwise_distances(rooted, sets, order))
    long = distances.unpivot(["analysis_id", "tree_1", "tree_2", "n_common_tips"], ["rf", "dpi"], "metric", "distance").withColumn("metric", F.upper("metric"))
    space = None
    for analysis in taxa.ANALYSES:
        for metric in ("RF", "DPI"):
            rows = trees.tree_space(long.where((F.col("analysis_id") == analysis) & (F.col("metric") == metric)))
            rows = rows.select(F.lit(analysis).alias("analysis_id"), F.lit(metric).alias("metric"), "*")
            space = rows if space is None else space.unionByName(rows)
    by_stage = [("initial", tips), ("after_checklist", listed), ("after_family_filter", final)]
    out = {
        "species_by_stage": None,
        "phylogeny_summary": taxa.summary(tips, listed, final),
        "taxon_counts_by_stage": taxa.counts_by_stage(by_stage),
        "species_removed": taxa.species_removed(tips, listed, "removed_by_checklist").unionByName(taxa.species_removed(listed, final, "removed_by_family_filter")),
        "genera_removed": taxa.genera_removed(tips, listed, "removed_by_checklist").unionByName(taxa.genera_removed(listed, final, "removed_by_family_filter")),
        "missing_in_constraints": taxa.missing(listed, constraints),
        "taxon_crosswalk": taxa.crosswalk(final),
        "comparison_sets": sets,
        "comparison_summary": sets.groupBy("analysis_id", "tree").agg(F.countDistinct("taxon").alias("n_tips_retained"), F.countDistinct(names.genus_of("taxon")).alias("n_genera_retained")),
        "pairwise_distances": long,
        "tree_space": space,
    }
    species = None
    for stage, rows in by_stage:
        found = taxa.species_by_stage(rows, stage)
        species = found if species is None else species.unionByName(found)
    out["species_by_stage"] = species
    if outgroup is not None:
        out["rooting_summary"] = rooted.groupBy(F.col("tree_id").alias("tree")).agg(F.first("note").alias("rooting_notes"))
    return out
