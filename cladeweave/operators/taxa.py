"""Tip sets of several trees: stages, removals, shared sets, summaries.  ``tips``: ``tree, taxon``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.functions import names


def species_by_stage(tips: DataFrame, stage: str) -> DataFrame:
    return tips.select("tree", F.lit(stage).alias("stage"), F.col("taxon").alias("species"))


def genera_by_stage(tips: DataFrame, stage: str) -> DataFrame:
    return tips.select("tree", F.lit(stage).alias("stage"), names.genus_of("taxon").alias("genus")).distinct()


def only_listed(tips: DataFrame, listed: DataFrame) -> DataFrame:
    return tips.join(listed.select("taxon").distinct(), "taxon", "left_semi").select("tree", "taxon")


def species_removed(before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    return before.join(after, ["tree", "taxon"], "left_anti").select("tree", F.col("taxon").alias("species"), F.lit(reason).alias("reason"))


def genera_removed(before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    g = lambda d: d.select("tree", names.genus_of("taxon").alias("genus")).distinct()
    return g(before).join(g(after), ["tree", "genus"], "left_anti").withColumn("reason", F.lit(reason))


def counts(tips: DataFrame) -> DataFrame:
    return tips.groupBy("tree").agg(F.countDistinct("taxon").alias("n_species"), F.countDistinct(names.genus_of("taxon")).alias("n_genera"))


def pruning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Species and genera before, after and removed."""
    b = counts(before).toDF("tree", "species_before", "genera_before")
    a = counts(after).toDF("tree", "species_after", "genera_after")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    df = b.join(a, "tree", "left").select("tree", "species_before", zero("species_after"), "genera_before", zero("genera_after"))
    return df.withColumn("species_removed", F.col("species_before") - F.col("species_after")).withColumn("genera_removed", F.col("genera_before") - F.col("genera_after"))


def counts_by_stage(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, tips in stages:
        rows = counts(tips).select("tree", F.lit(name).alias("stage"), "n_species", "n_genera")
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(initial: DataFrame, listed: DataFrame, final: DataFrame) -> DataFrame:
    i, c, f = (counts(d).toDF("tree", f"species_{n}", f"genera_{n}") for d, n in ((initial, "initial"), (listed, "after_checklist"), (final, "final")))
    df = i.join(c, "tree", "left").join(f, "tree", "left").na.fill(0)
    pct = lambda x: F.round(100 * F.col(f"{x}_final") / F.col(f"{x}_initial"), 2).alias(f"{x}_retained_pct")
    return df.select("*", pct("species"), pct("genera"))


def crosswalk(tips: DataFrame) -> DataFrame:
    return tips.select("tree", "taxon", names.genus_of("taxon").alias("genus"))


def missing(tips: DataFrame, constraints: DataFrame) -> DataFrame:
    return tips.join(constraints.select("taxon").distinct(), "taxon", "left_anti").select("tree", F.col("taxon").alias("species_not_in_constraints"))


def in_all_trees(tips: DataFrame, column, trees: int) -> DataFrame:
    """Values that every one of ``trees`` trees has."""
    return tips.select("tree", column.alias("value")).groupBy("value").agg(F.countDistinct("tree").alias("n")).where(F.col("n") == trees).select("value")


def shared_species(tips: DataFrame, trees: int) -> DataFrame:
    return in_all_trees(tips, F.col("taxon"), trees).toDF("species")


def shared_genera(tips: DataFrame, trees: int) -> DataFrame:
    return in_all_trees(tips, names.genus_of("taxon"), trees).toDF("genus")


def genus_representatives(tips: DataFrame, genera: DataFrame) -> DataFrame:
    """The alphabetically first species of each shared genus of each tree."""
    keyed = tips.withColumn("genus", names.genus_of("taxon"))
    return keyed.join(genera, "genus", "left_semi").groupBy("tree", "genus").agg(F.min("taxon").alias("representative"))


def comparison_sets(tips: DataFrame, trees: list[str], main: list[str]) -> DataFrame:
    """Tips of the four analyses: shared by all, by the main trees, by genus, one for each genus."""
    genera = shared_genera(tips, len(trees))
    a1 = tips.join(shared_species(tips, len(trees)).toDF("taxon"), "taxon", "left_semi").select(F.lit("A1").alias("analysis_id"), "tree", "taxon")
    some = tips.where(F.col("tree").isin(main))
    a2 = some.join(shared_species(some, len(main)).toDF("taxon"), "taxon", "left_semi").select(F.lit("A2").alias("analysis_id"), "tree", "taxon")
    a3 = tips.withColumn("genus", names.genus_of("taxon")).join(genera, "genus", "left_semi").select(F.lit("A3").alias("analysis_id"), "tree", "taxon")
    a4 = genus_representatives(tips, genera).select(F.lit("A4").alias("analysis_id"), "tree", F.col("genus").alias("taxon"))
    return a1.unionByName(a2).unionByName(a3).unionByName(a4)


#: The four analyses of ``comparison_sets``.
ANALYSES = ("A1", "A2", "A3", "A4")


def analysis_tips(tips: DataFrame, trees: list[str], main: list[str]) -> DataFrame:
    """``analysis_id, tree, label, taxon``: tips of each analysis by their label in the tree and their name in it.

    They differ in the last analysis, where a genus names its representative species.
    """
    sets = comparison_sets(tips, trees, main)
    named = genus_representatives(tips, shared_genera(tips, len(trees)))
    same = sets.where("analysis_id != 'A4'").select("analysis_id", "tree", F.col("taxon").alias("label"), "taxon")
    return same.unionByName(named.select(F.lit("A4").alias("analysis_id"), "tree", F.col("representative").alias("label"), F.col("genus").alias("taxon")))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """``side, taxon``: taxa that only one of two tip sets has; no rows if the sets are equal."""
    a, b = left.select("taxon").distinct(), right.select("taxon").distinct()
    only = lambda x, y, side: x.join(y, "taxon", "left_anti").select(F.lit(side).alias("side"), "taxon")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def require_equal_sets(left: DataFrame, right: DataFrame, what: str = "constraint and alignment", shown: int = 10) -> None:
    """Raise ``ValueError`` that names some taxa unless both have the same tips."""
    found = set_differences(left, right).orderBy("side", "taxon").limit(shown).collect()
    if found:
        raise ValueError(f"tips of {what} differ: " + ", ".join(f"{r.taxon} (only {r.side})" for r in found))


def clade_audit(alignment: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taxa of an alignment that no constraint has, and species in more than one clade."""
    absent = alignment.select("taxon").distinct().join(constraints.select("taxon"), "taxon", "left_anti")
    double = constraints.groupBy("taxon").agg(F.countDistinct("clade").alias("n_clades"), names.unique_sorted("clade").alias("clades")).where("n_clades > 1")
    return absent, double


def constraint_groups(alignment: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per clade: number of tips and the Newick group of its sorted tips; a single tip stands bare."""
    tips = F.array_sort(F.collect_set("taxon"))
    group = F.when(F.size(tips) > 1, F.concat(F.lit("("), F.array_join(tips, ","), F.lit(")"))).otherwise(tips[0])
    found = constraints.join(alignment.select("taxon").distinct(), "taxon", "left_semi")
    return found.groupBy("clade").agg(F.countDistinct("taxon").alias("n_tips"), group.alias("newick"))


def constraint_tree(groups: DataFrame, template: str) -> str:
    """A scaffold from clade groups and a nesting template such as ``(({A},{B}),{C});``.

    The template names each clade once; clades without tips are an error.
    """
    found = {r["clade"]: r["newick"] for r in groups.select("clade", "newick").collect()}
    import re

    wanted = re.findall(r"\{([^}]*)\}", template)
    absent = [c for c in wanted if c not in found]
    if absent:
        raise ValueError(f"clades without tips: {absent}")
    return re.sub(r"\{([^}]*)\}", lambda m: found[m[1]], template)
