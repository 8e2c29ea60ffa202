"""Ages of the clades of one tree over many dated trees.

A clade is the set of the tips below a node.  Sets are not written out: each tip has two 64-bit hashes, a node's
number of tips and the exclusive or of both hashes over them come from one climb of all trees together
(``intervals.climb``), and clades are the same where all three agree (two different sets of the same size agree with a
chance of about ``2**-128``).  Tips are added up on their parents first (``intervals.inner_nodes``), so every round has
a row for each inner node of every tree, and tips are shuffled once, to find those that the target has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.operators import intervals
from cladeweave.operators.dating import age_intervals
from cladeweave.operators.lineage import cut

_SET = ["n_tips", "h1", "h2"]


def clade_sets(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """``tree_id, node_id, height, n_tips, h1, h2`` of every inner node; only tips of ``tips(label)`` count in the sets.

    A node's height is how far the tree's farthest tip (of all its tips) is below it: its age, where the tree is dated.
    """
    marks = tips.select("label").distinct().select("label", F.lit(True).alias("known"))
    known = nodes.where("is_tip").join(cut(marks), "label", "left").select("tree_id", "parent_id", "label", "branch_length", "known", F.lit(True).alias("is_tip"))
    inner = nodes.where("NOT coalesce(is_tip, false)")
    every = known.unionByName(inner.select("tree_id", "node_id", "parent_id", "branch_length", F.lit(False).alias("is_tip")), allowMissingColumns=True)
    own = lambda seed: F.bit_xor(F.when(F.col("known"), F.xxhash64(F.lit(seed), "label")))
    held = {"n_tips": F.count("known"), "h1": own(1), "h2": own(2), "reach": F.max(F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0)))}
    collapsed = intervals.inner_nodes(every, held)
    found = intervals.climb(collapsed, {"n_tips": F.col("n_tips")}, {"h1": F.col("h1"), "h2": F.col("h2")}).table
    table = cut(found.join(collapsed.select(*intervals.KEY, "reach"), intervals.KEY).select(*intervals.KEY, "depth", "reach", *_SET))
    far = table.groupBy("tree_id").agg(F.max(F.col("depth") + F.col("reach")).alias("far"))
    return table.join(far, "tree_id").select(*intervals.KEY, (F.col("far") - F.col("depth")).alias("height"), *_SET)


def _wanted(target: DataFrame) -> DataFrame:
    """``node, n_tips, h1, h2`` of the inner nodes of the target."""
    found = clade_sets(target, target.where("is_tip").select("label"))
    return cut(found.where("n_tips >= 2").select(F.col("node_id").alias("node"), *_SET))


def _ages(wanted: DataFrame, target: DataFrame, dated: DataFrame) -> DataFrame:
    sets = clade_sets(dated, target.where("is_tip").select("label"))
    ages = sets.where("n_tips >= 2").groupBy("tree_id", *_SET).agg(F.min("height").alias("age"))
    return wanted.join(ages, _SET).select("node", F.col("tree_id").alias("rep"), "age")


def clade_ages(target: DataFrame, dated: DataFrame) -> DataFrame:
    """``node, rep, age`` for every inner node of ``target`` (one tree's nodes) and every tree of ``dated`` that has its clade.

    Ages are heights in the dated tree.  Only the target's tips count; a tree that lacks one of them has no clade with it.  Where
    several nodes of a tree have the same tips below (single children), the youngest is the clade's.
    """
    return _ages(_wanted(target), target, dated)


def clade_age_intervals(target: DataFrame, dated: DataFrame, share: float = 0.95) -> DataFrame:
    """``node, n_tips, n_replicates, support, mean_age, hpd_low, hpd_high`` of every inner node of ``target``.

    ``support`` is the share of the dated trees that have the clade; mean and shortest interval are over those trees.  A clade
    that none has is a row with zero trees and null ages.
    """
    wanted = _wanted(target)
    found = age_intervals(cut(_ages(wanted, target, dated)), share)
    n = dated.agg(F.countDistinct("tree_id").alias("trees"))
    out = wanted.join(found, "node", "left").crossJoin(F.broadcast(n)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("node", "n_tips", F.col("n").alias("n_replicates"), (F.col("n") / F.nullif("trees", F.lit(0))).alias("support"), "mean_age", "hpd_low", "hpd_high")
