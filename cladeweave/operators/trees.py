"""Rooted and unrooted trees as node tables.

A tree is rows ``tree_id, node_id, parent_id, label, branch_length, support, is_tip``.  Depths, common ancestors and
pruning rest on pointers that double their reach (``intervals``): a round has a row for each node, and there are
logarithmically many in the number of levels; many replicate trees are handled by the same plans, keyed on
``tree_id``.  Splits are unrooted and non-trivial: the side without the reference (smallest) tip.  They
are told by the number of tips on a side and two hashes of them: tips are added up on their parents, and only
inner nodes climb.  Names come back only for output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.operators import intervals
from cladeweave.operators.lineage import cut

KEY = ["tree_id", "node_id"]


def rescale(nodes: DataFrame, factor: float = 100.0) -> DataFrame:
    return nodes.withColumn("branch_length", F.col("branch_length") * factor)


def root_distances(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, depth``: sum of branch lengths to the root."""
    return intervals.climb(nodes, {}).table.select(*KEY, "depth")


def max_depth(nodes: DataFrame) -> DataFrame:
    return root_distances(nodes).groupBy("tree_id").agg(F.max("depth").alias("max_depth"))


def _masks(node: list, parent: list, tip: list) -> list[int]:
    """For each inner node the bits of the tips below; ``tip`` has a tip's place, else None (or -1 for a tip that does not count)."""
    at = {n: k for k, n in enumerate(node)}
    up = [at.get(p) if p is not None else None for p in parent]
    waiting = [0] * len(node)
    for u in up:
        if u is not None:
            waiting[u] += 1
    below = [1 << t if t is not None and t >= 0 else 0 for t in tip]
    ready = [k for k, w in enumerate(waiting) if not w]
    while ready:
        k = ready.pop()
        if (u := up[k]) is not None:
            below[u] |= below[k]
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
    return [below[k] for k, t in enumerate(tip) if t is None]


def _split_set(masks: list[int], n: int) -> set[int]:
    """Distinct non-trivial splits over ``n`` tips, each the side without the first tip."""
    full = (1 << n) - 1
    return {full ^ m if m & 1 else m for m in masks if 2 <= m.bit_count() <= n - 2}


def _columns_of(tree: pa.Table) -> tuple[list, list, list, list]:
    return tuple(tree[c].to_pylist() for c in ("node_id", "parent_id", "label", "is_tip"))


#: What names a set of tips: their number and two 64-bit hashes (two different sets of a size agree with a chance of about ``2**-128``).
SET = ["k", "h1", "h2"]


def tip_sums(label: str = "label") -> dict[str, Column]:
    """Aggregates that name the set of the tips of a group; the labels of a tree's tips are distinct."""
    return {"k": F.count(label), "h1": F.bit_xor(F.xxhash64(F.lit(1), label)), "h2": F.bit_xor(F.xxhash64(F.lit(2), label))}


def climbed_sums(inner: DataFrame) -> DataFrame:
    """``tree_id, node_id, parent_id, k, h1, h2``: the tips below each node of ``intervals.inner_nodes(nodes, tip_sums())``."""
    return intervals.climb(inner, {"k": F.col("k")}, {"h1": F.col("h1"), "h2": F.col("h2")}).table.select(*KEY, "parent_id", *SET)


def one_sided(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``k, h1, h2`` of the non-trivial splits: sides ``k, h1, h2`` of trees of ``n, t1, t2``, each named by its side of fewer tips, or of the smaller hashes."""
    here = F.struct(*SET)
    there = F.struct((F.col("n") - F.col("k")).alias("k"), F.col("h1").bitwiseXOR(F.col("t1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("t2")).alias("h2"))
    return rows.where("k >= 2 AND k <= n - 2").select(*keep, F.least(here, there).alias("s")).select(*keep, "s.*")


def _typed(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("tree_id").cast("string").alias("tree_id"), F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "label", F.lit(0.0).alias("branch_length"), F.coalesce("is_tip", F.lit(False)).alias("is_tip"))


def _sides(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, split, size`` of every inner node with a non-trivial split: the sorted tips of the side without the tree's first tip.

    As many rows as the texts have names are joined and sorted; no tree is gathered in a task.
    """
    rows = _typed(nodes)
    above = intervals.ancestor_pairs(cut(rows.where("NOT is_tip").select(*KEY, "parent_id", "branch_length")))
    tips = rows.where("is_tip").select("tree_id", F.col("parent_id").alias("node_id"), "label")
    every = tips.groupBy("tree_id").agg(F.array_sort(F.collect_set("label")).alias("names"))
    below = tips.join(above, KEY).groupBy("tree_id", "above").agg(F.array_sort(F.collect_set("label")).alias("side"))
    met = below.join(every, "tree_id").where((F.size("side") >= 2) & (F.size("side") <= F.size("names") - 2))
    side = F.when(F.col("side")[0] == F.col("names")[0], F.array_except("names", "side")).otherwise(F.col("side"))
    return met.select("tree_id", F.col("above").alias("node_id"), side.alias("side")).select(*KEY, F.array_join("side", ",").alias("split"), F.size("side").alias("size"))


def splits(nodes: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """``tree_id, split, size``: distinct non-trivial splits, each the sorted tips of one side.

    ``common`` (one column ``tip``) restricts all trees to those tips.
    """
    if common is not None:
        kept = nodes.where("is_tip").join(common.select(F.col("tip").alias("label")).distinct(), "label", "left_semi")
        nodes = nodes.where("NOT coalesce(is_tip, false)").unionByName(kept.select(nodes.columns))
    return _sides(nodes).select("tree_id", "split", "size").distinct()


def _over_tips(nodes: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree_id, node_id, n, k, h1, h2``: non-trivial splits over ``tips(label)`` by node; and ``tree_id, node_id, k`` of every inner node."""
    rows = _typed(nodes)
    known = rows.where("is_tip").join(tips, "label", "left_semi").select(rows.columns)
    inner = intervals.inner_nodes(rows.where("NOT is_tip").unionByName(known), tip_sums())
    found = cut(climbed_sums(inner))
    whole = tips.agg(*(c.alias(n) for n, c in zip(("n", "t1", "t2"), tip_sums().values(), strict=True)))
    return one_sided(found.crossJoin(F.broadcast(whole)), *KEY, "n"), found.select(*KEY, "k")


def splits_over(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """``tree_id, k, h1, h2``: the distinct non-trivial splits of every tree over ``tips(label)`` (distinct); other tips do not count."""
    return cut(_over_tips(nodes, tips)[0].select("tree_id", *SET).distinct())


def tip_table(nodes: DataFrame) -> DataFrame:
    """``label`` of the tips, each once."""
    return cut(nodes.where("is_tip AND label IS NOT NULL").select("label").distinct())


def split_bits(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``tree_id, bits``: the splits of every tree over the sorted tips ``names``, as little-endian bit sets."""
    width = (len(names) + 7) // 8

    def one(tree: pa.Table) -> pa.Table:
        node, parent, label, is_tip = _columns_of(tree)
        place = {x: k for k, x in enumerate(names)}
        masks = _masks(node, parent, [place.get(x, -1) if t else None for x, t in zip(label, is_tip, strict=True)])
        found = sorted(_split_set(masks, len(names)))
        tree_id = pa.array([tree["tree_id"][0].as_py()] * len(found), pa.string())
        return pa.table([tree_id, pa.array([m.to_bytes(width, "little") for m in found], pa.binary())], names=["tree_id", "bits"])

    rows = nodes.select(F.col("tree_id").cast("string"), "node_id", "parent_id", "label", "is_tip")
    return rows.groupBy("tree_id").applyInArrow(one, "tree_id string, bits binary")


def common_splits(met: DataFrame, inner: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, n_common_tips, rf`` of every pair of trees, each on its own common names.

    ``met``: ``pair, node_1, node_2, name``: a common name and the nodes that its tip hangs on in either tree (null if the tree lacks it);
    ``inner``: ``tree, node_id, parent_id, branch_length`` of the trees' inner nodes; ``pairs``: ``pair, tree_1, tree_2``.  Distances are null below
    three common names, and zero if neither tree then has a split.  Names are added up on their nodes before anything climbs.
    """
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"node_{k}").alias("node_id")) for k in (1, 2)))).alias("e")
    own = cut(met.select("pair", "name", ends).groupBy("pair", "e.side", "e.node_id").agg(*(c.alias(n) for n, c in tip_sums("name").items())))
    whole = cut(own.where("side = 1").groupBy("pair").agg(F.sum("k").alias("n"), F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2")))
    sides = pairs.select("pair", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"tree_{k}").alias("tree")) for k in (1, 2)))).alias("e")).select("pair", "e.*")
    copies = inner.join(sides, "tree").join(own, ["pair", "side", "node_id"], "left")
    copies = copies.withColumn("tree_id", F.concat_ws("|", F.col("side").cast("string"), "pair"))
    found = climbed_sums(copies).withColumn("pair", F.substring_index("tree_id", "|", -1))
    distinct = one_sided(found.join(whole, "pair"), "tree_id", "pair").distinct()
    shared = distinct.groupBy("pair", *SET).agg(F.count("*").alias("trees"))
    sums = shared.groupBy("pair").agg(F.sum("trees").alias("total"), F.count_if(F.col("trees") == 2).alias("both"))
    rf = F.when(F.col("n") < 3, None).when(F.col("total") > 0, (F.col("total") - 2 * F.col("both")) / F.col("total")).otherwise(0.0)
    counted = pairs.select("pair").join(whole, "pair", "left").join(sums, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("pair", F.col("n").cast("long").alias("n_common_tips"), rf.alias("rf"))


def _paired(sets: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pair, analysis_id, tree_1, tree_2`` of all pairs of trees of each analysis (numbered); and the kept tips with their trees' ``ord``."""
    order = order.select(F.col("tree_id").cast("string").alias("tree"), "ord")
    kept = sets.select("analysis_id", F.col("tree").cast("string").alias("tree"), "label", "taxon").distinct().join(order, "tree")
    there = cut(kept.select("analysis_id", "tree", "ord").distinct())
    one, two = (there.select("analysis_id", F.col("tree").alias(f"tree_{k}"), F.col("ord").alias(f"ord_{k}")) for k in (1, 2))
    pairs = one.join(two, "analysis_id").where("ord_1 > ord_2").select("analysis_id", "tree_1", "tree_2")
    return cut(pairs.withColumn("pair", F.monotonically_increasing_id().cast("string"))), kept


def _met(pairs: DataFrame, kept: DataFrame, *more: str) -> DataFrame:
    """``pair, name`` and both sides' columns ``more``: the names that both trees of a pair keep."""
    x, y = (kept.select("analysis_id", F.col("taxon").alias("name"), *(F.col(c).alias(f"{c}_{k}") for c in ("tree", "ord", *more))) for k in (1, 2))
    met = x.join(y, ["analysis_id", "name"]).where("ord_1 > ord_2").join(pairs, ["analysis_id", "tree_1", "tree_2"])
    return met.select("pair", "name", *(f"{c}_{k}" for k in (1, 2) for c in more))


def common_tip_counts(sets: DataFrame, order: DataFrame) -> DataFrame:
    """``analysis_id, tree_1, tree_2, n_common_tips`` of all pairs of trees of each analysis, from the names that ``sets`` keeps."""
    pairs, kept = _paired(sets, order)
    counts = _met(pairs, kept.select("analysis_id", "tree", "ord", "taxon").distinct()).groupBy("pair").agg(F.count("*").alias("n"))
    return pairs.join(counts, "pair", "left").select("analysis_id", "tree_1", "tree_2", F.coalesce("n", F.lit(0)).alias("n_common_tips"))


def pairwise_distances(nodes: DataFrame, sets: DataFrame, order: DataFrame, dpi: bool = True) -> DataFrame:
    """``analysis_id, tree_1, tree_2, n_common_tips, rf, dpi`` of all pairs of trees of each analysis.

    ``sets``: ``analysis_id, tree, label, taxon``: the tips of a tree that an analysis keeps, by label, and
    the name that it gives them (one label for a name of a tree); ``order``: ``tree_id, ord``.  Every pair is compared on its own common
    names; distances are null below three of them, and zero if neither tree then has a split.  ``tree_1``
    is the later tree.  Names are added up on the nodes that they hang on; only the information distance gathers a pair in a
    task: its inner nodes, and one row for each two nodes that have a name in common.
    """
    typed = nodes.select(F.col("tree_id").cast("string").alias("tree"), "node_id", "parent_id", F.lit(0.0).alias("branch_length"), "label", F.coalesce("is_tip", F.lit(False)).alias("is_tip"))
    inner = cut(typed.where("NOT is_tip").select("tree", "node_id", "parent_id", "branch_length"))
    pairs, kept = _paired(sets, order)
    pairs = cut(pairs.join(inner.select(F.col("tree").alias("tree_1")).distinct(), "tree_1", "left_semi").join(inner.select(F.col("tree").alias("tree_2")).distinct(), "tree_2", "left_semi"))
    tips = typed.where("is_tip").select("tree", "label", F.col("parent_id").alias("node"))
    met = _met(pairs, cut(kept.join(tips, ["tree", "label"], "left").select("analysis_id", "tree", "ord", "taxon", "node")), "node")
    out = pairs.join(common_splits(met, inner, pairs), "pair")
    if dpi:
        out = out.join(_information_distances(met, inner, pairs), "pair", "left")
        info = F.when(F.col("n_common_tips") >= 3, F.coalesce("info", F.lit(0.0)))
    else:
        info = F.lit(None).cast("double")
    return out.select("analysis_id", "tree_1", "tree_2", "n_common_tips", "rf", info.alias("dpi"))


def _information_distances(met: DataFrame, inner: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, info``: ``phylogenetic_information_distance`` of the pairs, from how many names each two nodes of their trees share."""
    own = met.groupBy("pair", "node_1", "node_2").agg(*(c.alias(n) for n, c in tip_sums("name").items()))
    rows = own.select("pair", F.lit(0).alias("kind"), "node_1", "node_2", *SET)
    for k in (1, 2):
        side = pairs.select("pair", F.col(f"tree_{k}").alias("tree"))
        none = [F.lit(None).cast("long").alias(c) for c in SET]
        rows = rows.unionByName(inner.join(side, "tree").select("pair", F.lit(k).alias("kind"), F.col("node_id").alias("node_1"), F.col("parent_id").alias("node_2"), *none))

    def one(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        a, b = (pc.fill_null(group[c].cast(pa.int64()), _NO_NODE).to_numpy() for c in ("node_1", "node_2"))
        base = np.flatnonzero(kind == 0)
        k, h1, h2 = (group[c].take(pa.array(base)).to_numpy().astype(np.int64) for c in SET)
        n, total = int(k.sum()), (np.bitwise_xor.reduce(h1, initial=0), np.bitwise_xor.reduce(h2, initial=0))
        trees = [_climbing(a[kind == s], b[kind == s]) for s in (1, 2)]
        places = [np.array([at.get(x, len(at)) for x in ends[base].tolist()], dtype=np.int64) for ends, (at, _) in zip((a, b), trees, strict=True)]
        both = np.zeros((len(trees[0][0]) + 1, len(trees[1][0]) + 1), dtype=np.int64)  # the last of each: names that a tree lacks
        np.add.at(both, (places[0], places[1]), k)
        kept, sizes = [], []
        for side, place in enumerate(places):
            size, x1, x2 = (np.zeros(both.shape[side], dtype=np.int64) for _ in range(3))
            np.add.at(size, place, k)
            np.bitwise_xor.at(x1, place, h1)
            np.bitwise_xor.at(x2, place, h2)
            table = both if side == 0 else both.T
            for child, parent in trees[side][1]:
                table[parent] += table[child]
                size[parent] += size[child]
                x1[parent] ^= x1[child]
                x2[parent] ^= x2[child]
            first: dict = {}
            for at in np.flatnonzero((size[:-1] >= 2) & (size[:-1] <= n - 2)).tolist():
                here = (int(size[at]), int(x1[at]), int(x2[at]))
                first.setdefault(min(here, (n - here[0], here[1] ^ int(total[0]), here[2] ^ int(total[1]))), at)
            kept.append(np.array(sorted(first.values()), dtype=np.int64))
            sizes.append(size[kept[-1]])
        info = _information_distance(n, *sizes, both[np.ix_(*kept)]) if n >= 3 else None
        return pa.table([group["pair"][:1].cast(pa.string()), pa.array([info], pa.float64())], names=["pair", "info"])

    return rows.groupBy("pair").applyInArrow(one, "pair string, info double")


_NO_NODE = -(1 << 63)


def _climbing(node: np.ndarray, parent: np.ndarray) -> tuple[dict, list[tuple[int, int]]]:
    """Places of nodes, and the places of children and their parents, all children of a node before it."""
    at = {x: k for k, x in enumerate(node.tolist())}
    up = [at.get(p) for p in parent.tolist()]
    waiting = [0] * len(at)
    for u in up:
        if u is not None:
            waiting[u] += 1
    ready, steps = [k for k, w in enumerate(waiting) if not w], []
    while ready:
        k = ready.pop()
        if (u := up[k]) is not None:
            steps.append((k, u))
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
    return at, steps


def rename_tips(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Trees whose tips are the ``names(tree_id, label, taxon)``: other tips go, and labels become taxa."""
    kept = prune(nodes, names.select("tree_id", F.col("label").alias("tip")))
    renamed = kept.join(names.select("tree_id", "label", "taxon"), ["tree_id", "label"], "left")
    return renamed.withColumn("label", F.when(F.col("is_tip"), F.col("taxon")).otherwise(F.col("label"))).select(*kept.columns)


def group_nodes(nodes: DataFrame, groups: DataFrame, min_tips: int = 2, labels: intervals.Labels | None = None) -> DataFrame:
    """Most recent common ancestor and monophyly of groups of tips.

    ``groups``: ``tip`` and columns that name the group.  The ancestor is the deepest node whose interval holds the
    least and the greatest entry number of the group's tips; the group is monophyletic if that node has no other tips.
    """
    labels = intervals.interval_labels(nodes) if labels is None else labels
    by = ["tree_id", *(c for c in groups.columns if c != "tip")]
    tips = nodes.where("is_tip").select(*KEY, F.col("label").alias("tip")).join(labels.table.select(*KEY, "enter"), KEY)
    placed = groups.distinct().join(tips, "tip")
    wanted = placed.groupBy(*by).agg(F.countDistinct("tip").alias("n_tips"), F.min_by("node_id", "enter").alias("node_id"), F.max("enter").alias("last")).where(F.col("n_tips") >= min_tips)
    found = intervals.common_ancestors(labels, cut(wanted))
    below = labels.table.select("tree_id", F.col("node_id").alias("mrca"), F.col("n_tips").alias("n_below"))
    return found.join(below, ["tree_id", "mrca"]).select(*by, "n_tips", "mrca", "n_below", (F.col("n_below") == F.col("n_tips")).alias("monophyletic"))


def collapse(nodes: DataFrame, cutoff: float = 0.70, tiny: float = 1e-10) -> DataFrame:
    """Weakly supported nodes become polytomies.

    Edges above nodes of lower support count as zero, then all internal edges shorter than ``tiny`` go
    (the root stays): their children hang on the nearest kept ancestor, found by pointer doubling.
    """
    internal = ~F.col("is_tip") & F.col("parent_id").isNotNull()
    length = F.when(internal & (F.col("support") < cutoff), 0.0).otherwise(F.col("branch_length"))
    marked = nodes.withColumn("branch_length", length).withColumn("_gone", internal & (F.coalesce(length, F.lit(1.0)) < tiny))
    up = intervals.nearest_kept(marked.select(*KEY, F.col("_gone").alias("gone"), F.col("parent_id").alias("up")))
    kept = marked.where("NOT _gone").drop("parent_id", "_gone")
    return kept.join(up.select(*KEY, F.col("up").alias("parent_id")), KEY).select(*nodes.columns)


def axis_breaks(depths: DataFrame, by: float = 5.0) -> DataFrame:
    """Axis ages from the largest multiple of ``by`` down to zero and their x positions."""
    steps = F.explode(F.sequence(F.floor(F.col("max_depth") / by).cast("int"), F.lit(0), F.lit(-1)))
    return depths.select("tree_id", "max_depth", steps.alias("k")).select("tree_id", (F.col("k") * by).alias("age"), (F.col("max_depth") - F.col("k") * by).alias("x"))


def reroot(nodes: DataFrame, outgroup: list[str] | DataFrame) -> DataFrame:
    """Trees rooted on the edge above the common ancestor of their outgroup tips (a list, a column of tips, or ``tree_id, label``).

    Trees without any outgroup tip, or in which the outgroup spans the root, stay as they are.  Whole
    trees are handled in a task each; ``note`` says what happened.
    """
    import pandas as pd

    if isinstance(outgroup, list):
        outgroup = nodes.sparkSession.createDataFrame([(x,) for x in outgroup], "label string")
    by = ["tree_id", "label"] if "tree_id" in outgroup.columns else ["label"]
    outgroup = outgroup.select(*by) if len(by) > 1 else outgroup.toDF("label")
    marks = outgroup.distinct().withColumn("is_outgroup", F.lit(True))
    nodes = nodes.join(marks, by, "left").withColumn("is_outgroup", F.coalesce("is_outgroup", F.lit(False)) & F.col("is_tip"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {k: None if pd.isna(v) else int(v) for k, v in zip(pdf.node_id, pdf.parent_id, strict=True)}
        length = dict(zip(pdf.node_id, pdf.branch_length, strict=True))
        out = [n for n, t in zip(pdf.node_id, pdf.is_outgroup, strict=True) if t]
        pdf = pdf.drop(columns="is_outgroup")
        if not out:
            return pdf.assign(note="outgroup absent")

        def path(n: int) -> list[int]:
            line = [n]
            while parent[line[-1]] is not None:
                line.append(parent[line[-1]])
            return line

        shared = set(path(out[0])).intersection(*(path(n) for n in out[1:]))
        top = next(n for n in path(out[0]) if n in shared)
        if parent[top] is None:
            return pdf.assign(note="outgroup spans the root")
        line, new = path(top)[1:], int(pdf.node_id.max()) + 1
        half = length[top] / 2 if length[top] == length[top] else length[top]
        old = dict(length)
        for child, above in zip(line, line[1:], strict=False):
            parent[above], length[above] = child, old[child]
        parent[top] = parent[line[0]] = new
        length[top] = length[line[0]] = half
        pdf = pdf.assign(parent_id=[parent[n] for n in pdf.node_id], branch_length=[length[n] for n in pdf.node_id], note="rooted")
        first = pdf.iloc[[0]].assign(node_id=new, parent_id=None, label=None, branch_length=None, support=None, is_tip=False)
        both = pd.concat([pdf, first], ignore_index=True)
        return both.assign(parent_id=both.parent_id.astype("Int64"))

    schema = "tree_id string, node_id long, parent_id long, label string, branch_length double, support double, is_tip boolean, note string"
    typed = nodes.select(F.col("tree_id").cast("string"), F.col("node_id").cast("long"), F.col("parent_id").cast("long"), "label", F.col("branch_length").cast("double"), F.col("support").cast("double"), "is_tip", "is_outgroup")
    return typed.groupBy("tree_id").applyInPandas(one, schema)


def prune(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Trees restricted to tips in ``keep(tip)`` or ``keep(tree_id, tip)``; nodes left with one child are merged into it.

    Kept nodes are tips and nodes with kept tips below two or more of their children; each hangs on its nearest kept ancestor,
    with the lengths between summed.  All steps double their reach and have a row for each node at most.
    """
    labels = intervals.climb(nodes, {})
    by = ["tree_id", "label"] if "tree_id" in keep.columns else ["label"]
    tips = nodes.where("is_tip").join(keep.withColumnRenamed("tip", "label").select(*by).distinct(), by, "left_semi").select(*KEY)
    alive = cut(labels.table.join(intervals.with_ancestors(labels, tips), KEY, "left_semi"))
    children = alive.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    kept = cut(children.where("k >= 2").select(*KEY).union(tips).distinct())
    marked = alive.join(kept.withColumn("kept", F.lit(True)), KEY, "left")
    up = intervals.nearest_kept(marked.select(*KEY, F.col("kept").isNull().alias("gone"), F.col("parent_id").alias("up")))
    depth = alive.select(*KEY, "depth")
    nearest = up.select(*KEY, F.col("up").alias("parent_id"))
    there = kept.join(nearest, KEY).join(depth, KEY).join(depth.select("tree_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("above")), ["tree_id", "parent_id"], "left")
    rest = nodes.select(*KEY, "label", "support", "is_tip")
    return there.join(rest, KEY).select(*KEY, "parent_id", "label", (F.col("depth") - F.col("above")).alias("branch_length"), "support", "is_tip")


# Split information, matching and transfer distances need whole split sets at once.


def assignment(cost: np.ndarray) -> float:
    """Least total cost of a one-to-one matching of rows to columns (rows <= columns).

    Shortest augmenting paths with potentials, vectorised over columns.
    """
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return float(sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


def phylogenetic_information_distance(one: np.ndarray, two: np.ndarray) -> float:
    """Normalised difference of shared split information of two 0/1 split matrices over n tips."""
    n = one.shape[1] if one.size else (two.shape[1] if two.size else 0)
    return _information_distance(n, one.sum(axis=1).astype(int), two.sum(axis=1).astype(int), (one.astype(np.int32) @ two.T.astype(np.int32)).astype(int) if n else np.zeros((len(one), len(two)), dtype=int))


def _information_distance(n: int, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> float:
    """The same from the sizes of sides over ``n`` tips and how many tips each two of them share."""
    steps = np.log2(np.maximum(np.arange(2 * n + 4), 1))
    odd = np.concatenate(([0.0], np.cumsum(steps[1::2])))  # log2 of the products of the odd numbers below 2 k
    unrooted, rooted = (np.array([odd[max(k - back, 0)] for k in range(top)]) for back, top in ((2, n + 3), (1, n + 1)))
    info = lambda s: unrooted[n] - rooted[s] - rooted[n - s]
    h1, h2 = info(a), info(b)
    total = h1.sum() + h2.sum()
    if not total:
        return 0.0
    shared = np.zeros((len(a), len(b)))
    only1, only2 = a[:, None] - both, b[None, :] - both
    neither = n - both - only1 - only2
    # Compatible splits have an empty intersection of sides; p and q are the sizes of disjoint sides.
    for empty, p, q in ((both, a[:, None], b[None, :]), (only1, a[:, None], n - b[None, :]), (only2, n - a[:, None], b[None, :]), (neither, n - a[:, None], n - b[None, :])):
        p, q = np.broadcast_arrays(p, q)
        at = (empty == 0) & (p + q <= n)
        joint = unrooted[n] - rooted[p[at]] - rooted[q[at]] - unrooted[n - p[at] - q[at] + 2]
        shared[at] = np.maximum(shared[at], (h1[:, None] + h2[None, :])[at] - joint)
    same = ((only1 == 0) & (only2 == 0)) | ((both == 0) & (neither == 0))
    shared[same] = np.broadcast_to(h1[:, None], shared.shape)[same]
    return float((total - 2 * best_matching(shared, same)) / total)


def best_matching(shared: np.ndarray, same: np.ndarray) -> float:
    """Most shared information of a one-to-one matching of the rows (splits of one tree) with the columns.

    Equal splits are paired first: shared information obeys the triangle inequality, so no matching loses by it.  What is left
    falls into parts that share nothing with each other, and each is matched alone.
    """
    best = float(shared[same].sum())
    rows, columns = ~same.any(axis=1), ~same.any(axis=0)
    rest = shared[np.ix_(rows, columns)]
    linked = rest > 0
    open_rows = linked.any(axis=1)
    while open_rows.any():
        part = np.zeros(len(rest), dtype=bool)
        part[int(open_rows.argmax())] = True
        while True:
            across = linked[part].any(axis=0)
            wider = linked[:, across].any(axis=1)
            if (wider == part).all():
                break
            part = wider
        cost = -rest[np.ix_(part, across)]
        best -= assignment(cost) if cost.shape[0] <= cost.shape[1] else assignment(cost.T)
        open_rows &= ~part
    return best


def tree_space(distances: DataFrame) -> DataFrame:
    """Classical scaling of a few hundred trees at most, on the driver: ``tree, dimension_1, dimension_2``.

    All distances null gives no rows; any null is an error; one dimension is padded with zero.
    """
    spark, rows = distances.sparkSession, distances.select("tree_1", "tree_2", "distance").collect()
    schema = "tree string, dimension_1 double, dimension_2 double"
    if not rows or all(r[2] is None for r in rows):
        return spark.createDataFrame([], schema)
    if any(r[2] is None for r in rows):
        raise ValueError("null distances in tree-space input")
    trees = sorted({t for r in rows for t in r[:2]})
    d = np.zeros((len(trees), len(trees)))
    for a, b, x in rows:
        i, j = trees.index(a), trees.index(b)
        d[i, j] = d[j, i] = x
    centre = np.eye(len(trees)) - 1 / len(trees)
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    k = min(2, len(trees) - 1)
    points = np.zeros((len(trees), 2))
    points[:, :k] = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
    return spark.createDataFrame([(t, float(p[0]), float(p[1])) for t, p in zip(trees, points, strict=True)], schema)


def support_fbp(reference: DataFrame, replicates: DataFrame) -> DataFrame:
    """``split, size, support``: share of replicate trees (nodes) that have each split of the reference tree (nodes).

    Replicates count on the tips of the reference; their splits are told by number and hashes of tips, so names
    are written out for the reference only.
    """
    tips = tip_table(reference)
    named = cut(_over_tips(reference, tips)[0].join(_sides(reference), KEY).select("split", "size", *SET).distinct())
    n = replicates.agg(F.countDistinct("tree_id").alias("n"))
    hits = splits_over(replicates, tips).groupBy(*SET).agg(F.count("*").alias("hits"))
    out = named.join(hits, SET, "left").crossJoin(F.broadcast(n))
    return out.select("split", "size", (F.coalesce("hits", F.lit(0)) / F.nullif("n", F.lit(0))).alias("support"))


def support_tbe(reference: DataFrame, replicates: DataFrame) -> DataFrame:
    """``split, size, support``: transfer support, 1 - mean over replicates of the least transfer distance / (p - 1).

    ``p`` is the smaller side of the split.  How many tips two sides share follows from how many tips hang on each two
    nodes of the reference and a replicate: those are counted once, and climb first the one tree and then the other.
    """
    tips = tip_table(reference)
    ref_splits, ref_sizes = _over_tips(reference, tips)
    named = ref_splits.join(_sides(reference), KEY).groupBy("split", "size", "n").agg(F.min("node_id").alias("node_id"))
    known = cut(named.join(ref_sizes, "node_id").select("split", "size", "n", F.col("node_id").alias("a"), F.col("k").alias("size_a")))
    rep_splits, rep_sizes = _over_tips(replicates, tips)
    each = rep_splits.groupBy("tree_id", *SET).agg(F.min("node_id").alias("node_id")).select(*KEY)
    others = cut(each.join(rep_sizes, KEY).select("tree_id", F.col("node_id").alias("b"), F.col("k").alias("size_b")))
    ref, rep = _typed(reference), _typed(replicates)
    up_ref, up_rep = (cut(intervals.ancestor_pairs(cut(x.where("NOT is_tip").select(*KEY, "parent_id", "branch_length")))) for x in (ref, rep))
    hang = ref.where("is_tip").select("label", F.col("parent_id").alias("p")).join(rep.where("is_tip").select("tree_id", "label", F.col("parent_id").alias("q")), "label")
    shared = cut(hang.groupBy("tree_id", "p", "q").agg(F.count("*").alias("c")))
    above = up_ref.select(F.col("node_id").alias("p"), F.col("above").alias("a")).join(known.select("a"), "a", "left_semi")
    shared = cut(shared.join(above, "p").groupBy("tree_id", "a", "q").agg(F.sum("c").alias("c")))
    above = up_rep.select("tree_id", F.col("node_id").alias("q"), F.col("above").alias("b")).join(others.select("tree_id", "b"), ["tree_id", "b"], "left_semi")
    shared = cut(shared.join(above, ["tree_id", "q"]).groupBy("tree_id", "a", "b").agg(F.sum("c").alias("c")))
    apart = F.col("size_a") + F.col("size_b") - 2 * F.coalesce("c", F.lit(0))
    met = known.select("a", "n", "size_a").crossJoin(others).join(shared, ["tree_id", "a", "b"], "left")
    least = met.groupBy("tree_id", "a").agg(F.min(F.least(apart, F.col("n") - apart)).alias("least"))
    p = F.least("size_a", F.col("n") - F.col("size_a"))
    every = known.crossJoin(rep.select("tree_id").distinct()).join(least, ["tree_id", "a"], "left")
    share = 1 - F.least(F.coalesce("least", p - 1), p - 1) / (p - 1)
    return every.groupBy("split", "size").agg(F.avg(share).alias("support"))


def convergence(replicates: DataFrame, permutations: int = 100, cutoff: float = 0.03, seed: int = 111) -> DataFrame:
    """Bootstopping: weighted RF distances of random halves of the replicate trees (nodes), which have the same tips.

    Each permutation deals the trees into two halves of equal size (of an odd number one tree sits out).
    The statistic is the sum of absolute differences of split counts over the sum of counts; replicates
    have converged if 99 % of the permutations stay within ``cutoff``.  Only the halves of numbered trees
    (one byte for each tree and permutation) are sent; each split's trees are one row.
    """
    ids = sorted(r[0] for r in replicates.select(F.col("tree_id").cast("string")).distinct().collect())
    rng, dealt = np.random.default_rng(seed), np.zeros((permutations, len(ids)), dtype=np.int8)
    for row in dealt:
        drawn = rng.permutation(len(ids))[: len(ids) // 2 * 2]
        row[drawn[: len(drawn) // 2]], row[drawn[len(drawn) // 2 :]] = 1, -1
    place = {t: k for k, t in enumerate(ids)}
    of_split = splits_over(replicates, tip_table(replicates)).groupBy(*SET).agg(F.collect_list("tree_id").alias("trees"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, total = np.zeros(permutations, dtype=np.int64), np.zeros(permutations, dtype=np.int64)
        for b in batches:
            for trees in b.column(0).to_pylist():
                own = dealt[:, [place[t] for t in trees]]
                apart += np.abs(own.sum(axis=1, dtype=np.int64))
                total += np.abs(own).sum(axis=1, dtype=np.int64)
        yield pa.record_batch([pa.array(np.arange(permutations)), pa.array(apart), pa.array(total)], names=["perm", "apart", "total"])

    sums = of_split.select("trees").mapInArrow(run, "perm long, apart long, total long").groupBy("perm").agg(F.sum("apart").alias("apart"), F.sum("total").alias("total"))
    wrf = sums.select((F.col("apart") / F.nullif("total", F.lit(0))).alias("wrf"))
    out = wrf.agg(F.avg("wrf").alias("mean_wrf"), F.avg(F.when(F.col("wrf") <= cutoff, 1.0).otherwise(0.0)).alias("share_within"))
    return out.withColumn("converged", F.coalesce(F.col("share_within") >= 0.99, F.lit(False)))


def annotate_tips(nodes: DataFrame, taxonomy: DataFrame, name: Column) -> DataFrame:
    """Taxonomy rows (first for a name, by ``ord``) of the tips of a tree; no match is an error."""
    columns = taxonomy.columns
    first = taxonomy.withColumn("label", name).groupBy("label").agg(F.min_by(F.struct(*columns), "ord").alias("r")).select("label", "r.*")
    found = first.join(nodes.where("is_tip").select("label").distinct(), "label", "left_semi")
    if found.isEmpty():
        raise ValueError("no tip of the tree is in the taxonomy")
    return found


def annotation_registry(nodes: DataFrame, tips: DataFrame, main_values: list[str], supplementary_min: int = 10) -> DataFrame:
    """Monophyletic groups of four annotation levels, and the failed ones of levels 2 to 4."""
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"level_{k}").alias("grp")) for k in range(1, 5)))).alias("l")
    groups = tips.select(levels, F.col("label").alias("tip")).select("l.level", "l.grp", "tip").where("grp IS NOT NULL AND grp != ''")
    found = group_nodes(nodes, groups, 2)
    supplementary = F.when(F.col("grp").isin(main_values), "level_4_main").when(F.col("n_tips") >= supplementary_min, "level_4_supp")
    layer = F.when(F.col("level") < 4, F.concat(F.lit("level_"), F.col("level").cast("string"))).otherwise(supplementary)
    failed = F.when(F.col("level") > 1, F.concat(F.lit("failed_"), F.col("level").cast("string")))
    return found.withColumn("layer", F.when(F.col("monophyletic"), layer).otherwise(failed)).where("layer IS NOT NULL").drop("level")


def augment_nodes(nodes: DataFrame, registry: DataFrame, layers: list[str]) -> DataFrame:
    """Nodes with the labels of each layer, sorted and joined by a bar."""
    wide = registry.groupBy("tree_id", F.col("mrca").alias("node_id")).pivot("layer", layers).agg(F.when(F.count("grp") > 0, F.array_join(F.array_sort(F.collect_set("grp")), " | ")))
    return nodes.join(wide, KEY, "left")


def node_positions(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, x, y``: distance from the root, and height in a drawing.

    Tips stand at 1, 2, ... in the order of a walk that takes children by node id; an inner node stands in the
    middle of its first and last child.  A tree is one task's work.
    """

    def one(tree: pa.Table) -> pa.Table:
        node, parent, length = (tree[c].to_pylist() for c in ("node_id", "parent_id", "branch_length"))
        children: dict = {}
        for n, p in sorted(zip(node, parent, strict=True)):
            children.setdefault(p, []).append(n)
        long = dict(zip(node, length, strict=True))
        x, y, tips, stack = {}, {}, 0, [(n, False) for n in reversed(children.get(None, []))]
        up = dict(zip(node, parent, strict=True))
        while stack:
            n, done = stack.pop()
            below = children.get(n, [])
            if done:
                y[n] = (y[below[0]] + y[below[-1]]) / 2
                continue
            x[n] = x[up[n]] + (long[n] or 0.0) if up[n] is not None else 0.0
            if below:
                stack.append((n, True))
                stack += [(c, False) for c in reversed(below)]
            else:
                tips += 1
                y[n] = float(tips)
        return pa.table([pa.array([tree["tree_id"][0].as_py()] * len(x), pa.string()), pa.array(list(x), pa.int64()), pa.array(list(x.values()), pa.float64()), pa.array([y[n] for n in x], pa.float64())], names=["tree_id", "node_id", "x", "y"])

    rows = nodes.select(F.col("tree_id").cast("string"), F.col("node_id").cast("long"), F.col("parent_id").cast("long"), F.col("branch_length").cast("double"))
    return rows.groupBy("tree_id").applyInArrow(one, "tree_id string, node_id long, x double, y double")


def clade_labels(nodes: DataFrame, registry: DataFrame, layers: list[str], offset: float = 0.03, offset_text: float = 0.004, descending: bool = True) -> DataFrame:
    """Labels to draw for each layer of an annotation registry: ``layer, ord, node_id, label, n_tips, x, y, bar_x, text_x``.

    One label for each node of a layer (the first by name), from the top of the drawing down or upwards, then
    by number of tips; bars and texts stand right of the tree by shares of its width.
    """
    at = cut(node_positions(nodes))
    width = at.groupBy("tree_id").agg(F.max("x").alias("right"), (F.max("x") - F.min("x")).alias("width"))
    chosen = registry.where(F.col("layer").isin(layers)).groupBy("tree_id", "layer", F.col("mrca").alias("node_id")).agg(F.min(F.struct(F.col("grp").alias("label"), "n_tips")).alias("l"))
    rows = chosen.select("tree_id", "layer", "node_id", "l.*").join(at, KEY).join(width, "tree_id")
    order = [F.desc("y") if descending else F.col("y"), F.desc("n_tips"), F.col("label")]
    bar = F.col("right") + F.col("width") * offset
    ranked = rows.withColumn("ord", F.row_number().over(Window.partitionBy("tree_id", "layer").orderBy(*order)))
    return ranked.select("tree_id", "layer", "ord", "node_id", "label", "n_tips", "x", "y", bar.alias("bar_x"), (bar + F.col("width") * offset_text).alias("text_x"))
