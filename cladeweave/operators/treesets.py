"""Distances within large sets of trees, and whether a set of bootstrap trees is large enough.

``tree_set_rf`` compares all pairs of a set.  Splits come from one climb of all trees together, as the number of tips and
two 64-bit hashes of the tips on a side; those that two trees or more have get a number, and a tree becomes the sorted
array of its numbers.  Blocks of trees meet in pairs, and a task counts the common splits of a pair of blocks by a
product of 0/1 matrices over the splits that both blocks have.  Trees with other tips are compared on each pair's common
tips, which are added up on their parents in either tree before anything climbs.

``bootstopping`` is the criterion of Pattengale et al. (2010) on extended majority-rule consensus trees: random halves of
the first 50, 100, ... trees are summarised apart, and the weighted Robinson-Foulds distance of the two summaries
tells whether more trees would change the picture.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.operators import intervals
from cladeweave.operators.lineage import cut
from cladeweave.operators.trees import SET, climbed_sums, common_splits, one_sided, split_bits, tip_sums

BLOCK_TREES = 256
#: Splits (or tips) of a product at a time; splits whose compatibility is held as a matrix.
COLUMNS, MATRIX_SPLITS = 8192, 8192
_RF = "tree_1 string, tree_2 string, n_common_tips long, rf double"


def split_sets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree_id, k, h1, h2``: the distinct non-trivial splits of each tree; and ``tree_id, n, t1, t2``: number and hashes of its tips.

    A split is named by its side of fewer tips, or of the smaller hashes.
    """
    inner = intervals.inner_nodes(nodes, tip_sums())
    found = climbed_sums(inner).withColumn("tree_id", F.col("tree_id").cast("string"))
    alone = nodes.where("is_tip AND parent_id IS NULL").groupBy("tree_id").agg(*(c.alias(n) for n, c in tip_sums().items()))
    sums = inner.select("tree_id", *SET).unionByName(alone).groupBy(F.col("tree_id").cast("string").alias("tree_id"))
    whole = cut(sums.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("h1"), F.lit(0)).alias("t1"), F.coalesce(F.bit_xor("h2"), F.lit(0)).alias("t2")))
    return cut(one_sided(found.join(whole, "tree_id"), "tree_id").distinct()), whole


def _common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Numbers that each array of ``one`` shares with each of ``two`` (all sorted, without repeats)."""
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo : lo + COLUMNS]
        sides = []
        for arrays in (one, two):
            x = np.zeros((len(arrays), len(part)), dtype=np.float32)
            for row, a in zip(x, arrays, strict=True):
                at = np.searchsorted(part, a)
                hit = at < len(part)
                row[at[hit][part[at[hit]] == a[hit]]] = 1
            sides.append(x)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _pairs_of_blocks(trees: DataFrame, group: list[str], most: int) -> DataFrame:
    """``trees`` (with ``ord``) as both sides (0 and 1) of every pair of blocks, or alone (2): ``pair``, ``side`` and the trees' columns; no block has more than about ``most``."""
    counts = trees.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("long").alias("blocks"))
    dealt = trees.join(counts, group) if group else trees.crossJoin(F.broadcast(counts))  # one row
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("tree_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = dealt.select("*", other).withColumn("pair", F.concat_ws("/", *group, F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return met.withColumn("side", side).drop("blocks", "block", "other")


def _emit(ids: list, orders: list, i: np.ndarray, j: np.ndarray, n: np.ndarray, rf: np.ndarray) -> pa.Table:
    """Rows of pairs; the later tree is first, and null distances stay null."""
    swap = np.array([orders[a] < orders[b] for a, b in zip(i, j, strict=True)], dtype=bool)
    first, second = np.where(swap, j, i), np.where(swap, i, j)
    return pa.table([pa.array([ids[a] for a in first], pa.string()), pa.array([ids[b] for b in second], pa.string()), pa.array(n, pa.int64()), pa.array(rf, pa.float64(), mask=np.isnan(rf))], names=[x.split()[0] for x in _RF.split(", ")])


def tree_set_rf(nodes: DataFrame, order: DataFrame, block_trees: int = BLOCK_TREES, block_sets: int | None = None) -> DataFrame:
    """``tree_1, tree_2, n_common_tips, rf`` of all pairs of trees; ``order``: ``tree_id, ord`` (distinct), ``tree_1`` is the later tree.

    Distances are normalised by the number of splits of both trees on the pair's common tips; they are null below three common tips,
    and zero if neither tree has a split there.  ``block_sets`` has no effect any more: trees with other tips are not gathered.
    """
    splits, tips = split_sets(nodes)
    order = order.select(F.col("tree_id").cast("string").alias("tree_id"), "ord")
    key = ["k", "h1", "h2"]
    shared = cut(splits.groupBy(*key).agg(F.count("*").alias("trees")).where("trees > 1").select(*key, F.monotonically_increasing_id().alias("no")))
    numbered = splits.join(shared, key, "left").groupBy("tree_id").agg(F.array_sort(F.collect_list("no")).alias("numbers"), F.count("*").alias("n_splits"))
    whole = tips.join(order, "tree_id").join(numbered, "tree_id", "left").select("tree_id", "ord", "n", "t1", "t2", F.coalesce("numbers", F.array().cast("array<long>")).alias("numbers"), F.coalesce("n_splits", F.lit(0)).alias("n_splits"))
    trees = cut(whole)

    def same_tips(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        ids, orders, sizes = group["tree_id"].to_pylist(), group["ord"].to_pylist(), group["n_splits"].to_numpy()
        arrays = [np.asarray(x.values.to_numpy() if x.is_valid else [], dtype=np.int64) for x in group["numbers"]]
        alone = bool((side == 2).any())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = _common_counts([arrays[k] for k in left], [arrays[k] for k in right]) if len(left) and len(right) else np.zeros((len(left), len(right)), np.int64)
        i, j = np.triu_indices(len(left), 1) if alone else (x.ravel() for x in np.indices(common.shape))
        total = sizes[left][i] + sizes[right][j]
        rf = np.where(total > 0, (total - 2 * common[i, j]) / np.maximum(total, 1), 0.0)
        n = np.repeat(group["n"][0].as_py(), len(i)) if len(group) else np.empty(0, np.int64)
        return _emit(ids, orders, left[i], right[j], n, np.where(n >= 3, rf, np.nan))

    met = _pairs_of_blocks(trees, ["n", "t1", "t2"], block_trees).select("pair", "side", "tree_id", "ord", "n", "n_splits", "numbers")
    equal = met.groupBy("pair").applyInArrow(same_tips, _RF)
    kinds = trees.select("n", "t1", "t2").distinct()
    if kinds.limit(2).count() < 2:
        return equal
    return equal.unionByName(_different_tips(nodes, trees.select("tree_id", "ord", F.xxhash64("n", "t1", "t2").alias("kind"))))


def _different_tips(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """As ``tree_set_rf``, of the pairs whose tips differ (``trees``: ``tree_id, ord, kind``): splits of each pair's common tips, by ``common_splits``."""
    one, two = (trees.select(F.col("tree_id").alias(f"tree_{k}"), F.col("ord").alias(f"ord_{k}"), F.col("kind").alias(f"kind_{k}")) for k in (1, 2))
    pairs = cut(one.join(two, (F.col("ord_1") > F.col("ord_2")) & (F.col("kind_1") != F.col("kind_2"))).select("tree_1", "tree_2").withColumn("pair", F.monotonically_increasing_id().cast("string")))
    own = nodes.select(F.col("tree_id").cast("string").alias("tree"), "node_id", "parent_id", "branch_length", "label", F.coalesce("is_tip", F.lit(False)).alias("is_tip"))
    tips = own.where("is_tip").select("tree", "label", F.col("parent_id").alias("node"))
    tips = cut(tips.join(trees.select(F.col("tree_id").alias("tree"), "ord", "kind"), "tree"))
    x, y = (tips.select("label", *(F.col(c).alias(f"{c}_{k}") for c in ("tree", "node", "ord", "kind"))) for k in (1, 2))
    met = x.join(y, "label").where("ord_1 > ord_2 AND kind_1 <> kind_2").join(pairs, ["tree_1", "tree_2"]).select("pair", "node_1", "node_2", F.col("label").alias("name"))
    inner = cut(own.where("NOT is_tip").select("tree", "node_id", "parent_id", "branch_length"))
    return pairs.join(common_splits(met, inner, pairs), "pair").select("tree_1", "tree_2", "n_common_tips", "rf")


# Bootstopping


def consensus(order: np.ndarray, counts: np.ndarray, compatible: np.ndarray) -> np.ndarray:
    """Splits of the extended majority-rule consensus: taken by falling count (ties in ``order``) while compatible with all taken before."""
    ranked = order[np.argsort(-counts[order], kind="stable")]
    alive = counts[ranked] > 0
    taken, at = [], 0
    while at < len(ranked):
        following = np.flatnonzero(alive[at:])
        if not len(following):
            break
        at += int(following[0])
        taken.append(at)
        alive &= compatible[ranked[at], ranked]
        at += 1
    return ranked[taken]


def compatibility(bits: np.ndarray) -> np.ndarray:
    """Which pairs of sides (0/1 rows, none with the first tip) are disjoint or nested."""
    size = bits.sum(axis=1).astype(np.float32)
    both = np.zeros((len(bits), len(bits)), dtype=np.float32)
    for lo in range(0, bits.shape[1], COLUMNS):
        x = bits[:, lo : lo + COLUMNS].astype(np.float32)
        both += x @ x.T
    return (both == 0) | (both == size[:, None]) | (both == size[None, :])


def weighted_rf(one: np.ndarray, two: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> float:
    """Sum of the differences of support of the splits in either consensus, over the sum of their supports (zero without any split)."""
    s1, s2 = np.zeros(len(f1)), np.zeros(len(f2))
    s1[one], s2[two] = f1[one], f2[two]
    total = s1.sum() + s2.sum()
    return float(np.abs(s1 - s2).sum() / total) if total else 0.0


def halves(n: int, step: int, permutation: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two random halves of ``n`` trees of equal size (of an odd number one sits out)."""
    drawn = np.random.default_rng([seed, step, permutation]).permutation(n)[: n // 2 * 2]
    return drawn[: n // 2], drawn[n // 2 :]


def representatives(replicates: DataFrame) -> tuple[list[str], int]:
    """Tips that stand for all of them in the splits of these trees, and the number of all tips.

    Tips that hang on the same node in every tree are on the same side of every split.  Of each such class the first and the last one
    stay (one alone, if there is no other), so sides of two tips or more keep two, and different sides stay different.  They come in
    the order in which sides are compared as bit sets over all tips by name, eight a byte; a tip of the first tip's class is first.
    """
    tips = replicates.where("is_tip AND label IS NOT NULL").select(F.col("tree_id").cast("string").alias("tree_id"), "parent_id", "label")
    hangs = [F.bit_xor(F.xxhash64(F.lit(seed), "tree_id", "parent_id")).alias(f"h{seed}") for seed in (1, 2)]
    numbered = cut(intervals.running_totals(tips.groupBy("label").agg(*hangs).withColumn("one", F.lit(1)), [], ["label"], "one", "place"))
    own = F.struct((F.floor(F.col("place") / 8) * 8 + 7 - F.col("place") % 8).alias("rank"), "label")
    classes = numbered.groupBy("h1", "h2").agg(F.min(own).alias("low"), F.max(own).alias("high"), (F.min("place") > 0).alias("later"))
    rows = classes.select("later", F.explode(F.array_distinct(F.array("low", "high"))).alias("t")).select("later", "t.rank", "t.label").collect()
    return [r.label for r in sorted(rows, key=lambda r: (r.later, r["rank"]))], numbered.count()


def bootstopping(replicates: DataFrame, step: int = 50, permutations: int = 1000, cutoff: float = 0.03, share: float = 0.99, seed: int = 111, per_task: int = 100) -> DataFrame:
    """``n_trees, mean_wrf, share_within, converged``: a row for each number of trees (``step`` more each; all trees at last).

    For each of ``permutations`` random halves of the first trees (by id: shorter first, then by text), the weighted RF distance of the extended
    majority-rule consensus trees is taken; the set has converged where ``share`` of them are within ``cutoff``.
    Trees have the same tips.  A task works on ``per_task`` permutations of a step and holds the distinct splits of the trees of that
    step: a bit for each tip that ``representatives`` keeps and a bit for each tree, and the compatibility of those that two trees or more have.
    """
    spark = replicates.sparkSession
    ids = sorted((r[0] for r in replicates.select(F.col("tree_id").cast("string")).distinct().collect()), key=lambda x: (len(x), x))
    schema = "n_trees int, mean_wrf double, share_within double, converged boolean"
    if len(ids) < 2:
        return spark.createDataFrame([], schema)
    steps = sorted({*range(step, len(ids) + 1, step), len(ids)})
    names, n_tips = representatives(replicates)
    stand = spark.createDataFrame([(x,) for x in names], "label string")
    inner = replicates.where("NOT coalesce(is_tip, false)")
    small = inner.unionByName(replicates.where("is_tip").join(stand, "label", "left_semi").select(inner.columns))
    numbers = spark.createDataFrame([(t, k) for k, t in enumerate(ids)], "tree_id string, tree_no int")
    of_split = cut(split_bits(small, names).join(numbers, "tree_id").groupBy("bits").agg(F.array_sort(F.collect_list("tree_no")).alias("trees")))
    # Every share of a step's permutations needs all splits that its trees have.
    rows = of_split.withColumn("n_trees", F.explode(F.array(*map(F.lit, steps)))).where(F.col("trees")[0] < F.col("n_trees"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(per_task))))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        m, first = (x.as_py() for x in key)
        raw = np.frombuffer(b"".join(x.as_py() for x in group["bits"]), np.uint8).reshape(len(group), -1)
        held = np.zeros((len(group), m), dtype=np.float32)
        for row, trees in zip(held, group["trees"], strict=True):
            own = np.asarray(trees.values)
            row[own[own < m]] = 1
        bits = np.unpackbits(raw, axis=1, count=len(names), bitorder="little")
        packed = np.packbits(bits, axis=1)
        order = np.array(sorted(range(len(bits)), key=lambda k: packed[k].tobytes()), dtype=np.int64)
        test = compatibility(bits) if len(bits) <= MATRIX_SPLITS else None
        found = []
        for p in range(first, min(first + per_task, permutations)):
            parts = halves(m, m, p, seed)
            counts = [held[:, h].sum(axis=1) for h in parts]
            sides = []
            for c in counts:
                if test is not None:
                    sides.append(consensus(order, c, test))
                else:
                    there = order[c[order] > 0]
                    sides.append(there[_greedy(bits[there], c[there], n_tips - 3)])
            found.append(weighted_rf(*sides, *(c / max(len(h), 1) for c, h in zip(counts, parts, strict=True))))
        return pa.table([pa.array([m] * len(found), pa.int32()), pa.array(found, pa.float64())], names=["n_trees", "wrf"])

    apart = rows.groupBy("n_trees", "first").applyInArrow(run, "n_trees int, wrf double")
    out = apart.groupBy("n_trees").agg(F.avg("wrf").alias("mean_wrf"), F.avg(F.when(F.col("wrf") <= cutoff, 1.0).otherwise(0.0)).alias("share_within"))
    every = spark.createDataFrame([(m,) for m in steps], "n_trees int")  # trees without any split agree
    out = every.join(out, "n_trees", "left").select("n_trees", F.coalesce("mean_wrf", F.lit(0.0)).alias("mean_wrf"), F.coalesce("share_within", F.lit(1.0)).alias("share_within"))
    return out.withColumn("converged", F.col("share_within") >= share)


def _greedy(bits: np.ndarray, counts: np.ndarray, most: int | None = None) -> list[int]:
    """``consensus`` without a table of all pairs: each split is tested against those taken (``most`` at last, as many as a tree can have)."""
    most = bits.shape[1] - 3 if most is None else most
    taken: list[int] = []
    size = bits.sum(axis=1).astype(np.int64)
    for k in np.argsort(-counts, kind="stable").tolist():
        if len(taken) == most:
            break
        if taken:
            both = bits[taken].astype(np.int64) @ bits[k].astype(np.int64)
            if not ((both == 0) | (both == size[k]) | (both == size[taken])).all():
                continue
        taken.append(k)
    return taken
