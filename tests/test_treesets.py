"""Interval labels, clade ages, distances of tree sets and bootstopping against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeweave.operators import clades, intervals, trees, treesets

NODES = "tree_id string, node_id long, parent_id long, label string, branch_length double, support double, is_tip boolean"


def random_tree(rng, tree_id, tips, ladder=False, unary=0.1):
    """Node rows of a random rooted tree; ids are shuffled, and some nodes have a single child."""
    rows, ids = [], list(range(3 * len(tips) + 10))
    rng.shuffle(ids)

    def add(parent, tips):
        node = ids.pop()
        rows.append([tree_id, node, parent, tips[0] if len(tips) == 1 else None, rng.randrange(1, 9) / 4, None, len(tips) == 1])
        if len(tips) > 1:
            if rng.random() < unary:
                node, parent = ids.pop(), node
                rows.append([tree_id, node, parent, None, rng.randrange(1, 9) / 4, None, False])
            cut = 1 if ladder else rng.randrange(1, len(tips))
            add(node, tips[:cut])
            add(node, tips[cut:])

    tips = list(tips)
    rng.shuffle(tips)
    add(None, tips)
    return [tuple(r) for r in rows]


def plain(rows):
    """Per node: parent, tips below, level, depth."""
    parent, length = {r[1]: r[2] for r in rows}, {r[1]: r[4] for r in rows}
    out = {r[1]: [r[2], set(), 0, 0.0] for r in rows}
    for r in rows:
        n, steps, far = r[1], 0, 0.0
        while n is not None:
            if r[6]:
                out[n][1].add(r[3])
            if parent[n] is not None:
                steps, far = steps + 1, far + length[n]
            n = parent[n]
        out[r[1]][2:] = [steps, far]
    return out


def split_sets(rows, common):
    sides = set()
    for _, below, _, _ in plain(rows).values():
        side = frozenset(below & common)
        if 2 <= len(side) <= len(common) - 2:
            sides.add(min(side, frozenset(common) - side, key=lambda s: (min(common) in s, len(s))))
    return sides


def rf(one, two):
    common = {r[3] for r in one if r[6]} & {r[3] for r in two if r[6]}
    if len(common) < 3:
        return len(common), None
    a, b = split_sets(one, common), split_sets(two, common)
    return len(common), (len(a ^ b) / (len(a) + len(b)) if a or b else 0.0)


@pytest.mark.parametrize("seed", range(2))
def test_interval_labels_and_groups_of_random_trees(spark, seed):
    rng = random.Random(seed)
    forest = {f"t{k}": random_tree(rng, f"t{k}", [f"x{j}" for j in range(rng.choice([1, 2, 7, 30]))], ladder=k == 0) for k in range(5)}
    nodes = spark.createDataFrame([r for t in forest.values() for r in t], NODES)
    labels = intervals.interval_labels(nodes)
    got = {(r.tree_id, r.node_id): r for r in labels.table.collect()}
    assert len(got) == sum(map(len, forest.values()))
    for tree, rows in forest.items():
        want = plain(rows)
        own = {n: got[tree, n] for n in want}
        assert sorted(r.enter for r in own.values()) == list(range(len(rows)))
        for n, (parent, tips, level, depth) in want.items():
            r = own[n]
            assert (r.parent_id, r.n_tips, r.level) == (parent, len(tips), level) and math.isclose(r.depth, depth)
            inside = {m for m, o in own.items() if r.enter <= o.enter <= r.leave}
            assert inside == {m for m in want if m == n or _is_above(want, n, m)}
    groups = [(f"g{k}", t) for k in range(6) for t in rng.sample([f"x{j}" for j in range(30)], rng.choice([1, 2, 3, 9]))]
    found = {(r.tree_id, r.grp): r for r in trees.group_nodes(nodes, spark.createDataFrame(groups, "grp string, tip string"), labels=labels).collect()}
    for tree, rows in forest.items():
        want, tips = plain(rows), {r[3] for r in rows if r[6]}
        for g in {g for g, _ in groups}:
            members = {t for h, t in groups if h == g} & tips
            if len(members) < 2:
                assert (tree, g) not in found
                continue
            holds = [n for n, x in want.items() if members <= x[1]]
            mrca = max(holds, key=lambda n: want[n][2])
            r = found.pop((tree, g))
            assert (r.mrca, r.n_tips, r.n_below, r.monophyletic) == (mrca, len(members), len(want[mrca][1]), want[mrca][1] == members)
    assert not found


def _is_above(want, upper, lower):
    n = want[lower][0]
    while n is not None and n != upper:
        n = want[n][0]
    return n is not None


def test_rounds_on_a_long_ladder_are_linear(spark):
    """A ladder of 100,000 tips: every table has a row for each node at most."""
    n = 100_000
    k = F.col("id")
    spine = spark.range(n - 1).select(F.lit("L").alias("tree_id"), k.alias("node_id"), F.when(k > 0, k - 1).alias("parent_id"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("branch_length"), F.lit(False).alias("is_tip"))
    tips = spark.range(n).select(F.lit("L"), k + n, F.least(k, F.lit(n - 2)), F.concat(F.lit("x"), k.cast("string")), F.lit(1.0), F.lit(True))
    nodes = intervals.cut(spine.union(tips))
    labels = intervals.interval_labels(nodes)
    assert len(labels.lifts) == 17 and max(x.count() for x in labels.lifts) < 2 * n
    assert labels.table.count() == 2 * n - 1
    groups = spark.createDataFrame([("a", "x10"), ("a", "x99999"), ("b", "x99998"), ("b", "x99999")], "grp string, tip string")
    found = {r.grp: (r.mrca, r.n_below, r.monophyletic) for r in trees.group_nodes(nodes, groups, labels=labels).collect()}
    assert found == {"a": (10, n - 10, False), "b": (n - 2, 2, True)}


def test_pruned_random_trees_keep_splits_and_distances(spark):
    rng = random.Random(5)
    tips = [f"x{j}" for j in range(14)]
    forest = {f"t{k}": random_tree(rng, f"t{k}", tips, ladder=k == 1) for k in range(3)}
    keep = {"t0": tips[:6], "t1": tips[3:12], "t2": tips[4:5]}
    nodes = spark.createDataFrame([r for t in forest.values() for r in t], NODES)
    kept = spark.createDataFrame([(t, x) for t, xs in keep.items() for x in xs], "tree_id string, tip string")
    got: dict = {}
    for r in trees.prune(nodes, kept).collect():
        got.setdefault(r.tree_id, []).append((r.tree_id, r.node_id, r.parent_id, r.label, r.branch_length or 0.0, None, r.is_tip))
    for t, rows in got.items():
        before, after = plain(forest[t]), plain(rows)
        assert {r[3] for r in rows if r[6]} == set(keep[t]) and len(rows) == max(1, 2 * len(keep[t]) - 1)
        for n, (_, below, _, depth) in after.items():
            assert below == before[n][1] & set(keep[t])
            top = next(m for m, x in after.items() if x[0] is None)
            assert math.isclose(depth, before[n][3] - before[top][3], abs_tol=1e-9)


def test_clade_ages_against_plain_sets(spark):
    rng = random.Random(3)
    tips = [f"x{j}" for j in range(9)]
    target = random_tree(rng, "A", tips, unary=0)
    reps = {str(k): random_tree(rng, str(k), tips + ["extra"] if k % 2 else tips[:-1] if k == 4 else tips) for k in range(6)}
    for k in (6, 7, 8):  # the target's own shape, dated otherwise
        reps[str(k)] = [(str(k), n, p, x, y * (1 + k / 7), s, t) for _, n, p, x, y, s, t in target]
    want = {}
    for n, (_, clade, _, _) in plain(target).items():
        if len(clade) >= 2:
            ages = []
            for rows in reps.values():
                found = plain(rows)
                far = max(found[r[1]][3] for r in rows if r[6])
                own = [far - d for _, below, _, d in found.values() if below & set(tips) == clade]
                ages += [min(own)] if own else []
            k = math.ceil(0.5 * len(ages))
            spans = [(b - a, a, b) for a, b in zip(sorted(ages), sorted(ages)[k - 1 :])] if ages else []
            want[n] = (len(clade), len(ages), len(ages) / len(reps), sum(ages) / len(ages) if ages else None, *(min(spans)[1:] if spans else (None, None)))
    frame = lambda rows: spark.createDataFrame(rows, NODES)
    got = {r.node: tuple(r)[1:] for r in clades.clade_age_intervals(frame(target), frame([r for t in reps.values() for r in t]), share=0.5).collect()}
    assert got.keys() == want.keys() and any(w[1] < len(reps) for w in want.values())
    for n, w in want.items():
        assert got[n][:2] == w[:2] and np.allclose([got[n][2], got[n][3]], [w[2], w[3]]) and np.allclose(got[n][5] - got[n][4], w[5] - w[4])
    none = clades.clade_age_intervals(frame(target), frame(random_tree(rng, "z", ["q1", "q2"])))
    assert {tuple(r)[2:] for r in none.collect()} == {(0, 0.0, None, None, None)}


@pytest.mark.parametrize(("blocks", "sets"), [(2, 2), (50, 3)])
def test_tree_set_distances_against_plain_splits(spark, blocks, sets):
    rng = random.Random(blocks)
    tips = [f"x{j}" for j in range(10)]
    forest = {f"t{k}": random_tree(rng, f"t{k}", tips if k < 6 else rng.sample(tips, rng.choice([2, 4, 8]))) for k in range(10)}
    forest["t2"] = [("t2", *r[1:]) for r in forest["t1"]]
    order = spark.createDataFrame([(t, k) for k, t in enumerate(forest)], "tree_id string, ord int")
    nodes = spark.createDataFrame([r for t in forest.values() for r in t], NODES)
    got = {(r.tree_1, r.tree_2): (r.n_common_tips, r.rf) for r in treesets.tree_set_rf(nodes, order, blocks, sets).collect()}
    want = {(b, a): rf(forest[a], forest[b]) for a, b in itertools.combinations(forest, 2)}
    assert got.keys() == want.keys()
    for pair, (n, d) in want.items():
        assert got[pair][0] == n and (got[pair][1] is None if d is None else math.isclose(got[pair][1], d)), pair


def plain_consensus(sets, counts):
    taken = []
    for s in sorted(sets, key=lambda s: -counts[s]):
        if counts[s] and all(not s & t or s <= t or t <= s for t in taken):
            taken.append(s)
    return taken


def test_consensus_and_its_form_without_a_table():
    rng = np.random.default_rng(1)
    for n in (6, 9):
        bits = np.unique(np.array([x for x in rng.integers(0, 2, (60, n), dtype=np.uint8) if 2 <= x.sum() <= n - 2 and not x[0]]), axis=0)
        counts = rng.integers(0, 7, len(bits)).astype(np.float32)
        taken = treesets.consensus(np.arange(len(bits)), counts, treesets.compatibility(bits))
        sets = [frozenset(np.flatnonzero(b).tolist()) for b in bits]
        want = plain_consensus(sets, dict(zip(sets, counts.tolist(), strict=True)))
        assert [sets[k] for k in taken] == want
        there = np.flatnonzero(counts > 0)
        assert [sets[there[k]] for k in treesets._greedy(bits[there], counts[there])] == want


def test_bootstopping_against_plain_halves(spark):
    rng = random.Random(4)
    tips = [f"x{j}" for j in range(7)]
    forest = [random_tree(rng, str(k), tips, unary=0) for k in range(9)]
    nodes = spark.createDataFrame([r for t in forest for r in t], NODES)
    got = {r.n_trees: (r.mean_wrf, r.share_within, r.converged) for r in treesets.bootstopping(nodes, step=4, permutations=7, cutoff=0.6, share=0.5, seed=2, per_task=3).collect()}
    sides = [{min(s, frozenset(tips) - s, key=lambda x: min(tips) in x) for s in split_sets(t, set(tips))} for t in forest]
    names = sorted(tips)
    bit = lambda s: sum(1 << names.index(t) for t in s).to_bytes(1, "little")
    assert sorted(got) == [4, 8, 9]
    for m in got:
        found = []
        for p in range(7):
            supports = []
            for half in treesets.halves(m, m, p, 2):
                every = sorted(set().union(*(sides[k] for k in range(m))), key=bit)
                counts = {s: sum(s in sides[k] for k in half) for s in every}
                supports.append({s: counts[s] / len(half) for s in plain_consensus(every, counts)})
            one, two = supports
            total = sum(one.values()) + sum(two.values())
            found.append(sum(abs(one.get(s, 0) - two.get(s, 0)) for s in one.keys() | two.keys()) / total)
        assert np.allclose(got[m][:2], [np.mean(found), np.mean([x <= 0.6 for x in found])]) and got[m][2] == (np.mean([x <= 0.6 for x in found]) >= 0.5)


def test_bootstopping_tells_agreeing_from_random_trees(spark):
    rng = random.Random(6)
    tips = [f"x{j}" for j in range(12)]
    one = random_tree(rng, "0", tips, unary=0)
    same = [(str(k), *r[1:]) for k in range(60) for r in one]
    other = [r for k in range(60) for r in random_tree(rng, str(k), tips, unary=0)]
    run = lambda rows: [(r.n_trees, r.converged) for r in treesets.bootstopping(spark.createDataFrame(rows, NODES), permutations=50).orderBy("n_trees").collect()]
    assert run(same) == [(50, True), (60, True)] and run(other) == [(50, False), (60, False)]
    assert treesets.bootstopping(spark.createDataFrame(one, NODES)).count() == 0


def test_information_distance_against_all_matchings():
    rng = random.Random(12)
    for n in (6, 7, 9, 9, 12):
        tips = [f"x{j}" for j in range(n)]
        one = random_tree(rng, "a", tips, unary=0)
        two = one if n == 12 else random_tree(rng, "b", tips, unary=0)
        if n == 9:  # share some splits
            two = _joined(rng, tips[:5], tips[5:], one)
        bits = [np.array(sorted([1 if t in side else 0 for t in tips] for side in split_sets(x, set(tips))), dtype=np.uint8).reshape(-1, n) for x in (one, two)]
        bits = [np.where(b[:, :1] == 1, 1 - b, b) for b in bits]
        a, b = bits
        got = trees.phylogenetic_information_distance(a, b)
        full = _plain_information(a, b)
        assert math.isclose(got, full, abs_tol=1e-9), n


def _joined(rng, left, right, one):
    """A tree that has the split between ``left`` and ``right``."""
    rows, at = [], 1000
    rows.append(("b", 999, None, None, 1.0, None, False))
    for part in (left, right):
        for r in random_tree(rng, "b", part, unary=0):
            rows.append(("b", at + r[1], 999 if r[2] is None else at + r[2], *r[3:]))
        at += 1000
    return rows


def _plain_information(a, b):
    """The distance with the best of all one-to-one matchings, tried one by one."""
    n = a.shape[1]
    double = lambda m: sum(math.log2(k) for k in range(m, 0, -2)) if m > 0 else 0.0
    unrooted = lambda k: double(2 * k - 5) if k >= 3 else 0.0
    rooted = lambda k: double(2 * k - 3) if k >= 2 else 0.0
    info = lambda k: unrooted(n) - rooted(k) - rooted(n - k)

    def shared(x, y):
        sides = [(set(np.flatnonzero(x)), set(np.flatnonzero(1 - x))), (set(np.flatnonzero(y)), set(np.flatnonzero(1 - y)))]
        if sides[0][0] in sides[1]:
            return info(len(sides[0][0]))
        best = 0.0
        for p in sides[0]:
            for q in sides[1]:
                if not p & q:
                    joint = unrooted(n) - rooted(len(p)) - rooted(len(q)) - unrooted(n - len(p) - len(q) + 2)
                    best = max(best, info(len(p)) + info(len(q)) - joint)
        return best

    table = [[shared(x, y) for y in b] for x in a]
    if len(a) > len(b):
        table = [list(r) for r in zip(*table, strict=True)]

    def most(k, free):
        if k == len(table):
            return 0.0
        return max(table[k][j] + most(k + 1, free - {j}) for j in free)

    total = sum(info(int(x.sum())) for x in (*a, *b))
    wide = max(len(a), len(b))
    return (total - 2 * (most(0, frozenset(range(wide))) if len(table) else 0.0)) / total if total else 0.0


def test_only_inner_nodes_climb_and_few_tips_stand_for_all(spark):
    """Many tips on few nodes: tables of rounds do not grow with the tips, nor do the bit sets of bootstopping."""
    n, inner = 2000, [(0, None), (1, 0), (2, 0), (3, 1)]
    rows = [(t, i, p, None, 1.0, None, False) for t in ("1", "2") for i, p in inner]
    rows += [(t, 10 + j, 1 + (j + int(t) * (j % 2)) % 3, f"x{j:04}", 1.0, None, True) for t in ("1", "2") for j in range(n)]
    nodes = spark.createDataFrame(rows, NODES)
    held = intervals.inner_nodes(nodes, trees.tip_sums())
    assert held.count() == 8 and held.groupBy("tree_id").agg(F.sum("k").alias("k")).where(f"k = {n}").count() == 2
    names, tips = treesets.representatives(nodes)
    assert tips == n and len(names) == 12  # two tips of each of six classes
    order = spark.createDataFrame([("1", 1), ("2", 2)], "tree_id string, ord int")
    by_tree = [[r for r in rows if r[0] == t] for t in ("1", "2")]
    assert [(r.n_common_tips, r.rf) for r in treesets.tree_set_rf(nodes, order).collect()] == [rf(*by_tree)]
    sets = nodes.where("is_tip").selectExpr("'X' AS analysis_id", "tree_id AS tree", "label", "label AS taxon")
    assert [tuple(r) for r in trees.common_tip_counts(sets, order).collect()] == [("X", "2", "1", n)]
