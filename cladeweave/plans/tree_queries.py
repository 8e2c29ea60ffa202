"""Queries of trees, tip sets and supports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeweave.functions import names
from cladeweave.operators import clades, taxa, trees, treesets
from cladeweave.plans.catalogue import register
from cladeweave.sources.adapters import canonical

TREES = ["A", "B", "C"]


def _a(s, d):
    return canonical(s, d, "tree_a")


def _order(s):
    return s.createDataFrame([(t, k) for k, t in enumerate(TREES)], "tree_id string, ord int")


_UP = "WITH RECURSIVE up AS (SELECT tree_id, node_id, node_id AS anc, parent_id AS nxt, 0 AS steps FROM {0} UNION ALL SELECT u.tree_id, u.node_id, t.node_id, t.parent_id, u.steps + 1 FROM up u JOIN {0} t ON u.tree_id = t.tree_id AND u.nxt = t.node_id)"
_BELOW = _UP + ", below AS (SELECT u.tree_id, u.anc AS node_id, t.label AS tip FROM up u JOIN {0} t ON u.tree_id = t.tree_id AND u.node_id = t.node_id WHERE t.is_tip)"
_DEPTH = "WITH RECURSIVE down AS (SELECT node_id, 0.0::DOUBLE AS depth FROM tree_a WHERE parent_id IS NULL UNION ALL SELECT t.node_id, d.depth + t.branch_length FROM tree_a t JOIN down d ON t.parent_id = d.node_id)"
_SPLIT = (
    _BELOW + ", tot AS (SELECT tree_id, min(tip) AS first_tip, count(DISTINCT tip) AS n FROM below GROUP BY tree_id), sized AS (SELECT b.tree_id, b.node_id, count(DISTINCT b.tip) AS k, max(CASE WHEN b.tip = t.first_tip THEN 1 ELSE 0 END) AS has, any_value(t.n) AS n "
    "FROM below b JOIN tot t ON b.tree_id = t.tree_id GROUP BY b.tree_id, b.node_id), inner_nodes AS (SELECT * FROM sized WHERE k >= 2 AND k <= n - 2), "
    "one_side AS (SELECT b.tree_id, b.node_id, string_agg(DISTINCT b.tip, ',' ORDER BY b.tip) AS split, any_value(i.k) AS size FROM below b JOIN inner_nodes i ON b.tree_id = i.tree_id AND b.node_id = i.node_id WHERE i.has = 0 GROUP BY b.tree_id, b.node_id), "
    "other_side AS (SELECT i.tree_id, i.node_id, string_agg(a.tip, ',' ORDER BY a.tip) AS split, any_value(i.n - i.k) AS size FROM inner_nodes i JOIN (SELECT DISTINCT tree_id, tip FROM below) a ON i.tree_id = a.tree_id LEFT JOIN (SELECT DISTINCT tree_id, node_id, tip FROM below) b "
    "ON b.tree_id = i.tree_id AND b.node_id = i.node_id AND b.tip = a.tip WHERE i.has = 1 AND b.tip IS NULL GROUP BY i.tree_id, i.node_id), splits AS (SELECT DISTINCT tree_id, split, size FROM (SELECT tree_id, split, size FROM one_side UNION ALL SELECT tree_id, split, size FROM other_side))"
)
register("rescaled_tree", lambda s, d: trees.rescale(_a(s, d)).select("node_id", "parent_id", "branch_length"), "SELECT node_id, parent_id, branch_length * 100 AS branch_length FROM tree_a", "tree_a", "branch_length")
register("node_depths", lambda s, d: trees.root_distances(_a(s, d)).select("node_id", "depth"), f"{_DEPTH} SELECT node_id, depth FROM down", "tree_a", "depth")
register("tree_depth", lambda s, d: trees.max_depth(_a(s, d)), f"{_DEPTH} SELECT 'A' AS tree_id, max(depth) AS max_depth FROM down", "tree_a", "max_depth")
register(
    "chronogram_axis", lambda s, d: trees.axis_breaks(trees.max_depth(_a(s, d)), 0.5),
    f"{_DEPTH}, m AS (SELECT max(depth) AS md FROM down) SELECT 'A' AS tree_id, k * 0.5::DOUBLE AS age, md - k * 0.5 AS x FROM m, (SELECT unnest(range(0, 1000)) AS k) r WHERE k <= floor(md / 0.5)", "tree_a", "age x",
)
register(
    "collapsed_tree", lambda s, d: trees.collapse(_a(s, d)).select("node_id", "parent_id", "branch_length"),
    """WITH RECURSIVE marked AS (SELECT node_id, parent_id, is_tip, CASE WHEN NOT is_tip AND parent_id IS NOT NULL AND support < 0.70 THEN 0.0::DOUBLE ELSE branch_length END AS branch_length FROM tree_a),
    flag AS (SELECT *, NOT is_tip AND parent_id IS NOT NULL AND branch_length < 1e-10 AS gone FROM marked),
    climb AS (SELECT node_id, parent_id AS up FROM flag WHERE NOT gone UNION ALL SELECT c.node_id, f.parent_id FROM climb c JOIN flag f ON c.up = f.node_id WHERE f.gone)
    SELECT f.node_id, c.up AS parent_id, f.branch_length FROM flag f JOIN climb c ON f.node_id = c.node_id LEFT JOIN flag u ON c.up = u.node_id WHERE NOT f.gone AND NOT coalesce(u.gone, false)""", "tree_a", "branch_length",
)
register(
    "support_classes", lambda s, d: _a(s, d).where("NOT is_tip").select("node_id", F.format_string("%.3f", "support").alias("support_label"), names.support_class("support").alias("support_class")),
    "SELECT node_id, printf('%.3f', support) AS support_label, CASE WHEN support >= 0.90 THEN '>= 90' WHEN support >= 0.70 THEN '70-89' ELSE '< 70' END AS support_class FROM tree_a WHERE NOT is_tip", "tree_a",
)
register("tree_splits", lambda s, d: trees.splits(canonical(s, d, "trees")), f"{_SPLIT.format('trees')} SELECT * FROM splits", "trees")


def _groups(s, d):
    t = canonical(s, d, "taxonomy")
    return t.select(F.col("clade").alias("grp"), F.col("taxon").alias("tip")).union(t.select("family", "taxon"))


_GROUP = (
    _BELOW.format("tree_a") + ", grps AS (SELECT clade AS grp, taxon AS tip FROM taxonomy UNION SELECT family, taxon FROM taxonomy), sizes AS (SELECT node_id, count(*) AS n FROM below GROUP BY node_id), lev AS (SELECT node_id, max(steps) AS l FROM up GROUP BY node_id), "
    "want AS (SELECT g.grp, count(DISTINCT g.tip) AS n_tips FROM grps g WHERE g.tip IN (SELECT label FROM tree_a WHERE is_tip) GROUP BY g.grp HAVING count(DISTINCT g.tip) >= 2), "
    "held AS (SELECT g.grp, b.node_id, count(*) AS k FROM below b JOIN grps g ON b.tip = g.tip GROUP BY g.grp, b.node_id), "
    "mrcas AS (SELECT grp, n_tips, node_id AS mrca, n AS n_below, n = n_tips AS monophyletic FROM (SELECT h.grp, w.n_tips, h.node_id, s.n, row_number() OVER (PARTITION BY h.grp ORDER BY s.n, -l.l, h.node_id) AS r FROM held h JOIN want w ON h.grp = w.grp AND h.k = w.n_tips "
    "JOIN sizes s ON h.node_id = s.node_id JOIN lev l ON h.node_id = l.node_id) WHERE r = 1)"
)
register("group_nodes", lambda s, d: trees.group_nodes(_a(s, d), _groups(s, d)).drop("tree_id"), f"{_GROUP} SELECT * FROM mrcas", "tree_a taxonomy")


def _tips(s, d):
    t = canonical(s, d, "taxonomy").select("taxon", F.col("clade").alias("level_1"), F.col("subfamily").alias("level_2"), F.col("family").alias("level_3"), F.col("clade").alias("level_4"), "ord")
    return trees.annotate_tips(_a(s, d), t, names.standardize_taxon("taxon"))


register("tip_annotation", lambda s, d: _tips(s, d).drop("ord"), "SELECT taxon AS label, taxon, clade AS level_1, subfamily AS level_2, family AS level_3, clade AS level_4 FROM taxonomy", "taxonomy")
_LEVELS = {1: "clade", 2: "subfamily", 3: "family", 4: "clade"}
_REGISTRY = (
    _BELOW.format("tree_a") + ", sizes AS (SELECT node_id, count(*) AS n FROM below GROUP BY node_id), lev AS (SELECT node_id, max(steps) AS l FROM up GROUP BY node_id), grps AS (" + " UNION ALL ".join(f"SELECT {k} AS lv, {c} AS grp, taxon AS tip FROM taxonomy" for k, c in _LEVELS.items()) + "), "
    "want AS (SELECT lv, grp, count(DISTINCT tip) AS n_tips FROM grps GROUP BY lv, grp HAVING count(DISTINCT tip) >= 2), held AS (SELECT g.lv, g.grp, b.node_id, count(*) AS k FROM below b JOIN grps g ON b.tip = g.tip GROUP BY g.lv, g.grp, b.node_id), "
    "mrcas AS (SELECT lv, grp, n_tips, node_id AS mrca, n AS n_below, n = n_tips AS monophyletic FROM (SELECT h.lv, h.grp, w.n_tips, h.node_id, s.n, row_number() OVER (PARTITION BY h.lv, h.grp ORDER BY s.n, -l.l, h.node_id) AS r FROM held h JOIN want w ON h.lv = w.lv AND h.grp = w.grp AND h.k = w.n_tips "
    "JOIN sizes s ON h.node_id = s.node_id JOIN lev l ON h.node_id = l.node_id) WHERE r = 1), reg AS (SELECT grp, n_tips, mrca, n_below, monophyletic, CASE WHEN monophyletic THEN CASE WHEN lv < 4 THEN 'level_' || lv WHEN grp IN ('NATION1', 'NATION2') THEN 'level_4_main' WHEN n_tips >= 10 THEN 'level_4_supp' END "
    "WHEN lv > 1 THEN 'failed_' || lv END AS layer FROM mrcas)"
)
LAYERS = ["level_1", "level_2", "level_3", "level_4_main", "level_4_supp"]


def _registry(s, d):
    return trees.annotation_registry(_a(s, d), _tips(s, d), ["NATION1", "NATION2"])


register("annotation_registry", lambda s, d: _registry(s, d).drop("tree_id"), f"{_REGISTRY} SELECT * FROM reg WHERE layer IS NOT NULL", "tree_a taxonomy")
register(
    "augmented_nodes", lambda s, d: trees.augment_nodes(_a(s, d), _registry(s, d), LAYERS).select("node_id", *LAYERS),
    f"{_REGISTRY} SELECT t.node_id, " + ", ".join(f"string_agg(DISTINCT r.grp, ' | ' ORDER BY r.grp) FILTER (WHERE r.layer = '{x}') AS {x}" for x in LAYERS) + " FROM tree_a t LEFT JOIN reg r ON t.node_id = r.mrca GROUP BY t.node_id", "tree_a taxonomy",
)


def _analyses(s, d):
    return taxa.analysis_tips(canonical(s, d, "tip"), TREES, ["A", "B"])


def _pairs(s, d, dpi=False):
    return trees.pairwise_distances(canonical(s, d, "trees"), _analyses(s, d), _order(s), dpi)


# A split is told apart by the number and the sum of hashes of the tips on the side without the first one.
_SHARED = "(SELECT {0} AS v FROM tip GROUP BY v HAVING count(DISTINCT tree) = 3)"
_SETS = f"""sets AS (SELECT 'A1' AS aid, tree, taxon AS label, taxon AS name FROM tip WHERE taxon IN {_SHARED.format('taxon')}
    UNION ALL SELECT 'A2', tree, taxon, taxon FROM tip WHERE tree IN ('A', 'B') AND taxon IN (SELECT taxon FROM tip WHERE tree IN ('A', 'B') GROUP BY taxon HAVING count(DISTINCT tree) = 2)
    UNION ALL SELECT 'A3', tree, taxon, taxon FROM tip WHERE split_part(taxon, '_', 1) IN {_SHARED.format("split_part(taxon, '_', 1)")}
    UNION ALL SELECT 'A4', tree, min(taxon), split_part(taxon, '_', 1) FROM tip WHERE split_part(taxon, '_', 1) IN {_SHARED.format("split_part(taxon, '_', 1)")} GROUP BY tree, split_part(taxon, '_', 1))"""
_PAIRS = (
    _SETS + ", every AS (SELECT x.aid, x.tree AS t1, y.tree AS t2 FROM (SELECT DISTINCT aid, tree FROM sets) x JOIN (SELECT DISTINCT aid, tree FROM sets) y ON x.aid = y.aid AND x.tree > y.tree), "
    "both_have AS (SELECT DISTINCT a.aid, a.tree AS t1, b.tree AS t2, a.name FROM sets a JOIN sets b ON a.aid = b.aid AND a.tree > b.tree AND a.name = b.name), "
    "common AS (SELECT aid, t1, t2, count(*) AS n, min(name) AS first_name, sum(md5_number_lower(name)::HUGEINT) AS h FROM both_have GROUP BY aid, t1, t2)"
)
_RF = (
    _BELOW.format("trees") + f", {_PAIRS}, sized AS (SELECT c.aid, c.t1, c.t2, s.tree, b.node_id, any_value(c.n) AS n, any_value(c.h) AS h, count(*) AS k, max(CASE WHEN p.name = c.first_name THEN 1 ELSE 0 END) AS has, sum(md5_number_lower(p.name)::HUGEINT) AS hk "
    "FROM both_have p JOIN common c ON p.aid = c.aid AND p.t1 = c.t1 AND p.t2 = c.t2 JOIN sets s ON s.aid = p.aid AND s.name = p.name AND s.tree IN (p.t1, p.t2) JOIN below b ON b.tree_id = s.tree AND b.tip = s.label GROUP BY c.aid, c.t1, c.t2, s.tree, b.node_id), "
    "sides AS (SELECT DISTINCT aid, t1, t2, tree, CASE WHEN has = 1 THEN n - k ELSE k END AS size, CASE WHEN has = 1 THEN h - hk ELSE hk END AS sig FROM sized WHERE k >= 2 AND k <= n - 2), "
    "per AS (SELECT aid, t1, t2, count(*) AS total FROM sides GROUP BY aid, t1, t2), twice AS (SELECT aid, t1, t2, count(*) AS k FROM (SELECT aid, t1, t2, size, sig FROM sides GROUP BY ALL HAVING count(*) = 2) GROUP BY aid, t1, t2)"
)
register(
    "pairwise_rf", lambda s, d: _pairs(s, d).select("analysis_id", "tree_1", "tree_2", "n_common_tips", F.col("rf").alias("distance")),
    f"""{_RF} SELECT e.aid AS analysis_id, e.t1 AS tree_1, e.t2 AS tree_2, coalesce(c.n, 0) AS n_common_tips, CASE WHEN coalesce(c.n, 0) < 3 THEN NULL WHEN coalesce(p.total, 0) = 0 THEN 0.0::DOUBLE ELSE (p.total - 2 * coalesce(w.k, 0)) / p.total::DOUBLE END AS distance
    FROM every e LEFT JOIN common c ON e.aid = c.aid AND e.t1 = c.t1 AND e.t2 = c.t2 LEFT JOIN per p ON e.aid = p.aid AND e.t1 = p.t1 AND e.t2 = p.t2 LEFT JOIN twice w ON e.aid = w.aid AND e.t1 = w.t1 AND e.t2 = w.t2""", "trees tip", "distance",
)
register(
    "common_tip_counts", lambda s, d: trees.common_tip_counts(_analyses(s, d), _order(s)),
    f"WITH {_PAIRS} SELECT e.aid AS analysis_id, e.t1 AS tree_1, e.t2 AS tree_2, coalesce(c.n, 0) AS n_common_tips FROM every e LEFT JOIN common c ON e.aid = c.aid AND e.t1 = c.t1 AND e.t2 = c.t2", "tip",
)
register("pairwise_dpi", lambda s, d: _pairs(s, d, True).select("analysis_id", "tree_1", "tree_2", "n_common_tips", F.col("dpi").alias("distance")))


def _space(s, d):
    distances, out = trees.cut(_pairs(s, d)), None
    for name in taxa.ANALYSES:
        rows = trees.tree_space(distances.where(F.col("analysis_id") == name).withColumnRenamed("rf", "distance")).select(F.lit(name).alias("analysis_id"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


register("tree_space_mds", _space)
register(
    "support_fbp", lambda s, d: trees.support_fbp(_a(s, d), canonical(s, d, "replicate")),
    f"{_SPLIT.format('all_trees')} SELECT r.split, r.size, count(b.split) / 5::DOUBLE AS support FROM splits r LEFT JOIN (SELECT DISTINCT tree_id, split FROM splits WHERE tree_id <> 'A') b ON r.split = b.split WHERE r.tree_id = 'A' GROUP BY r.split, r.size".replace(
        "WITH RECURSIVE up", "WITH RECURSIVE all_trees AS (SELECT * FROM tree_a UNION ALL SELECT * FROM replicate), up"
    ), "tree_a replicate", "support",
)
# Transfer distance of splits as tip sets: tips on one side only, on either orientation.
register(
    "support_tbe", lambda s, d: trees.support_tbe(_a(s, d), canonical(s, d, "replicate")),
    f"""{_SPLIT.format('all_trees')}, n AS (SELECT count(*) AS n FROM tree_a WHERE is_tip), cells AS (SELECT tree_id, split, size, unnest(string_split(split, ',')) AS tip FROM splits),
    both_in AS (SELECT r.split, b.tree_id, b.split AS other, count(*) AS k FROM cells r JOIN cells b ON r.tip = b.tip AND r.tree_id = 'A' AND b.tree_id <> 'A' GROUP BY r.split, b.tree_id, b.split),
    apart AS (SELECT r.split, r.size, o.tree_id, r.size + o.size - 2 * coalesce(k.k, 0) AS d FROM (SELECT * FROM splits WHERE tree_id = 'A') r CROSS JOIN (SELECT * FROM splits WHERE tree_id <> 'A') o LEFT JOIN both_in k ON k.split = r.split AND k.tree_id = o.tree_id AND k.other = o.split),
    least AS (SELECT split, size, tree_id, least(min(least(d, n - d)), least(any_value(size), any_value(n) - any_value(size)) - 1) AS d, least(any_value(size), any_value(n) - any_value(size)) AS p FROM apart, n GROUP BY split, size, tree_id)
    SELECT split, size, avg(1 - d / (p - 1)::DOUBLE) AS support FROM least GROUP BY split, size""".replace("WITH RECURSIVE up", "WITH RECURSIVE all_trees AS (SELECT * FROM tree_a UNION ALL SELECT * FROM replicate), up"), "tree_a replicate", "support",
)
def _clade_ages(s, d):
    # Mean ages are sums of few decimals over sixteen trees, which may lie just between two numbers of nine places.
    return clades.clade_age_intervals(_a(s, d), canonical(s, d, "dated")).withColumns({c: F.round(c, 6) for c in ("mean_age", "hpd_low", "hpd_high")})


# A clade is its sorted tips, by recursive closure over all trees; an age is how far the farthest tip is below.
register(
    "clade_age_intervals", _clade_ages,
    """WITH RECURSIVE both_kinds AS (SELECT * FROM tree_a UNION ALL SELECT * FROM dated),
    up AS (SELECT tree_id, node_id, node_id AS anc, parent_id AS nxt FROM both_kinds UNION ALL SELECT u.tree_id, u.node_id, t.node_id, t.parent_id FROM up u JOIN both_kinds t ON u.tree_id = t.tree_id AND u.nxt = t.node_id),
    far AS (SELECT u.tree_id, u.node_id, sum(CASE WHEN t.parent_id IS NULL THEN 0 ELSE t.branch_length END) AS depth FROM up u JOIN both_kinds t ON u.tree_id = t.tree_id AND u.anc = t.node_id GROUP BY u.tree_id, u.node_id),
    deepest AS (SELECT f.tree_id, max(f.depth) AS far FROM far f JOIN both_kinds t ON f.tree_id = t.tree_id AND f.node_id = t.node_id WHERE t.is_tip GROUP BY f.tree_id),
    sets AS (SELECT u.tree_id, u.anc AS node_id, md5(string_agg(t.label, ',' ORDER BY t.label)) AS tips, count(*) AS n_tips FROM up u JOIN both_kinds t ON u.tree_id = t.tree_id AND u.node_id = t.node_id WHERE t.is_tip GROUP BY u.tree_id, u.anc HAVING count(*) >= 2),
    ages AS (SELECT a.node_id AS node, a.n_tips, s.tree_id AS rep, min(d.far - f.depth) AS age FROM sets a JOIN sets s ON s.tips = a.tips AND s.tree_id <> 'A' JOIN far f ON f.tree_id = s.tree_id AND f.node_id = s.node_id JOIN deepest d ON d.tree_id = s.tree_id WHERE a.tree_id = 'A' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY age, rep) AS r, count(*) OVER (PARTITION BY node) AS n FROM ages),
    spans AS (SELECT a.node, a.age AS low, b.age AS high, row_number() OVER (PARTITION BY a.node ORDER BY round(b.age - a.age, 9), a.age) AS best FROM ranked a JOIN ranked b ON a.node = b.node AND b.r = a.r + CAST(ceil(0.95 * a.n) AS INT) - 1)
    SELECT s.node_id AS node, s.n_tips, count(g.rep) AS n_replicates, count(g.rep) / 20::DOUBLE AS support, round(avg(g.age), 6) AS mean_age, round(any_value(w.low), 6) AS hpd_low, round(any_value(w.high), 6) AS hpd_high
    FROM sets s LEFT JOIN ages g ON g.node = s.node_id LEFT JOIN spans w ON w.node = s.node_id AND w.best = 1 WHERE s.tree_id = 'A' GROUP BY s.node_id, s.n_tips""", "tree_a dated", "support mean_age hpd_low hpd_high",
)


def _tree_set(name):
    def run(s, d):
        nodes = canonical(s, d, name)
        return treesets.tree_set_rf(nodes, nodes.where("parent_id IS NULL").selectExpr("tree_id", "CAST(tree_id AS INT) AS ord"))

    return run


# A split is its smaller side's (or smaller sum's) number and sum of hashes of tips.
register(
    "tree_set_rf", _tree_set("tree_set"),
    """WITH RECURSIVE up AS (SELECT tree_id, node_id AS anc, parent_id AS nxt, label FROM tree_set WHERE is_tip UNION ALL SELECT u.tree_id, t.node_id, t.parent_id, u.label FROM up u JOIN tree_set t ON u.tree_id = t.tree_id AND u.nxt = t.node_id),
    sized AS (SELECT tree_id, anc, count(*) AS k, sum(md5_number_lower(label)::HUGEINT) AS h FROM up GROUP BY tree_id, anc), whole AS (SELECT tree_id, max(k) AS n, arg_max(h, k) AS t FROM sized GROUP BY tree_id),
    splits AS (SELECT DISTINCT s.tree_id, least(k, n - k) AS k, CASE WHEN 2 * k < n OR (2 * k = n AND h < t - h) THEN h ELSE t - h END AS h FROM sized s JOIN whole w ON s.tree_id = w.tree_id WHERE k >= 2 AND k <= n - 2),
    per AS (SELECT w.tree_id, w.n, count(s.k) AS m FROM whole w LEFT JOIN splits s ON s.tree_id = w.tree_id GROUP BY w.tree_id, w.n),
    twice AS (SELECT a.tree_id AS x, b.tree_id AS y, count(*) AS c FROM splits a JOIN splits b ON a.k = b.k AND a.h = b.h AND a.tree_id::INT > b.tree_id::INT GROUP BY a.tree_id, b.tree_id)
    SELECT a.tree_id AS tree_1, b.tree_id AS tree_2, a.n AS n_common_tips, CASE WHEN a.n < 3 THEN NULL WHEN a.m + b.m = 0 THEN 0 ELSE (a.m + b.m - 2 * coalesce(c, 0)) / (a.m + b.m)::DOUBLE END AS rf
    FROM per a JOIN per b ON a.tree_id::INT > b.tree_id::INT LEFT JOIN twice t ON t.x = a.tree_id AND t.y = b.tree_id""", "tree_set", "rf",
)
register(
    "ragged_tree_set_rf", _tree_set("ragged_tree_set"),
    """WITH RECURSIVE up AS (SELECT tree_id, node_id AS anc, parent_id AS nxt, label FROM ragged_tree_set WHERE is_tip UNION ALL SELECT u.tree_id, t.node_id, t.parent_id, u.label FROM up u JOIN ragged_tree_set t ON u.tree_id = t.tree_id AND u.nxt = t.node_id),
    tips AS (SELECT tree_id, label FROM ragged_tree_set WHERE is_tip), every AS (SELECT a.tree_id AS x, b.tree_id AS y FROM (SELECT DISTINCT tree_id FROM ragged_tree_set) a JOIN (SELECT DISTINCT tree_id FROM ragged_tree_set) b ON a.tree_id::INT > b.tree_id::INT),
    both_have AS (SELECT a.tree_id AS x, b.tree_id AS y, a.label FROM tips a JOIN tips b ON a.label = b.label AND a.tree_id::INT > b.tree_id::INT),
    common AS (SELECT x, y, count(*) AS n, sum(md5_number_lower(label)::HUGEINT) AS t FROM both_have GROUP BY x, y),
    sized AS (SELECT p.x, p.y, u.tree_id, u.anc, count(*) AS k, sum(md5_number_lower(p.label)::HUGEINT) AS h FROM both_have p JOIN up u ON u.label = p.label AND u.tree_id IN (p.x, p.y) GROUP BY p.x, p.y, u.tree_id, u.anc),
    splits AS (SELECT DISTINCT s.x, s.y, s.tree_id, least(k, n - k) AS k, CASE WHEN 2 * k < n OR (2 * k = n AND h < t - h) THEN h ELSE t - h END AS h FROM sized s JOIN common c ON s.x = c.x AND s.y = c.y WHERE k >= 2 AND k <= n - 2),
    per AS (SELECT x, y, count(*) AS m FROM splits GROUP BY x, y), twice AS (SELECT x, y, count(*) AS c FROM (SELECT x, y, k, h FROM splits GROUP BY x, y, k, h HAVING count(*) = 2) GROUP BY x, y)
    SELECT e.x AS tree_1, e.y AS tree_2, coalesce(c.n, 0) AS n_common_tips, CASE WHEN coalesce(c.n, 0) < 3 THEN NULL WHEN coalesce(p.m, 0) = 0 THEN 0 ELSE (p.m - 2 * coalesce(w.c, 0)) / p.m::DOUBLE END AS rf
    FROM every e LEFT JOIN common c ON e.x = c.x AND e.y = c.y LEFT JOIN per p ON e.x = p.x AND e.y = p.y LEFT JOIN twice w ON e.x = w.x AND e.y = w.y""", "ragged_tree_set", "rf",
)
register("bootstopping", lambda s, d: treesets.bootstopping(canonical(s, d, "tree_set")))
register("bootstrap_convergence", lambda s, d: trees.convergence(canonical(s, d, "replicate")))


def _rerooted(s, d):
    clade = canonical(s, d, "taxonomy").where("clade = 'NATION3'").select("taxon")
    return trees.reroot(_a(s, d), clade).select("tree_id", "node_id", "parent_id", "branch_length", "note")


# The outgroup is one clade: the edge above it gets the root, and the line from there to the old root turns round.
register(
    "rerooted_tree", _rerooted,
    """WITH RECURSIVE up AS (SELECT node_id, node_id AS anc, parent_id AS nxt, 0 AS steps FROM tree_a UNION ALL SELECT u.node_id, t.node_id, t.parent_id, u.steps + 1 FROM up u JOIN tree_a t ON u.nxt = t.node_id),
    outg AS (SELECT node_id FROM tree_a WHERE is_tip AND label IN (SELECT taxon FROM taxonomy WHERE clade = 'NATION3')),
    top AS (SELECT anc AS node_id FROM up WHERE node_id IN (SELECT node_id FROM outg) GROUP BY anc HAVING count(*) = (SELECT count(*) FROM outg) ORDER BY min(steps) LIMIT 1),
    line AS (SELECT u.anc AS node_id, u.steps FROM up u WHERE u.node_id = (SELECT node_id FROM top) AND u.steps > 0),
    fresh AS (SELECT max(node_id) + 1 AS node_id FROM tree_a), half AS (SELECT branch_length / 2 AS w FROM tree_a WHERE node_id = (SELECT node_id FROM top)),
    turned AS (SELECT a.node_id, b.node_id AS parent_id, t.branch_length FROM line a JOIN line b ON b.steps = a.steps - 1 JOIN tree_a t ON t.node_id = b.node_id)
    SELECT 'A' AS tree_id, t.node_id, CASE WHEN t.node_id = (SELECT node_id FROM top) OR l.steps = 1 THEN (SELECT node_id FROM fresh) WHEN l.steps > 1 THEN u.parent_id ELSE t.parent_id END AS parent_id,
    CASE WHEN t.node_id = (SELECT node_id FROM top) OR l.steps = 1 THEN (SELECT w FROM half) WHEN l.steps > 1 THEN u.branch_length ELSE t.branch_length END AS branch_length, 'rooted' AS note
    FROM tree_a t LEFT JOIN line l ON t.node_id = l.node_id LEFT JOIN turned u ON t.node_id = u.node_id UNION ALL SELECT 'A', node_id, NULL, NULL, 'rooted' FROM fresh""", "tree_a taxonomy", "branch_length",
)
register(
    "pruned_tree", lambda s, d: trees.prune(_a(s, d), canonical(s, d, "listed").select(F.col("taxon").alias("tip"))).select("node_id", "parent_id", "branch_length"),
    """WITH RECURSIVE up AS (SELECT node_id, node_id AS anc, parent_id AS nxt, 0 AS steps, 0.0::DOUBLE AS far, branch_length AS own FROM tree_a UNION ALL SELECT u.node_id, t.node_id, t.parent_id, u.steps + 1, u.far + u.own, t.branch_length FROM up u JOIN tree_a t ON u.nxt = t.node_id),
    held AS (SELECT node_id FROM tree_a WHERE is_tip AND label IN (SELECT taxon FROM listed)), alive AS (SELECT DISTINCT anc AS node_id FROM up WHERE node_id IN (SELECT node_id FROM held)),
    stays AS (SELECT node_id FROM held UNION SELECT parent_id FROM tree_a WHERE node_id IN (SELECT node_id FROM alive) AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) >= 2),
    above AS (SELECT node_id, arg_min(anc, steps) AS parent_id, min(steps) AS steps, arg_min(far, steps) AS far FROM up WHERE steps > 0 AND anc IN (SELECT node_id FROM stays) GROUP BY node_id)
    SELECT s.node_id, a.parent_id, a.far AS branch_length FROM stays s LEFT JOIN above a ON s.node_id = a.node_id""", "tree_a listed", "branch_length",
)
register(
    "pruned_tips", lambda s, d: trees.prune(_a(s, d), canonical(s, d, "listed").select(F.col("taxon").alias("tip"))).where("is_tip").select("node_id", "label"),
    "SELECT node_id, label FROM tree_a WHERE label IN (SELECT taxon FROM listed)", "tree_a listed",
)


def _genus_trees(s, d):
    sets = _analyses(s, d).where("analysis_id = 'A4'").select(F.col("tree").alias("tree_id"), "label", "taxon")
    return trees.rename_tips(canonical(s, d, "trees"), sets).where("is_tip").select("tree_id", "node_id", "label")


register(
    "genus_tree_tips", _genus_trees,
    f"WITH {_SETS} SELECT s.tree AS tree_id, t.node_id, s.name AS label FROM sets s JOIN trees t ON t.tree_id = s.tree AND t.label = s.label WHERE s.aid = 'A4'", "trees tip",
)
register(
    "comparison_summary", lambda s, d: _analyses(s, d).groupBy("analysis_id", "tree").agg(F.countDistinct("taxon").alias("n_tips_retained"), F.countDistinct(names.genus_of("taxon")).alias("n_genera_retained")),
    f"WITH {_SETS} SELECT aid AS analysis_id, tree, count(DISTINCT name) AS n_tips_retained, count(DISTINCT split_part(name, '_', 1)) AS n_genera_retained FROM sets GROUP BY aid, tree", "tip",
)
register(
    "tip_set_differences", lambda s, d: taxa.set_differences(canonical(s, d, "listed"), canonical(s, d, "constraint")),
    'SELECT DISTINCT \'left\' AS side, taxon FROM listed WHERE taxon NOT IN (SELECT taxon FROM "constraint") UNION ALL SELECT DISTINCT \'right\', taxon FROM "constraint" WHERE taxon NOT IN (SELECT taxon FROM listed)', "listed constraint",
)

register(
    "node_positions", lambda s, d: trees.node_positions(_a(s, d)).where("node_id >= 1000").select("node_id", "x", "y"),
    f"{_DEPTH} SELECT t.node_id, d.depth AS x, CAST(row_number() OVER (ORDER BY p.parent_id, t.parent_id, t.node_id) AS DOUBLE) AS y FROM tree_a t JOIN tree_a p ON t.parent_id = p.node_id JOIN down d ON t.node_id = d.node_id WHERE t.is_tip", "tree_a", "x y",
)
register("clade_labels", lambda s, d: trees.clade_labels(_a(s, d), _registry(s, d), LAYERS).select("layer", "node_id", "label", "n_tips"), f"{_REGISTRY} SELECT layer, mrca AS node_id, min(grp) AS label, arg_min(n_tips, grp) AS n_tips FROM reg WHERE layer IN ({', '.join(repr(x) for x in LAYERS)}) GROUP BY layer, mrca", "tree_a taxonomy")

# Tip sets

_CHECKED = "checked AS (SELECT tree, taxon FROM tip WHERE taxon IN (SELECT taxon FROM listed))"
_FINAL = f"{_CHECKED}, final AS (SELECT tree, taxon FROM checked WHERE taxon IN (SELECT taxon FROM \"constraint\"))"
_G = "split_part(taxon, '_', 1)"


def _tip(s, d):
    return canonical(s, d, "tip")


def _checked(s, d):
    return taxa.only_listed(_tip(s, d), canonical(s, d, "listed"))


def _final(s, d):
    return taxa.only_listed(_checked(s, d), canonical(s, d, "constraint"))


def _count(source, suffix):
    return f"(SELECT tree, count(DISTINCT taxon) AS s_{suffix}, count(DISTINCT {_G}) AS g_{suffix} FROM {source} GROUP BY tree) {suffix}"


register(
    "checklist_pruning", lambda s, d: taxa.pruning_summary(_tip(s, d), _checked(s, d)),
    f"WITH {_CHECKED} SELECT b.tree, s_b AS species_before, coalesce(s_a, 0) AS species_after, g_b AS genera_before, coalesce(g_a, 0) AS genera_after, s_b - coalesce(s_a, 0) AS species_removed, g_b - coalesce(g_a, 0) AS genera_removed FROM {_count('tip', 'b')} LEFT JOIN {_count('checked', 'a')} ON a.tree = b.tree", "tip listed",
)
register(
    "phylogeny_summary", lambda s, d: taxa.summary(_tip(s, d), _checked(s, d), _final(s, d)),
    f"""WITH {_FINAL} SELECT i.tree, s_i AS species_initial, g_i AS genera_initial, coalesce(s_c, 0) AS species_after_checklist, coalesce(g_c, 0) AS genera_after_checklist, coalesce(s_f, 0) AS species_final, coalesce(g_f, 0) AS genera_final,
    round(100::DOUBLE * coalesce(s_f, 0) / s_i, 2) AS species_retained_pct, round(100::DOUBLE * coalesce(g_f, 0) / g_i, 2) AS genera_retained_pct FROM {_count('tip', 'i')} LEFT JOIN {_count('checked', 'c')} ON c.tree = i.tree LEFT JOIN {_count('final', 'f')} ON f.tree = i.tree""", "tip listed constraint",
)
register(
    "taxon_counts_by_stage", lambda s, d: taxa.counts_by_stage([("initial", _tip(s, d)), ("after_checklist", _checked(s, d)), ("after_family_filter", _final(s, d))]),
    f"WITH {_FINAL} " + " UNION ALL ".join(f"SELECT tree, '{n}' AS stage, count(DISTINCT taxon) AS n_species, count(DISTINCT {_G}) AS n_genera FROM {t} GROUP BY tree" for n, t in (("initial", "tip"), ("after_checklist", "checked"), ("after_family_filter", "final"))), "tip listed constraint",
)
register("species_by_stage", lambda s, d: taxa.species_by_stage(_tip(s, d), "initial").union(taxa.species_by_stage(_final(s, d), "after_family_filter")), f"WITH {_FINAL} SELECT tree, 'initial' AS stage, taxon AS species FROM tip UNION ALL SELECT tree, 'after_family_filter', taxon FROM final", "tip listed constraint")
register("genera_by_stage", lambda s, d: taxa.genera_by_stage(_tip(s, d), "initial").union(taxa.genera_by_stage(_final(s, d), "after_family_filter")), f"WITH {_FINAL} SELECT DISTINCT tree, 'initial' AS stage, {_G} AS genus FROM tip UNION ALL SELECT DISTINCT tree, 'after_family_filter', {_G} FROM final", "tip listed constraint")
register("species_removed", lambda s, d: taxa.species_removed(_tip(s, d), _checked(s, d), "removed_by_checklist"), f"WITH {_CHECKED} SELECT tree, taxon AS species, 'removed_by_checklist' AS reason FROM tip WHERE (tree, taxon) NOT IN (SELECT (tree, taxon) FROM checked)", "tip listed")
register("genera_removed", lambda s, d: taxa.genera_removed(_tip(s, d), _checked(s, d), "removed_by_checklist"), f"WITH {_CHECKED} SELECT DISTINCT tree, {_G} AS genus, 'removed_by_checklist' AS reason FROM tip WHERE (tree, {_G}) NOT IN (SELECT (tree, {_G}) FROM checked)", "tip listed")
register("taxon_crosswalk", lambda s, d: taxa.crosswalk(_final(s, d)), f"WITH {_FINAL} SELECT tree, taxon, {_G} AS genus FROM final", "tip listed constraint")
register("missing_in_constraints", lambda s, d: taxa.missing(_checked(s, d), canonical(s, d, "constraint")), f'WITH {_CHECKED} SELECT tree, taxon AS species_not_in_constraints FROM checked WHERE taxon NOT IN (SELECT taxon FROM "constraint")', "tip listed constraint")
_ALL3 = "SELECT {0} AS v FROM tip GROUP BY v HAVING count(DISTINCT tree) = 3"
register("shared_species", lambda s, d: taxa.shared_species(_tip(s, d), 3), f"SELECT v AS species FROM ({_ALL3.format('taxon')})", "tip")
register("shared_genera", lambda s, d: taxa.shared_genera(_tip(s, d), 3), f"SELECT v AS genus FROM ({_ALL3.format(_G)})", "tip")
register(
    "genus_representatives", lambda s, d: taxa.genus_representatives(_tip(s, d), taxa.shared_genera(_tip(s, d), 3)),
    f"SELECT tree, {_G} AS genus, min(taxon) AS representative FROM tip WHERE {_G} IN ({_ALL3.format(_G)}) GROUP BY tree, genus", "tip",
)
register(
    "comparison_dataset", lambda s, d: taxa.comparison_sets(_tip(s, d), TREES, ["A", "B"]),
    f"""SELECT 'A1' AS analysis_id, tree, taxon FROM tip WHERE taxon IN ({_ALL3.format('taxon')}) UNION ALL SELECT 'A2', tree, taxon FROM tip WHERE tree IN ('A', 'B') AND taxon IN (SELECT taxon FROM tip WHERE tree IN ('A', 'B') GROUP BY taxon HAVING count(DISTINCT tree) = 2)
    UNION ALL SELECT 'A3', tree, taxon FROM tip WHERE {_G} IN ({_ALL3.format(_G)}) UNION ALL SELECT DISTINCT 'A4', tree, {_G} FROM tip WHERE {_G} IN ({_ALL3.format(_G)})""", "tip",
)


def _rooting(s, d):
    tips = _tip(s, d)
    out = tips.groupBy("tree").agg(F.count_if(names.genus_of("taxon") == "NATION3").alias("n_outgroup_tips"), F.countDistinct("taxon").alias("species"))
    return out.withColumn("rooting_notes", F.when(F.col("n_outgroup_tips") > 0, "Rooted with all available outgroup tips").otherwise("No outgroup tips"))


register(
    "rooting_summary", _rooting,
    f"SELECT tree, count(*) FILTER (WHERE {_G} = 'NATION3') AS n_outgroup_tips, count(DISTINCT taxon) AS species, CASE WHEN count(*) FILTER (WHERE {_G} = 'NATION3') > 0 THEN 'Rooted with all available outgroup tips' ELSE 'No outgroup tips' END AS rooting_notes FROM tip GROUP BY tree", "tip",
)
register("missing_taxa", lambda s, d: taxa.clade_audit(canonical(s, d, "listed"), canonical(s, d, "constraint"))[0], 'SELECT DISTINCT taxon FROM listed WHERE taxon NOT IN (SELECT taxon FROM "constraint")', "listed constraint")
register(
    "duplicate_clades", lambda s, d: taxa.clade_audit(canonical(s, d, "listed"), canonical(s, d, "constraint"))[1],
    "SELECT taxon, count(DISTINCT clade) AS n_clades, string_agg(DISTINCT clade, ';' ORDER BY clade) AS clades FROM \"constraint\" GROUP BY taxon HAVING count(DISTINCT clade) > 1", "constraint",
)
_CLADES = "FROM \"constraint\" WHERE taxon IN (SELECT taxon FROM listed) GROUP BY clade"
register("clade_sizes", lambda s, d: taxa.constraint_groups(canonical(s, d, "listed"), canonical(s, d, "constraint")).select("clade", "n_tips"), f"SELECT clade, count(DISTINCT taxon) AS n_tips {_CLADES}", "listed constraint")
register(
    "constraint_newick", lambda s, d: taxa.constraint_groups(canonical(s, d, "listed"), canonical(s, d, "constraint")).select("clade", "newick"),
    f"SELECT clade, CASE WHEN count(DISTINCT taxon) > 1 THEN '(' || string_agg(DISTINCT taxon, ',' ORDER BY taxon) || ')' ELSE min(taxon) END AS newick {_CLADES}", "listed constraint",
)
