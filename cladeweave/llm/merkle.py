"""A Merkle manifest of a table: a tree for each group of rows, a tree over the groups, proofs and their check.

A leaf is the digest of a row's fields; a node is the digest of up to ``ARITY`` consecutive nodes below it.
Levels are windows: partitioned by group and parent index, an ordered ``collect_list`` over the full frame
holds a parent's preimage and every child's siblings at once; the first row of each run is kept as the parent.
Proofs then come down from the root: a node's steps are its own siblings and its parent's steps, so what
siblings share is made once, and no row meets more than ``ARITY`` others.

Positions inside a group need no window over the group, which may hold a third of all rows: rows are range
partitioned by group and order, each partition numbers its own rows, and the sizes of the pieces before it
(one row for each partition and group) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.llm.shared import cut, fold_of, join_counted

ARITY = 16
STEPS = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value without ambiguity: ``-`` for null, else its length in UTF-8 bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts, one after another."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def number(rows: DataFrame, sort: list[str]) -> DataFrame:
    """``rows`` (with a non-null ``grp``) and ``idx``, their place in the group by ``sort`` (which begins with columns that order the groups), and ``n``, the group's size.

    Rows that are equal in all of ``sort`` are numbered in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, *sort, "tie").sortWithinPartitions(*sort, "tie").withColumn("at", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("piece", F.concat(F.shiftright("at", 33).cast("string"), F.lit("|"), "grp")))
    pieces = ranged.groupBy("piece", "grp").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("grp")
    before = own.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut(pieces.select("piece", "first", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(own).alias("n")))
    total = pieces.agg(F.sum("size")).first()[0] or 0
    placed = join_counted(ranged, pieces, "piece", "size", total)
    return placed.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Runs of each level, from the leaves up: ``grp, idx, n, run, digest``.

    ``leaves``: ``grp, idx, n, node``, where ``node`` is a struct that begins with ``digest``.  ``n`` counts the nodes
    of the group on the run's level, ``idx`` and ``digest`` are the parent's.  A group whose level has one
    node has no parent: a lone leaf stands as its own run, all others end with the level before.
    """
    out, nodes = [], leaves
    while True:
        frame = Window.partitionBy("grp", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = nodes.withColumn("up", F.expr(f"idx div {ARITY}")).withColumn("run", F.collect_list("node").over(frame)).where(F.col("idx") % ARITY == 0)
        preimage = F.array_join(F.transform("run", lambda x: x["digest"]), "")
        runs = cut(runs.select("grp", F.col("up").alias("idx"), "n", "run", F.when(F.col("n") > 1, digest(preimage)).otherwise(F.col("run")[0]["digest"]).alias("digest")))
        out.append(runs)
        nodes = runs.where(F.col("n") > ARITY).select("grp", "idx", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.struct("digest").alias("node"))
        if runs.where(F.col("n") > ARITY).isEmpty():
            return out


def tops(runs: list[DataFrame]) -> DataFrame:
    """``grp, level, digest``: the last node of each group and the level that it stands on (leaves are level 0)."""
    found = None
    for k, level in enumerate(runs):
        own = level.where(F.col("n") <= ARITY).select("grp", F.when(F.col("n") > 1, k + 1).otherwise(k).alias("level"), "digest")
        found = own if found is None else found.unionByName(own)
    return found


def descend(runs: list[DataFrame], starts: DataFrame) -> DataFrame:
    """All leaves with their steps to the root: ``grp, node, steps`` and the further columns of ``starts``.

    ``starts``: ``grp, level, steps`` and more, a row for each group: the steps from its last node up.  A step
    holds what stands left and right of the node in its run.
    """
    more = [c for c in starts.columns if c not in ("grp", "level", "steps")]

    def children(joined: DataFrame) -> DataFrame:
        each = joined.select("grp", "idx", "steps", *more, F.transform("run", lambda x: x["digest"]).alias("line"), F.posexplode("run").alias("pos", "node"))
        left, right = F.expr("slice(line, 1, pos)"), F.expr(f"slice(line, pos + 2, {ARITY})")
        step = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
        return each.select("grp", (F.col("idx") * ARITY + F.col("pos")).alias("idx"), "node", F.concat(step, "steps").alias("steps"), *more)

    reached = None
    for k in reversed(range(len(runs))):
        own = starts.where(F.col("level") == k + 1).select("grp", F.lit(0).cast("long").alias("idx"), "steps", *more)
        nodes = own if reached is None else reached.drop("node").unionByName(own)
        reached = children(runs[k].where("n > 1").join(nodes, ["grp", "idx"]))
    lone = runs[0].where("n = 1").join(starts.where("level = 0"), "grp").select("grp", "idx", F.col("run")[0].alias("node"), "steps", *more)
    return reached.unionByName(lone).drop("idx")


def manifest(rows: DataFrame) -> DataFrame:
    """``id, leaf, presented, steps, subroot, root`` of every row of ``rows(id, grp_value, leaf, presented)``.

    Rows of a group stand by id (null first), equal ids by leaf; groups stand by value (null first, bytewise).  ``presented``
    is the leaf that a checker is shown.  Equal rows are leaves of their own; an empty table gives no rows.
    """
    named = rows.withColumn("grp", field(F.col("grp_value")))
    placed = number(named, ["grp_value", "id", "leaf"])
    trees = levels(placed.select("grp", "idx", "n", F.struct(F.col("leaf").alias("digest"), "id", "presented").alias("node")))
    ends = tops(trees)
    values = cut(ends.join(rows.select("grp_value").distinct().withColumn("grp", field(F.col("grp_value"))), "grp"))
    above = number(values.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "grp_value", "digest", "level"), ["grp_value"])
    forest = levels(above.select("grp", "idx", "n", F.struct("digest", "own", "level").alias("node")))
    start = tops(forest).select("grp", "level", F.lit(None).cast(STEPS).alias("steps"), F.col("digest").alias("root")).withColumn("steps", F.expr(f"cast(array() as {STEPS})"))
    starts = cut(descend(forest, start).select(F.col("node.own").alias("grp"), F.col("node.level").alias("level"), "steps", F.col("node.digest").alias("subroot"), "root"))
    return descend(trees, starts).select("node.id", F.col("node.digest").alias("leaf"), "node.presented", "steps", "subroot", "root")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``steps`` lead to."""
    return F.aggregate(steps, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]).cast("binary"), 256))


def document_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document, by source.

    Where 5 divides the CRC-32 of the decimal id (a null id counts as an empty text, whose CRC-32 is 0), the
    presented row has its text lower-cased; its leaf is folded with the siblings of the stored table, and is
    ``verified`` only if it leads to the stored root.  Null, empty and long texts, repeated ids and rows, and
    further columns are all fine: only the five named fields count.
    """

    def row_digest(text: Column) -> Column:
        return digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))

    changed = (fold_of("doc_id") == 0) & F.col("text").isNotNull()
    leaf = row_digest(F.col("text"))
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp_value"), leaf.alias("leaf"), F.when(changed, row_digest(lower_ascii(F.col("text")))).alias("other"))
    leaves = cut(leaves.select("id", "grp_value", "leaf", F.coalesce("other", "leaf").alias("presented")))
    found = manifest(leaves)
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("presented"), F.col("steps")).alias("folded_root")
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
