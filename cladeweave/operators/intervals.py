"""Interval labels of rooted trees: entry and exit numbers, sizes, levels, tips below, and jump pointers.

A node's interval ``[enter, leave]`` holds the entry numbers of all nodes below it, so "is an ancestor of" is a
comparison and no closure of ancestors is kept (on a ladder that has as many rows as the square of its tips).
All of it comes from pointer doubling over the parents: round ``k`` knows each node's ancestor ``2**k`` steps above and
what the descendants less than ``2**k`` steps below add up to.  A round has a row for each node, and there are as many
rounds as the deepest level has binary digits, whatever the number of trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeweave.operators.lineage import cut

KEY = ["tree_id", "node_id"]


@dataclass(frozen=True)
class Labels:
    """``table`` has a row for each node; ``lifts[k]`` has ``tree_id, node_id, up`` of the nodes with an ancestor ``2**k`` steps above."""

    table: DataFrame
    lifts: list[DataFrame]


def climb(nodes: DataFrame, sums: dict[str, Column], marks: dict[str, Column] | None = None) -> Labels:
    """``tree_id, node_id, parent_id, level, depth`` and what nodes and all their descendants add up to.

    ``sums`` are added (numbers), ``marks`` are combined by exclusive or (numbers that stand for members of sets); both may
    be null for a node, and then count as zero.  ``depth`` is the sum of branch lengths from the root.
    """
    marks = marks or {}
    own = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in {**sums, **marks}.items()]
    inner = F.col("parent_id").isNotNull()
    length = F.when(inner, F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0))).otherwise(0.0)
    p = cut(nodes.select(*KEY, "parent_id", F.col("parent_id").alias("up"), F.when(inner, 1).otherwise(0).cast("long").alias("level"), length.alias("depth"), *own))
    lifts: list[DataFrame] = []
    while True:
        lift = p.where("up IS NOT NULL").select(*KEY, "up")
        if lift.isEmpty():
            return Labels(p.drop("up"), lifts)
        lifts.append(lift)
        above = p.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"), F.col("depth").alias("depth2"))
        given = [F.sum(n).alias(f"{n}_below") for n in sums] + [F.bit_xor(n).alias(f"{n}_below") for n in marks]
        below = p.where("up IS NOT NULL").groupBy("tree_id", F.col("up").alias("node_id")).agg(*(given or [F.lit(0)]))
        q = p.join(above, ["tree_id", "up"], "left")
        q = q.join(below, KEY, "left") if given else q
        more = [(F.col(n) + F.coalesce(F.col(f"{n}_below"), F.lit(0))).alias(n) for n in sums]
        more += [F.col(n).bitwiseXOR(F.coalesce(F.col(f"{n}_below"), F.lit(0))).alias(n) for n in marks]
        deeper = [(F.col(n) + F.coalesce(F.col(f"{n}2"), F.lit(0))).alias(n) for n in ("level", "depth")]
        p = cut(q.select(*KEY, "parent_id", F.col("up2").alias("up"), *deeper, *more))


def inner_nodes(nodes: DataFrame, held: dict[str, Column]) -> DataFrame:
    """``tree_id, node_id, parent_id, branch_length`` of the nodes that are no tips, and the aggregates ``held`` over the tips right below each.

    Tips are added up where they are read, so what climbs (``climb``) has a row for each inner node, however many
    tips hang on it.  Tips have no children; a node without tips of its own has nulls.
    """
    tip = F.coalesce("is_tip", F.lit(False))
    own = cut(nodes.where(tip).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(*(c.alias(n) for n, c in held.items())))
    return cut(nodes.where(~tip).select(*KEY, "parent_id", "branch_length").join(own, KEY, "left"))


def ancestor_pairs(inner: DataFrame) -> DataFrame:
    """``tree_id, node_id, above``: every inner node with itself and with each node above it, once each, by doubling."""
    pairs = inner.select(*KEY, F.col("node_id").alias("above"))
    for lift in climb(inner, {}).lifts:
        step = lift.select("tree_id", F.col("node_id").alias("above"), "up")
        pairs = cut(pairs.unionByName(pairs.join(step, ["tree_id", "above"]).select(*KEY, F.col("up").alias("above"))))
    return pairs


def running_totals(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over the rows of the same ``by`` that come before in ``order``.

    No group need fit a task: rows are range partitioned, each partition adds up its own pieces of groups, and the
    totals of a group's earlier pieces (one row for each piece) are added.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *by, *order).withColumn("piece", F.spark_partition_id()))
    keys = [*by, "piece"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(*keys).agg(F.sum(value).alias("total")).select(*keys, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    own = ranged.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(pieces, keys).select(*rows.columns, (F.col("inside") + F.col("before")).alias(name))


def interval_labels(nodes: DataFrame) -> Labels:
    """``tree_id, node_id, parent_id, level, depth, size, n_tips, enter, leave``: a walk from the root that takes children by id."""
    base = climb(nodes.withColumn("is_tip", F.coalesce("is_tip", F.lit(False))), {"size": F.lit(1), "n_tips": F.col("is_tip").cast("long")})
    children = base.table.where("parent_id IS NOT NULL").select(*KEY, "parent_id", "size")
    placed = running_totals(children, ["tree_id", "parent_id"], ["node_id"], "size", "before").select(*KEY, (F.col("before") + 1).alias("enter"))
    enter = cut(placed.unionByName(base.table.where("parent_id IS NULL").select(*KEY, F.lit(0).cast("long").alias("enter"))))
    for lift in base.lifts:
        above = enter.select("tree_id", F.col("node_id").alias("up"), F.col("enter").alias("more"))
        step = enter.join(lift, KEY, "left").join(above, ["tree_id", "up"], "left")
        enter = cut(step.select(*KEY, (F.col("enter") + F.coalesce("more", F.lit(0))).alias("enter")))
    table = cut(base.table.join(enter, KEY).withColumn("leave", F.col("enter") + F.col("size") - 1))
    return Labels(table, base.lifts)


def common_ancestors(labels: Labels, groups: DataFrame) -> DataFrame:
    """``groups`` (with ``tree_id``, ``node_id``: the member that is entered first, ``last``: the greatest entry number) and ``mrca``.

    From the first member the longest jumps are taken that do not yet reach an interval with the last one; one step further up is the ancestor.
    """
    ends = labels.table.select("tree_id", F.col("node_id").alias("at"), "leave", F.col("parent_id").alias("over"))
    names = groups.columns
    at = groups.withColumn("at", F.col("node_id"))
    for lift in reversed(labels.lifts):
        jump = lift.select("tree_id", F.col("node_id").alias("at"), "up").join(ends.select("tree_id", F.col("at").alias("up"), "leave"), ["tree_id", "up"])
        step = at.join(jump, ["tree_id", "at"], "left")
        at = cut(step.select(*names, F.when(F.col("leave") < F.col("last"), F.col("up")).otherwise(F.col("at")).alias("at")))
    found = at.join(ends, ["tree_id", "at"])
    return found.select(*names, F.when(F.col("leave") >= F.col("last"), F.col("at")).otherwise(F.col("over")).alias("mrca"))


def with_ancestors(labels: Labels, some: DataFrame) -> DataFrame:
    """``tree_id, node_id`` of the nodes ``some`` and of all nodes above them, each once."""

    def spread(reached: DataFrame, lift: DataFrame) -> DataFrame:
        return cut(reached.unionByName(reached.join(lift, KEY).select("tree_id", F.col("up").alias("node_id"))).distinct())

    return reduce(spread, labels.lifts, some.select(*KEY).distinct())


def nearest_kept(marked: DataFrame) -> DataFrame:
    """``tree_id, node_id, up`` of ``marked(tree_id, node_id, up, gone)``: the nearest ancestor that is not gone, by pointer doubling."""
    p = cut(marked.select(*KEY, "gone", "up"))
    while True:
        q = p.select("tree_id", F.col("node_id").alias("up"), F.col("gone").alias("gone2"), F.col("up").alias("up2"))
        step = p.join(q, ["tree_id", "up"], "left")
        if step.where("gone2").isEmpty():
            return p.select(*KEY, "up")
        p = cut(step.select(*KEY, "gone", F.when(F.col("gone2"), F.col("up2")).otherwise(F.col("up")).alias("up")))
