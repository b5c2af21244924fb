"""Subtree sums of a forest by parallel tree contraction: rake leaves, compress unary chains, expand again.

Every live node holds ``acc``, what is known of its own subtree, and ``up``, what lies between it and its live parent.
One round rakes all leaves into their parents and takes out an independent set of nodes with one child (a coin by
hash decides; the child may be neither a leaf nor taken out itself), whose child then hangs on the grandparent. A node
taken out remembers its child and the difference of both totals. The number of rounds is logarithmic in the number of
nodes, for bushy trees and for long chains alike. Joins are on unique node ids and the children of a node are
aggregated before the shuffle, so a node with very many children is no hot key.

Expansion: nodes taken out point to one that was taken out later or raked, so pointer jumping ends at raked
nodes, whose totals are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuslane.llm.shared import stored


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """``tree(id, parent, k, *values)`` with ``k`` the number of children; roots have a null parent.

    Returns ``id`` and each value summed over the node's subtree, itself included. ``id`` may be of any
    type that joins and has an order.
    """
    zero = F.lit(0).cast("long")
    live = tree.select("id", "parent", F.col("k").cast("long").alias("k"), _struct(values, lambda v: F.col(v).cast("long")).alias("acc"), _struct(values, lambda v: zero).alias("up"))
    raked, taken, number = [], [], 0
    while True:
        raked.append(live.where("k = 0").select("id", F.col("acc").alias("total")))
        seen = Observation()
        after = _round(live, values, number).observe(seen, F.count_if(~F.col("gone")).alias("live"), F.count_if("gone").alias("gone"))
        table = stored(after, f"round-{number}")
        if seen.get["gone"]:
            taken.append(table.where("gone").select("id", "child", F.col("diff")))
        number += 1
        if not seen.get["live"]:
            break
        live = table.where("NOT gone").select("id", "parent", "k", "acc", "up")
    known = _all(raked)
    if taken:
        jumps = _jumped(_all(taken), values)
        far = jumps.join(known.select(F.col("id").alias("child"), "total"), "child").select("id", _added(values, "total", "diff").alias("total"))
        known = known.unionByName(far)
    return known.select("id", *[F.col("total")[v].alias(v) for v in values])


def _struct(values: list[str], one) -> Column:
    return F.struct(*[one(v).alias(v) for v in values])


def _added(values: list[str], *columns: str) -> Column:
    return _struct(values, lambda v: sum((F.coalesce(F.col(c)[v], F.lit(0)) for c in columns[1:]), F.col(columns[0])[v]))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _coin(number: int, column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), F.col(column)), F.lit(2)) == 1


def _round(live: DataFrame, values: list[str], number: int) -> DataFrame:
    """Inner nodes after one round; ``gone`` marks those taken out, with ``child`` and ``diff``."""
    inner = F.col("k") > 0
    leaf_sum = _struct(values, lambda v: F.coalesce(F.sum(F.when(~inner, F.col("acc")[v] + F.col("up")[v])), F.lit(0)))
    below = live.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        leaf_sum.alias("leaves"), F.count_if(inner).alias("left"),
        # the one child, where there is one
        F.max(F.struct("id", "k", "up")).alias("one"),
    ).withColumnRenamed("parent", "id")
    met = live.where(inner).join(below, "id", "left")
    met = met.withColumn("child", F.col("one.id"))
    child_may_go = (F.col("one.k") == 1) & _coin(number, "child")
    gone = F.col("parent").isNotNull() & (F.col("k") == 1) & _coin(number, "id") & (F.col("one.k") > 0) & ~child_may_go
    met = met.withColumn("gone", gone).select(
        "id", "parent", F.col("left").alias("k"), _added(values, "acc", "leaves").alias("acc"), "up", "gone",
        F.when(gone, F.col("child")).alias("child"), F.when(gone, _added(values, "acc", "one.up")).alias("diff"),
    )
    moved = met.where("gone").select(F.col("child").alias("id"), F.col("parent").alias("above"), _added(values, "acc", "up").alias("more"))
    joined = met.join(moved, "id", "left")
    return joined.select(
        "id", F.coalesce("above", "parent").alias("parent"), "k", "acc",
        F.when(F.col("more").isNull(), F.col("up")).otherwise(_added(values, "up", "more")).alias("up"), "gone", "child", "diff",
    )


def _jumped(jumps: DataFrame, values: list[str]) -> DataFrame:
    """Every jump followed until its end, which was raked."""
    while True:
        seen = Observation()
        onward = jumps.select(F.col("id").alias("child"), F.col("child").alias("next"), F.col("diff").alias("more"))
        joined = jumps.join(onward, "child", "left").select(
            "id", F.coalesce("next", "child").alias("child"), _added(values, "diff", "more").alias("diff"), F.col("next").isNotNull().alias("on")
        )
        jumps = stored(joined.observe(seen, F.count_if("on").alias("on")), "jumps").drop("on")
        if not seen.get["on"]:
            return jumps
