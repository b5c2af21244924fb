"""Connected components of an edge table by alternating star contractions, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge but the roots, with the smallest node it reaches.

    Every round hangs each node's larger neighbours on its smallest one, then its smaller
    ones, until every tree is a star; the number of rounds follows the logarithm of the number of nodes.
    A round's edges are written to the shared folder; no edge goes to the driver. A node of very many
    edges is a sum by key first, then a join whose large keys Spark splits.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below")))
    nodes = ends.groupBy("x").agg(F.sum("below").alias("n"), F.min("below").alias("over"))
    return nodes.where("n > 1 OR (n = 1 AND over = 0)").isEmpty()
