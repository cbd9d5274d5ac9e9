"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b")))


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root has a root."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return bad.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` to ``id, component``: the least id that each linked id reaches.

    Ids without links do not appear.  Every node keeps one row a round; the
    edges of a large centre meet in one join, which Spark splits among tasks if it
    deals out skewed joins.  Rounds grow with the logarithm of the longest path.
    The result is written, so it can be read several times.
    """
    given = saved(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())  # the steps below read their input several times
    now = saved(_small_star(given).distinct())
    while not _is_forest(now):
        now = saved(_small_star(_large_star(now)).distinct())
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
