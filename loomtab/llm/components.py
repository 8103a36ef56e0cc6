"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.session import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(turned))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "n")
    return both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    """A node and its smaller neighbours v (u > v) are tied to the smallest of them."""
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    tied = down.join(least, F.col("u") == F.col("n"))
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return tied.select(F.inline(ends))


def _settled(edges: DataFrame) -> bool:
    """Whether the links u > v are stars: every u has one link and is the v of none."""
    lower, upper = (F.struct(F.col(c).alias("node"), F.lit(int(c == "u")).alias("low"), F.lit(int(c == "v")).alias("top")) for c in ("u", "v"))
    roles = edges.select(F.inline(F.array(lower, upper))).groupBy("node").agg((F.sum("low") + F.max("top")).alias("roles"))
    return roles.agg(F.count_if(F.col("roles") > 1)).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (u, v); the component is its smallest node.

    Links grow towards stars: rounds grow with the logarithm of the longest chain, and each is checkpointed. A node's
    neighbours are only ever reduced by a partial minimum, so a node with most links is no hot group.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        now = checkpointed(_small_star(_large_star(now)).filter("u <> v").distinct())
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
