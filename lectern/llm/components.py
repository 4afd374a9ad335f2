"""Connected components of a link table that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def _settled(links: DataFrame) -> bool:
    """Whether every node has a single smaller neighbour and no node is both a larger and a smaller one."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("lo", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    smaller = links.join(least, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return smaller.union(least.select("hi", F.col("m").alias("lo")))


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``pairs`` (columns ``a``, ``b``); the component is its smallest node.

    Alternating large and small stars over written tables until all links lead to a root; each round
    is two joins and two sums, all split by node. A pair of a node with itself is ignored, and so are
    pairs with a null.
    """
    links = written(
        pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    while not _settled(links):
        links = written(_small_star(_large_star(links)).distinct(), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
