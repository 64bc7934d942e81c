"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savanto.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in the links ``(a, b)``; a component is named by its smallest node.

    Each round links every neighbour of a node, and the node, with the smallest of them all. That keeps
    the components and flattens them to stars in a number of rounds that grows with the logarithm of their
    width. A round is stored, so a lost executor costs one round at most. Partial minima are taken before
    the exchange; a node with very many links is split by the skew join.
    """
    edges = written(_both_ways(links.select("a", "b")), "edges")
    while True:
        least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        met = edges.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        ends = met.groupBy("v").agg(F.min("m").alias("low"), F.max("m").alias("high"))
        if ends.where("low <> high").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        edges = written(_both_ways(met.select(F.col("v").alias("a"), F.col("m").alias("b"))), "edges")


def _both_ways(links: DataFrame) -> DataFrame:
    """Links in both directions, each once, none from a node to itself."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return links.where("a <> b").select(ends.alias("e")).select("e.u", "e.v").distinct()
