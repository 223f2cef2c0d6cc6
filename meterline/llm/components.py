"""Connected components of links by alternating stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterline import session


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the least node reachable.

    A large star joins every greater neighbour of a node to its least neighbour, a small star every lesser one; they
    alternate until all links are stars around their least node, which takes about log(longest chain) rounds and none where
    they are so from the start. Self links are dropped.
    """
    now = session.checkpoint(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _open(now):
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = session.checkpoint(small.select("e.a", "e.b").filter("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _open(links: DataFrame) -> bool:
    """Whether some node of different links (a, b), a > b, has a lesser neighbour and one more neighbour: then they are no stars yet."""
    ends = _both(links).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return ends.agg(F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1))).first()[0] > 0
