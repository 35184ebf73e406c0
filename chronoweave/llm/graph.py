"""Connected components of a link table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node that links reach.

    Links may repeat, point either way or join a node with itself; rows with a null end are ignored. Each pass writes
    its links to the shared folder, so a lost executor costs a pass at most. No group is gathered: both stars are a
    minimum per node and a join, whatever the degree. The passes end once every component is a star.
    """
    edges = store.written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links"
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        edges = store.written(small.union(small_least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each component is a star around its smallest node already: no node has two smaller ones, or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of_node.agg(F.sum(F.expr("int(up > 1 or up > 0 and down > 0)"))).first()[0]
