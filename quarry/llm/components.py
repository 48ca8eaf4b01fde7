"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _step(edges: DataFrame) -> DataFrame:
    """One large star and one small star."""
    # Large star: each node sends its larger neighbours to its smallest neighbour or itself.
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # Small star: each node and its smaller neighbours go to the smallest of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each linked node with the smallest node it reaches.

    Every step groups by node with partial sums only, so a hub of any degree is no single group;
    the number of steps grows with the logarithm of the longest path. Unlinked nodes have no row.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges, links.count())
    state = _state(edges)
    while state[0]:
        # Never more rows than two for each edge.
        edges = cut(_step(edges), 2 * state[0])
        release(edges.sparkSession)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
