"""Connected components by alternating large-star and small-star, on edge tables that never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, shuffle_parts


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest vertex around it."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is tied to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return moved.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each vertex with an edge and the smallest vertex of its component, which itself is left out.

    edges: columns u, v of long vertices in any order; loops and repeated edges do no harm.
    """
    # edges are few beside the rows they come from, and each round writes them: an eighth of the usual files is enough
    files = max(1, shuffle_parts(edges.sparkSession) // 8)
    state = Staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(files), "edges")
    mark = None
    while True:
        now = state.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            return state.df
        mark = tuple(now)
        after = Staged(small_star(large_star(state.df)).coalesce(files), "edges")
        state.drop()
        state = after
