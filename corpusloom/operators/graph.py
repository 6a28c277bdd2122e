"""Paths in message forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_paths(nodes: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """root, depth, id: from each root along the child of least (rank, id), until a node has none.

    nodes: id, parent, rank. Each parent's best child is found once by an aggregate; the walk is a recursive query.
    """
    spark = nodes.sparkSession
    best = nodes.groupBy("parent").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
    return spark.sql(
        """WITH RECURSIVE path(root, depth, id) MAX RECURSION LEVEL """ + str(int(max_depth)) + """ AS (
            SELECT root, 0, root FROM {roots}
            UNION ALL
            SELECT path.root, path.depth + 1, b.id FROM path JOIN {best} b ON b.parent = path.id)
        SELECT root, depth, id FROM path""",
        roots=roots,
        best=best,
    )
