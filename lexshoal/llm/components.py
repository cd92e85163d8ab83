"""Connected components of a distributed edge list.

Each round every node points to its neighbour (or itself) of least random priority; edges move to
where their ends point, and edges inside a node go. Priorities change by round, so paths and stars
shrink by a share of their nodes in each round. Rounds are written tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshoal.storage import materialize, scratch


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), written; nodes of one component share a root, itself a node."""
    with scratch(edges.sparkSession, "roots"):
        return materialize(_contracted(edges), "roots")


def _contracted(edges: DataFrame) -> DataFrame:
    left, pointers = materialize(_ordered(edges), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, r=len(pointers): F.struct(F.xxhash64(F.lit(r), c).alias("rank"), F.col(c).alias("id"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        points = materialize(best.select(F.col("a").alias("node"), F.least("best", rank("a"))["id"].alias("to")), "pointers")
        pointers.append(points)
        for end in ("a", "b"):
            left = left.join(points, left[end] == points["node"]).drop(end, "node").withColumnRenamed("to", end)
        left = materialize(_ordered(left), "edges")
    if not pointers:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pointers[0].withColumnRenamed("to", "root")
    for points in pointers[1:]:
        more = points.select(F.col("node").alias("root"), "to")
        roots = roots.join(more, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots
