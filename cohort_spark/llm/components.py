"""Connected components of an edge table, by contraction.

Each round gives every vertex the neighbour (or itself) that comes first in an
order drawn anew by a hash, and replaces both ends of every edge by them.  A
connected part stays connected, and its last vertex in the order is never
picked, so parts shrink until no edge is left, by a constant factor a round
whatever the order of the ids.  Rounds are written to the shared folder; the
vertices' places are then traced through the rounds backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.sources.stages import stage


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b longs) that has another: the smallest vertex reachable.

    Repeated edges and edges given in both directions are allowed; loops and
    edges with a missing end are left out.  No vertex gives no row.
    """
    edges = edges.where("a <> b")
    vertices = stage(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct(), "vertices")
    moves = []
    left = _between(edges)
    while not left.isEmpty():
        moves.append(stage(_picks(left, len(moves)), "moves"))
        to = moves[-1]
        left = _between(left.join(to.select(F.col("v").alias("a"), F.col("w").alias("x")), "a")
                        .join(to.select(F.col("v").alias("b"), F.col("w").alias("y")), "b")
                        .select(F.col("x").alias("a"), F.col("y").alias("b")))
    if not moves:
        return vertices.select("v", F.col("v").alias("label"))
    ends = moves.pop()
    while moves:
        later = ends.select(F.col("v").alias("w"), F.col("w").alias("end"))
        ends = stage(moves.pop().join(later, "w", "left").select("v", F.coalesce("end", "w").alias("w")), "ends")
    smallest = ends.groupBy("w").agg(F.min("v").alias("label"))
    return stage(vertices.join(ends.join(smallest, "w").select("v", "label"), "v", "left")
                 .select("v", F.coalesce("label", "v").alias("label")), "labels")


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges between two vertices, the smaller one first, written."""
    return stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _picks(edges: DataFrame, turn: int) -> DataFrame:
    """(v, w): the first of a vertex and its neighbours, then the first one of that."""
    order = lambda col: F.struct(F.xxhash64(F.lit(turn), F.col(col)).alias("h"), F.col(col).alias("w"))
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    first = stage(both.groupBy("v").agg(F.min(order("w")).alias("best")).select("v", F.least(order("v"), F.col("best")).alias("best"))
                  .select("v", "best.w"), "first")
    return first.join(first.select(F.col("v").alias("w"), F.col("w").alias("x")), "w").select("v", F.col("x").alias("w"))
