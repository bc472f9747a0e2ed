"""Connected components of large graphs in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges``: equal roots mean one component.

    Each round gives every node a random rank, lets it point at the best ranked node among
    itself and its neighbours, and contracts the edges along the pointers; a fresh ranking each
    round removes a constant share of the nodes on average, also on long chains. The best
    neighbour is an aggregate that combines before the shuffle, so a hub is not a hot task.
    Every round is a table in the shared folder. Null endpoints and loops make no link.
    """
    live = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                       .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    roots = cut_lineage(nodes.select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while live.limit(1).count():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))
        both = live.select("a", "b").union(live.select("b", "a"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        point = cut_lineage(best.select(F.col("a").alias("node"),
                                        F.least(F.col("m"), rank("a"))["n"].alias("to")), "pointers")
        move_a = point.select(F.col("node").alias("a"), F.col("to").alias("x"))
        move_b = point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        next_live = cut_lineage(live.join(move_a, "a").join(move_b, "b").filter("x <> y")
                                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                                .distinct(), "edges")
        moved = point.select(F.col("node").alias("root"), "to")
        next_roots = cut_lineage(roots.join(moved, "root", "left")
                                 .select("node", F.coalesce("to", "root").alias("root")), "roots")
        for old in (live, roots, point):
            drop_scratch(old)
        live, roots = next_live, next_roots
    return roots
