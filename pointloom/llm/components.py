"""Connected components of a graph by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node of the edges, which are pairs of longs.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least node it knows; the rounds end
    when each node hangs on one that hangs on none, after about the logarithm of the longest path. Loops, repeated edges
    and either direction are allowed; a null end is left out. No edges give no rows. Every round is written to the
    shared folder.
    """
    own = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = C.checkpoint(own.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops, stars = first.where("a = b"), first.where("a <> b")
    end = lambda node, root, up, down: F.struct(F.col(node).alias("node"), F.col(root).alias("root"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    alone = loops.select(end("a", "a", 0, 0).alias("x"))
    while True:
        ends = stars.select(F.explode(F.array(end("a", "b", 1, 0), end("b", "b", 0, 1))).alias("x")).union(alone)
        found = ends.groupBy("x.node").agg(F.min("x.root").alias("root"), F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
        found = C.checkpoint(found)
        if found.where("up > 1 OR up = 1 AND down > 0").isEmpty():
            return found.select("node", "root")
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        stars = C.checkpoint(small.distinct())
