"""Connected components of links too many for one machine, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); nodes of a component have the same root, one of them.

    Each round every node moves to the neighbour (or itself) whose hash, another one each round,
    is least; links are carried over to where their ends moved, and those within a node vanish. A
    star vanishes in a round; a chain loses a constant share of its nodes on average. Moves are written out, so a
    lost executor costs its own part only. Minima are taken before the shuffle; a node with very
    many links is split by the adaptive join.
    """
    moves, round_ = [], 0
    links = stage(links.select("a", "b").where("a <> b").distinct())
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(round_)).alias("h"), F.col(c).alias("n"))
        moved = ends.groupBy("a").agg(F.min(rank("b")).alias("least"))
        moved = moved.select(F.col("a").alias("node"), F.least("least", rank("a"))["n"].alias("root"))
        moved = stage(moved)
        moves.append(moved)
        left = links.join(moved.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("a"), "b")
        both = left.join(moved.withColumnRenamed("node", "b"), "b").select("a", F.col("root").alias("b"))
        pair = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = stage(pair.distinct())
        round_ += 1
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0]
    for later in moves[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out if len(moves) == 1 else stage(out)
