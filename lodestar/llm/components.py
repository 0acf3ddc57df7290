"""Connected components of a graph that no machine holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import staged, unstage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every end of an edge (a, b); root is the smallest node of its component.

    Alternates large and small stars: each node links its larger neighbours, then its smaller ones, to the smallest
    node it knows. The minimum of a hot node is aggregated before the shuffle, and its rows meet it in a join
    that Spark can split. Every round is written to the shared folder. It ends when the edges no longer change.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        new = staged(small.distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        unstage(large)
        unstage(now)
        now = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
