"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, write_table

MOST_ROUNDS = 60
EDGES = "low long, high long"


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (its smallest member) for every node of `edges` (u, v) with a link to another.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every round hangs a node's
    larger, then its smaller neighbours under the smallest one it knows, until the edges are stars.
    Rounds grow with the logarithm of the longest chain; edges are written to the shared folder after
    every round, and only whether they are stars reaches the driver. Each
    node's smallest neighbour is dealt out anew before it meets the node's edges, so that adaptive
    execution can split the edges of a hub: sums and edges would share a partitioning otherwise.
    `rows` is a bound on the edges, if there is one; no round makes more of them.
    """
    spark = edges.sparkSession
    now = write_table(edges.filter("u <> v").select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).distinct(), "edges", rows)
    read = lambda path: spark.read.schema(EDGES).parquet(path)
    for _ in range(MOST_ROUNDS):
        held = read(now)
        ends = held.select(F.col("low").alias("n"), F.lit(0).alias("under")).union(held.select("high", F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("under").alias("under"), F.count(F.lit(1)).alias("all"))
        if not ends.filter("under > 1 OR under = 1 AND all > 1").limit(1).count():  # stars: nothing hangs twice, or hangs and holds
            return held.select(F.col("high").alias("node"), F.col("low").alias("component")).union(held.select("low", "low").distinct())
        both = held.select(F.col("low").alias("n"), F.col("high").alias("m")).union(held.select("high", "low"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("to")).hint("rebalance")
        large = both.filter("m > n").join(least, "n").select(F.col("to").alias("low"), F.col("m").alias("high")).distinct()
        roots = large.groupBy("high").agg(F.min("low").alias("to")).hint("rebalance")
        small = large.join(roots, "high").select(F.col("to").alias("low"), F.col("low").alias("high")).filter("low < high")
        small = small.union(roots.select(F.col("to").alias("low"), "high"))
        after = write_table(small.distinct(), "edges", rows)
        remove(spark, now)
        now = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
