"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import drop_tables, table


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of edges (a long, b long): rows (v, component), the smallest id of each.

    Alternates large-star and small-star steps, each an aggregation with map-side combine and a
    join, and writes the edges of each round to the shared folder. The smallest neighbours are
    written too, so that the join has plain shuffles below it and adaptive execution can split the
    rows of a hub that very many others link to. Ends when every vertex is the root of a star or
    has one edge, to a root; that is observed while the smallest neighbours are written. Each
    round's tables are deleted when the next one's are there.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = e.select("a", "b", F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.sum("up").alias("up"), F.count("*").alias("n"))
        seen = Observation()
        # counts of tasks that run twice only keep the end from being seen, for a round
        least = table(least.observe(seen, F.count_if((F.col("up") > 0) & ((F.col("up") > 1) | (F.col("n") > F.col("up")))).alias("open")).select("a", F.least("m", "a").alias("m")))
        if not seen.get["open"]:
            drop_tables(least)
            break
        large = both.select("a", "b").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = table(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        drop_tables(e, least)
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
