"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import Rounds


ROWS_PER_FILE = 500_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Each round makes every node point at the smallest node it knows; the number of
    rounds grows with the logarithm of the longest chain. Only distinct links are
    kept, and minima are pre-aggregated, so a node with very many links is no load.
    """
    rounds = Rounds(links.sparkSession)
    edges = rounds.settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    # Each round writes tables; a few links are not worth a file per shuffle partition.
    parts = max(4, edges.count() // ROWS_PER_FILE)
    few = parts < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = (lambda df: rounds.settle(df.coalesce(parts))) if few else rounds.settle
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            both.where("v < u").join(least, "u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        large = kept(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = kept(large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
            .where("u != v").distinct())
        rounds.drop(1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
