"""Connected components by alternating star contractions, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, of every node that occurs in links (its first two columns, longs).

    Each round points every node at the smallest of its neighbours, from both ends, so that trees become stars
    in a number of rounds that grows with the logarithm of their depth. Only sums leave the executors. The links of a round are
    written to shared storage, which ends the lineage. Loops are left out; repeated links count once."""
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges = storage.keep(edges, "links")
    total = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = edges.agg(*total).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, storage.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        storage.discard(last)
        now = edges.agg(*total).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
