"""Connected components of links, by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and component (the least node reachable) for every node that a link (a, b) has; nothing for others.

    Every round hangs each node's larger neighbours on its least one, then its smaller ones; a round is a few joins and
    aggregations with partial results, whatever the size of a component, and the links are written between rounds. The
    number of rounds grows with the logarithm of the longest chain.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    scratch = scratch or Scratch(links.sparkSession)
    links = scratch.write(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    while True:
        after = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1048576))")).first()
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        before = after
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        small = small.select("u", F.col("least").alias("v")).union(small.select(F.col("v").alias("u"), F.col("least").alias("v")))
        links = scratch.write(small.where("u <> v").distinct(), "links")
