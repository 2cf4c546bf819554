"""Connected components of a link table, wholly on the cluster.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond"): each round turns the links into links to smaller and smaller nodes, until
they are stars around the smallest node of each component. Rounds grow with the logarithm of the longest
path; each is aggregations with partial sums and joins that AQE splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import checkpointed


def _star(links: DataFrame) -> DataFrame:
    """links (u, v) with u > v -> the same components with links to the least neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.withColumnRenamed("m", "v").unionByName(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) of longs -> (node, component): each linked node and the least node of its component."""
    now = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        digest = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())
        if digest == seen or not digest[0]:
            break
        seen, now = digest, checkpointed(_star(now))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
