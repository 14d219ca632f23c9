"""Connected components of a table of links, by alternating large-star and small-star joins.

Each round rewrites the links so that every vertex points at a smaller neighbour; it ends when a round changes nothing.
Rounds grow with the logarithm of the longest chain. Each round is stored in the shared folder. A vertex with very many
links is handled by partial minima before the shuffle and by Spark's split of skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): link every neighbour v (above u if large, else up to u) to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, component) for every node that has a link to another; component is the least node."""
    spark = links.sparkSession
    now = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = None
    while True:
        # count, and two sums of unlike 64-bit hashes of the links
        mark = now.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, before = mark, now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = _star(both, large=True).distinct()
        now = common.stored(_star(up.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False).distinct(), "links")
        common.forget(spark, before)
