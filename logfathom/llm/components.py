"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; no node's neighbours are ever collected. A node
with more than one ``HUBS``-th of all links is a hub: there are at most twice ``HUBS`` of
them, so their minima are broadcast and their links stay where they are, and no task of a
join by node holds more than that share for one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

HUBS, HUB_LINKS = 100_000, 500


def _with_low(links: DataFrame, low: DataFrame, at_least: int) -> DataFrame:
    """``links`` with the ``m`` of their ``u``; ``low`` has one row (u, m, n) a node."""
    hubs = F.broadcast(low.where(F.col("n") >= at_least).select(F.col("u").alias("_u"), F.col("m").alias("_m")))
    marked = links.join(hubs, F.col("u") == F.col("_u"), "left")
    near = marked.where("_u is not null").select("u", "v", F.col("_m").alias("m"))
    far = marked.where("_u is null").select("u", "v").join(low.where(F.col("n") < at_least).select("u", "m"), "u")
    return near.unionByName(far)


def _large(e: DataFrame, at_least: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_low(both.where("v > u"), low, at_least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, at_least: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_low(e, low, at_least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with a link, the smallest node that it reaches."""
    e = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    count = lambda: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, count()
    while now != before:
        before, at_least = now, max(HUB_LINKS, now[0] // HUBS)
        e = staged(_small(staged(_large(e, at_least)), at_least))
        now = count()
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
