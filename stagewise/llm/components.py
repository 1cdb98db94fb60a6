"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge.

    ``edges`` has columns u and v of one orderable type. Each round is two groupings with
    map-side minima and two joins with a table of one row per node. The minima of nodes that
    have more than a hundredth of all edges (there are at most two hundred) are broadcast, so
    the edges of a hub are never brought together. The number of rounds grows with the
    logarithm of the longest chain. Minima and stars are stored one by one: in one plan each
    use of them would be planned again, with all that it is made from.
    """
    current = stored(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        current = stored(_small_star(stored(_large_star(current, state[0])), state[0]))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select("v", "v").distinct())


HUB_SHARE = 100


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """The edges u, v with u's minimum m, where ``least`` has u, m and the number of edges n."""
    hub = F.col("n") > count / HUB_SHARE
    hubs = F.broadcast(least.where(hub).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    known = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    return known.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).union(
        known.where("hub is null").join(least.where(~hub), "u").select("u", "v", "m"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = stored(both.groupBy("u").agg(
        F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    return _with_least(both, least, count).where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    rest = _with_least(edges, least, count).where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m"))).distinct()
