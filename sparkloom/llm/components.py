"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node near it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # so that a hub's links can be split
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = common.stored(edges.groupBy("v").agg(F.min("u").alias("m")), "least")
    linked = edges.join(least, "v")
    return linked.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links between longs, u < v, to (node, component): the least node that can be reached.

    Nodes without a link are not in the result. Each round ends in a written table, so nothing is computed twice after a
    loss; the rounds end when a round changes no link, which a count and a sum of hashes show.
    """
    edges, before = common.stored(edges.select("u", "v").where("u < v").distinct(), "links"), None
    rows = edges.count()
    for _ in range(most_rounds):
        # A round never adds links: each of either star has the link or the node that it stems from.
        edges = common.stored(_small_star(common.stored(_large_star(edges), "links", rows)), "links", rows)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        rows = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select("u", F.col("u").alias("component")).distinct())
