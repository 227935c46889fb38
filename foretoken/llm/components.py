"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    hung = both.where("v > u").join(low, "u")
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; ``links`` have u > v."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    hung = links.join(low, "u").where("v > low")
    return (
        hung.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionAll(low.select("u", F.col("low").alias("v")))
        .distinct()
    )


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` links of BIGINT nodes -> ``(node, component)``, its smallest reachable node.

    Only nodes with a link to another node are returned. Nulls and links of a node with itself are
    left out, repeated links count once. No round needs a node's links in one place: minima are
    aggregated before the shuffle, and the joins have one row per node on one side, so that a hot
    node can be split. Every round is stored.
    """
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    now = scratch.store(
        links.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        # Two numbers.
        found = now.agg(
            F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).first()
        if state == (found.n, found.x) or not found.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = (found.n, found.x)
        after = scratch.store(_small_star(_large_star(now)), "links")
        scratch.drop(now)
        now = after
