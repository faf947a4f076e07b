"""Connected components of an edge table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.store import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, root)`` for every node with an edge to another node.

    ``root`` is the smallest id reachable. Alternating large-star and small-star contraction: each round
    hangs every neighbour of a node on the smallest id nearby, until nothing changes. A node with very many
    neighbours only meets a pre-aggregated minimum and joins that Spark can split. Self-links, repeated
    links and null ends are ignored; no edges give no rows.
    """
    links = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = saved(links, "links")
    seen = _signature(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        links = saved(links.distinct(), "links")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.shiftright(mixed, 20)).alias("s"),
        F.bit_xor(mixed).alias("x"),
    ).first()
    return tuple(row)
