"""Connected components of a link relation, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    """Each link once from either end; an array keeps the plan at one scan of the links."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                             F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return links.select(ends.alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    pairs = _both_ways(links)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; ``root`` is the smallest node reachable.

    ``links`` has the two columns ``a`` and ``b`` of one orderable type, in any direction; self-links, repeats
    and rows with a null end are ignored.  An empty relation gives an empty result.  Every round writes the links to
    the shared checkpoint folder, so a lost executor repeats one round at most; rounds grow with the logarithm of
    the longest chain, and nothing but one checksum row a round reaches the driver.
    """
    current = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        current = cut_lineage(_small_star(_large_star(current)).distinct())
