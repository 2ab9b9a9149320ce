"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join that the adaptive planner can split,
so a vertex with very many links is no single task's work. Links stay linear in number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that one task of a round takes, so that a small table of links is not dealt into many tiny files round after round.
LINKS_EACH = 20_000


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """links (u, v) in both directions for the large star, from the larger to the smaller vertex for the small star."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = links.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").coalesce(parts).distinct().coalesce(parts)


def components(links: DataFrame) -> DataFrame:
    """Rows (u, component) for every vertex of links (u, v: long, u > v) that is not the smallest of its component.

    Repeated links count once; a link with a null vertex links nothing; an empty table gives an empty result. Ends when a round changes nothing: the
    number of rounds grows with the logarithm of the longest chain, and every round either ends it or brings a vertex nearer to its least.
    """
    current = cut(links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    before = None
    while True:
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return current.select("u", F.col("v").alias("component"))
        before, parts = after, max(1, -(-after[0] // LINKS_EACH))
        current = cut(_star(_star(current.coalesce(parts), True, parts), False, parts))
