"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a join with per-node minima (combined before the shuffle), so no node's neighbours
are gathered in one place, and the number of steps grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``u > v``: every neighbour on one side of a node moves to the least of its neighbours."""
    if large:
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (two columns of one ordered type, either order).

    ``root`` is the least node of the component. Repeated links, loops and an empty table are fine;
    links with a null are ignored.
    """
    a, b = links.columns[:2]
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = cut_lineage(pairs.filter(pairs[2]).select("u", "v").distinct())
    before = None
    for _ in range(rounds):
        pairs = cut_lineage(_star(_star(pairs, large=True), large=False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
