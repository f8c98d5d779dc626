"""Connected components of a graph of links, without gathering any node's links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import join_totals
from ledgerloom.session import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes (longs) of ``links(a, b)``; a component is named by its smallest node.

    Alternates two steps until only stars are left: every node hands the smallest of
    its neighbours (and itself) to its larger neighbours, then to its smaller
    ones. That takes about log(n) rounds, one where groups are small.
    Minima are combined before each shuffle and joined back, so the links of a hub
    are never in one group. Each round is written to the shared folder. Null nodes
    are left out; links to oneself and repeated links change nothing; no links
    give no rows.
    """
    stars = links.select("a", "b").filter("a is not null and b is not null")
    while True:
        stars = stage(_step(_step(stars, larger=True), larger=False), "links")
        if _done(stars):
            break
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def _done(stars: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, which has none itself."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(
        stars.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("centre"))
    )
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return seen.filter("out > 1 or (out = 1 and centre = 1)").isEmpty()


def _step(links: DataFrame, larger: bool) -> DataFrame:
    """Links from nodes to the smallest known node, ``a`` > ``b``."""
    ends = links.filter("a <> b").select("a", "b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        moved = join_totals(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        moved = join_totals(down, least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.filter("a <> b").distinct()
