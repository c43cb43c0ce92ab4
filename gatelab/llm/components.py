"""Distributed union-find: connected components of a graph given as links.

Alternating large-star and small-star steps: every node hooks its larger
neighbours, then its smaller ones, to the least neighbour.  Each step is a
grouped minimum (partially aggregated) and a join, so a node with any share of
the links doesn't gather its neighbours in one task; the number of rounds grows
with the logarithm of the longest chain.

Also what rules links out before anything is compared: bitmaps of sets.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import drop_scratch, write_scratch


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (longs).  Returns node, component (its least node) for every node that has a link to another."""
    links = write_scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: neighbours above u go to the least node around u
        large = links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its neighbours below go to the least of them
        below = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(below, "u")
        new = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(below.select("u", "m")).where("a <> b").distinct()
        new = write_scratch(new, "links")
        # done when every node has one link, to a node that has none upward
        tops = new.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("b", F.lit(0), F.lit(1)))
        open_nodes = tops.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()
        drop_scratch(links)
        links = new
        if not open_nodes:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            )


def may_be_alike(x: str, y: str, bitmap: list[str], threshold: float) -> Column:
    """False only where two sets are surely less alike than the threshold (Jaccard).  x and y name rows with longs of a bitmap, a
    bit for each element by its hash, and `many`, no less than the size of the set.  A bit that differs stands for at least
    one element that isn't shared, no more are shared than the smaller set has, and of all elements of two alike sets few aren't."""
    differ = reduce(add, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bitmap])
    least, both = F.least(F.col(f"{x}.many"), F.col(f"{y}.many")), F.col(f"{x}.many") + F.col(f"{y}.many")
    return differ <= F.least((1 - threshold) / threshold * least, (1 - threshold) / (1 + threshold) * both) + 1e-6
