"""Connected components of a distributed edge list, without moving links to the driver.

Alternating stars: every node points its larger neighbours, then its smaller ones, at the smallest node it
knows, until the links are a forest of stars; rounds grow with the logarithm of a component's diameter. Each step is a grouped minimum (combined
before the shuffle, so a hub costs one row per task) and a join whose hot key adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """One half step. ``e`` has (a, b), a > b."""
    if large:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # b > a: the neighbour is larger than the node; it points at the smallest one the node knows
    else:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that its links reach."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = store.save(e, "edges")
    while True:
        # done when it is a forest of stars: every larger end has one smaller end, which has none itself
        ends = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        chained = e.join(ends.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if not ends.filter("n > 1").select("a").union(chained).limit(1).count():
            break
        e = store.save(_stars(_stars(e, True), False), "stars")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
