"""Pointers followed to their ends, and components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.checkpoints import cut


def followed(pointers: DataFrame, node: str, end: str) -> DataFrame:
    """(node, end): pointers (node, end; one a node, without cycles) followed until what has none. They double in each round."""
    now = cut(pointers.select(node, end))
    while True:
        hop = now.select(F.col(node).alias(end), F.col(end).alias("_to"))
        after = cut(now.join(hop, end, "left").select(node, F.coalesce("_to", end).alias(end), F.col("_to").isNotNull().alias("_moved")))
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each node of links (a, b) reaches; those that reach none smaller than themselves are left out.

    In each round a node points at its smallest neighbour if that is smaller, the pointers are followed, and the links are those between their ends.
    """
    live = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    while not live.isEmpty():
        ends = followed(live.groupBy("a").agg(F.min("b").alias("class")), "a", "class").withColumnRenamed("a", "id")
        after = ends.select(F.col("id").alias("class"), F.col("class").alias("_to"))
        found = ends if found is None else cut(found.join(after, "class", "left").select("id", F.coalesce("_to", "class").alias("class")).unionByName(ends))
        a, b = (ends.select(F.col("id").alias(x), F.col("class").alias(f"_{x}")) for x in "ab")
        moved = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        live = cut(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return links.select(F.col("a").alias("id"), F.col("a").alias("class")).where("false") if found is None else found.distinct()
