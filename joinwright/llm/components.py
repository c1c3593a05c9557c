"""Connected components of a table of links, by contraction with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``: every node of a link with the smallest node reachable from it.

    Each round points every root at its smallest neighbour, follows the pointers to their roots, and joins the
    links to these roots, so that links inside a component vanish; the number of roots with links at least
    halves in each round. Nulls and loops are ignored. Neighbourhoods are only ever reduced with ``min``, which
    combines before the shuffle, so a node with very many links is no hot group.
    """
    links = links.select("a", "b").where("a <> b").distinct()
    links = materialise(links, "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    labels = materialise(labels, "labels")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("other"))
        parent = materialise(parent.select("root", F.least("root", "other").alias("up")), "parents")
        moved = True
        while moved:  # pointers fall strictly, so following them ends at the roots
            above = parent.select(F.col("root").alias("up"), F.col("up").alias("top"))
            step = parent.join(above, "up", "left").select("root", F.coalesce("top", "up").alias("up"), F.coalesce(F.col("top") != F.col("up"), F.lit(False)).alias("moved"))
            step = materialise(step, "parents")
            parent, moved = step.select("root", "up"), not step.where("moved").isEmpty()
        top = parent.select(F.col("root").alias("component"), F.col("up").alias("top"))
        labels = materialise(labels.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        a, b = (parent.select(F.col("root").alias(x), F.col("up").alias(f"{x}_top")) for x in "ab")
        links = links.join(a, "a").join(b, "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b")).where("a <> b").distinct()
        links = materialise(links, "links")
    return labels
