"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is its smallest node.

    A round gives each node the smallest label among its neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path. Neighbours are only aggregated.
    """
    both = checkpoint(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links"
    )
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "cc-labels")
    while True:
        theirs = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
        least = theirs.groupBy("a").agg(F.min("seen").alias("seen"))
        near = labels.join(least, labels["node"] == least["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("component")
        )
        near = checkpoint(near, "cc-near")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = checkpoint(near.join(up, "component").select("node", "old", F.least("component", "up").alias("component")), "cc-labels")
        settled = jumped.where("component <> old").isEmpty()
        labels = jumped.select("node", "component")
        if settled:
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after more ``links``: the rounds see components that a new link joins, not the links of before."""
    end = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    moved = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")
    )
    merged = components(moved.where("a <> b").distinct())
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = labels.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return checkpoint(known.unionByName(merged.join(labels, "node", "left_anti")), "cc-labels")
