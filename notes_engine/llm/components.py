"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notes_engine.llm.common import dropped, gathered, stored


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label, and old, of no use) for each node of links (x, y): label is the least node that x reaches.

    rounds: how many are made at most; then nodes of one label are of one
    component, but a component may still have several labels.

    Each round, every node takes the least of the labels next to it and of its
    label's label, so that chains halve; a table is written each round.
    Repeated links, loops and no links at all are fine.
    """
    both = stored(gathered(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()), "links")
    labels = stored(gathered(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label"))), "labels")
    for made in count(1):
        now = labels.select("node", "label")
        near = both.join(now.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        ahead = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = stored(gathered(now.join(near, "node").join(ahead, "label", "left").select("node", F.least("label", "near", F.coalesce("further", "label")).alias("label"), F.col("label").alias("old"))), "labels")
        dropped(labels)
        labels = lower
        if made == rounds or labels.where(F.col("label") != F.col("old")).isEmpty():
            dropped(both)
            return labels
