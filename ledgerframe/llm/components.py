"""Connected components of a link table, as repeated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``links`` (a, b).

    Each round every node takes the smallest label among its neighbours, then the label of its
    label; labels spread over chains in a logarithmic number of rounds in practice. Links within
    one label are dropped on the way. Nothing is collected; a round ends in a written table.
    """
    both = links.select("a", "b").filter("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct()
    edges = cut(both, "links")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        lower = edges.join(theirs, "b").groupBy("a").agg(F.min("other").alias("other"))
        near = labels.join(lower, labels["node"] == lower["a"]).select("node", F.col("label").alias("old"), F.least("label", "other").alias("near"))
        near = cut(near, "near-labels")
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = near.join(jump, "near").select("node", "old", F.least("near", "far").alias("label"))
        new = cut(new, "labels")
        changed = not new.filter("label <> old").isEmpty()
        discard(near, labels)
        labels = new
        if not changed:
            discard(edges)
            labels = new.drop("old")
            labels.scratch = new.scratch
            return labels
