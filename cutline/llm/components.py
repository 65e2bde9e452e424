"""Connected components of an edge table, as a loop of joins over written labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) for every vertex of an edge; label is the least vertex of its component.

    edges: columns a and b of one orderable type, undirected; repeated edges and loops
    are allowed.  Each round takes the least label of the neighbours and then follows that
    label's own label, so rounds grow with the logarithm of a component's diameter.
    Nothing is collected.
    """
    both = scratch.table(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    first = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"))
    labels = scratch.table(first, "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        )
        near = labels.join(heard, "v", "left").select("v", F.col("label").alias("old"), F.least("label", "m").alias("near"))
        jump = labels.select(F.col("v").alias("near"), F.col("label").alias("far"))
        new = near.join(jump, "near", "left").select("v", "old", F.least("near", "far").alias("label"))
        new = scratch.table(new, "labels")
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            return labels
