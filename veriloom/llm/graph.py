"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    Each round gives a node the smallest label among its neighbours and then that label's own label, so labels
    travel twice as far in each round.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = stash(both.unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst"))).where(F.col("src") != F.col("dst")).distinct(), "links")
    labels = stash(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jumped = lower.join(labels.select(F.col("node").alias("low"), F.col("component").alias("lower")), "low")
        after = stash(jumped.select("node", "was", F.least("low", "lower").alias("component")), "labels")
        changed = after.where(F.col("was") != F.col("component")).limit(1).count()
        discard(labels)
        labels = after.select("node", "component")
        labels._stashed_at = after._stashed_at
        if not changed:
            discard(both)
            return labels
