"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b): component is the smallest node that links reach.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label; labels meet
    in a number of rounds that grows with the logarithm of a component's width on all but contrived graphs, and every
    round is one aggregation with partial sums, so a hub of any degree is no large group. Loops and repeated links are
    harmless; no links, no rows.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "component-links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "component-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        near = labels.join(heard, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(near.join(far, "component").select("node", F.least("component", "next").alias("component"), "was"), "component-labels")
        drop_cut(labels)
        labels = new
        if labels.where("component <> was").isEmpty():
            drop_cut(both)
            return labels.select("node", "component")
