"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursepulse.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the label is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    the rounds grow with the logarithm of the longest chain. A node's neighbours are only ever
    reduced to their minimum, combined before the shuffle; tables of a round are written, which
    cuts the lineage. No links give no rows.
    """
    both = stored(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("m")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("m").alias("m"))
        )
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("low"))
        lowered = stored(lowered, "lowered")
        jump = lowered.select(F.col("node").alias("low"), F.col("low").alias("next"))
        labels = stored(
            lowered.join(jump, "low").select(
                "node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")
            ),
            "labels",
        )
        changed = labels.where("changed").limit(1).count()
        labels = labels.drop("changed")
        if not changed:
            return labels
