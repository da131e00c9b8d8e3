"""Connected components of a set of links, by spreading the smallest name and jumping along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (long columns ``a, b``); root is the smallest node
    it is connected with.

    Each round takes the smallest label of the neighbours (combined before the shuffle), then the
    label of the label, so that chains of any length settle in about as many rounds as the logarithm
    of their length. Labels are written to the shared folder after each round; joins read written
    tables on both sides, so that adaptive execution can split the links of a hub.
    """
    both = staged(
        links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct()
    )
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        heard = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("root").alias("heard"))
        )
        spread = staged(
            labels.join(heard, "node", "left").select("node", F.least("root", "heard").alias("near"), F.col("root").alias("was"))
        )
        target = spread.select(F.col("node").alias("near"), F.col("near").alias("far"))
        jumped = staged(
            spread.join(target, "near", "left").select("node", F.least("near", "far").alias("root"), "was")
        )
        changed = jumped.filter(F.col("root") != F.col("was")).limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
