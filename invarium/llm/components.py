"""Connected components by label propagation with pointer jumping, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a long, b long).

    Each round takes the smallest label of all neighbours, then the label of
    that label, so that the rounds grow with the logarithm of the longest
    chain.  Labels are written as tables; a node with very many links is a
    skewed side of a plain join that Spark may split, and its messages are
    pre-aggregated.  Nothing reaches the driver but the count of changes.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = staged(links.distinct().select(ways.alias("l")).select("l.a", "l.b"), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = staged(
            labels.join(heard, labels.node == heard.a, "left").select("node", F.least("component", F.coalesce("heard", "component")).alias("component"), F.col("component").alias("before")), "nearer"
        )
        target = nearer.select(F.col("node").alias("component"), F.col("component").alias("jumped"))
        labels_new = staged(nearer.join(target, "component").select("node", F.col("jumped").alias("component"), (F.col("jumped") != F.col("before")).alias("changed")), "labels")
        labels = labels_new.select("node", "component")
        if not labels_new.filter("changed").limit(1).count():
            return labels
