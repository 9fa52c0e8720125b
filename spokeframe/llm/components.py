"""Connected components of a table of links, by smallest labels with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept


def components(links: DataFrame) -> DataFrame:
    """node, label for every end of ``links`` (a, b: long); label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so rounds grow with the logarithm of a chain's length. Nothing but a row
    count reaches the driver; a node with many links is a partial minimum per task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(both.where("a <> b").distinct(), "links")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        nearer = kept(nearer, "labels")
        of_label = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = nearer.join(of_label, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        new = kept(new, "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
