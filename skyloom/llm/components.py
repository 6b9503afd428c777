"""Connected components of links between long ids, by least labels with pointer jumping; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): the least node that each node reaches. Links may be repeated and need no order; no null ids.

    A round takes the least label among a node and its neighbours and then that label's own label, so the number of rounds grows with
    the logarithm of a component's diameter. Only a yes or no comes to the driver.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(jumps, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            return labels
