"""Connected components by smallest labels with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jointwork.sources.writers import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), any order, loops allowed -> (node, root) with the smallest node of each component.

    Each turn takes the smallest label among neighbours and then the label of
    that label; it ends when no label changes, however long a chain is.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        # An old root hears of the smaller label of its members, so that whole trees move.
        hooks = met.filter(F.col("to") < F.col("was")).groupBy(F.col("was").alias("hook")).agg(F.min("to").alias("hook_to"))
        moved = met.join(hooks, met["node"] == hooks["hook"], "left").select("node", "was", F.least("to", F.coalesce("hook_to", "to")).alias("to"))
        jump = moved.select(F.col("node").alias("via"), F.col("to").alias("on"))
        new = stored(moved.join(jump, moved["to"] == jump["via"], "left").select("node", "was", F.coalesce("on", "to").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("was <> root").limit(1).count() == 0:
            return labels
