"""Connected components by least labels with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.skew import skew_join
from corpusloom.llm.store import save


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) in, rows (node, label) out; label is the least node of the component.

    Each round takes the least label of all neighbours and then the label of that label,
    so the number of rounds is about the logarithm of the longest path.  A node with a large share
    of all edges, or a label of a large component, is no hot key (`skew_join`)."""
    both = edges.where("a <> b").select("a", "b")
    both = save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = skew_join(both, label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = save(label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = save(skew_join(low, up, "label").select("node", "old", F.least("label", "up").alias("label")))
        label = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return label
