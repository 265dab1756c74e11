"""Connected components of an edge table, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (least node of its component) for each node of ``edges`` (``a``, ``b``).

    Each round gives a node the least label among itself and its neighbours and then the label of its
    label, so paths shrink about by half a round. Rounds end when nothing changes; each is cut off
    from its lineage in the shared checkpoint folder.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        new = cut(step.join(up, step["next"] == up["of"], "left").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
