"""Connected components by the least label, with lineage cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimfold.plans.shared import discard, materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node of its component, for every node in an edge.

    Each round takes the least label among a node and its neighbours, aggregated before the shuffle, and then the
    label of that label, so long chains halve in each round. Stops when a round changes nothing. Null ends and loops
    are no edges.
    """
    # written before it is turned round, so that what made the edges runs once
    pairs = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y"), "pairs")
    if not pairs.limit(1).count():
        return pairs.select(F.col("x").alias("node"), F.col("y").alias("label"))
    both = materialize(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    discard(pairs)
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), F.col("label").alias("was")), "labels")
        changed = new.where("label <> was").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels._brimfold_path = new._brimfold_path
        if not changed:
            discard(both)
            return labels
