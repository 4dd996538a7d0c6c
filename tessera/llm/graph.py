"""Connected components by minimum labels and pointer jumping, as joins over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so long chains
    shrink by half or more. Nodes of many edges are combined before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = checkpointed(both.where("node <> other").distinct())
    label = checkpointed(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        seen = label.select(F.col("node").alias("other"), F.col("component").alias("near"))
        low = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = label.join(low, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("top"))
        step = checkpointed(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("top", "component")).alias("component")))
        if not step.where("old <> component").limit(1).count():
            return step.select("node", "component")
        label = step.select("node", "component")
