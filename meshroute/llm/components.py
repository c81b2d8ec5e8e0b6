"""Connected components by label propagation and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshroute.llm.common import checkpointed


def connected(edges: DataFrame, most_rounds: int = 60, broadcasts: bool = True) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (a, b).

    In each round a node takes the least label among its neighbours', hands it to the node its own label names, and
    then takes the label of its label. Labels only fall, so that the sum of changes reaches nought; the number of
    rounds is about the logarithm of the longest path. Edges should have few for any one node: link members of a
    group in a chain, not to a hub. Without broadcasts small tables are merged too, which spares the driver's memory.
    """
    side = (lambda df: df) if broadcasts else (lambda df: df.hint("merge"))
    one = edges.where("a <> b").select("a", "b")
    both = checkpointed(one.union(one.select("b", "a")).distinct())
    labels = checkpointed(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(most_rounds):
        of_b, of_a = labels.toDF("b_node", "b_label"), labels.toDF("a_node", "a_label")
        seen = both.join(side(of_b), F.col("b") == F.col("b_node")).join(side(of_a), F.col("a") == F.col("a_node")).where("b_label < a_label")
        said = seen.select(F.explode(F.array("a", "a_label")).alias("to"), "b_label").groupBy("to").agg(F.min("b_label").alias("said"))
        step = checkpointed(labels.join(side(said), F.col("node") == F.col("to"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("said", "label")).alias("label")))
        up = step.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        jumped = checkpointed(step.join(side(up), F.col("label") == F.col("up_node")).select("node", "old", F.col("up_label").alias("label")))
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
