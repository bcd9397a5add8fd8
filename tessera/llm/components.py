"""Distributed union-find: connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the smallest node of each component, for every node that has an edge to another.

    In a round every node hooks to its smallest neighbour, chains of hooks are
    shortened to their ends by pointer jumping, and the edges are contracted to
    these ends; edges inside a tree vanish, and long chains take no more rounds
    than short ones.  Rounds go on until no edge is left.  All steps are joins and
    aggregations over stored tables, so a node with very many edges is split like
    any skewed key.  (Checkpoints would keep what Spark knows of the order of
    rows, which doubles with every round of joins; tables don't.)
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while edges.limit(1).count():
        hooks = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"), F.lit(True).alias("moved")))
        while hooks.where("moved").limit(1).count():  # a chain's length halves with every jump
            further = hooks.select(F.col("node").alias("_at"), F.col("to").alias("_to"))
            jumped = stored(hooks.join(further, F.col("to") == F.col("_at"), "left").select("node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
            delete_stored(hooks)
            hooks = jumped
        hooks = hooks.drop("moved")
        further = stored(labels.join(hooks.withColumnRenamed("node", "_at"), F.col("root") == F.col("_at"), "left").select("node", F.coalesce("to", "root").alias("root")))
        delete_stored(labels)
        labels = further
        left, right = hooks.toDF("_a", "_ta"), hooks.toDF("_b", "_tb")
        moved = edges.join(left, F.col("a") == F.col("_a"), "left").select(F.coalesce("_ta", "a").alias("a"), "b")
        moved = moved.join(right, F.col("b") == F.col("_b"), "left").select("a", F.coalesce("_tb", "b").alias("b"))
        contracted = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        delete_stored(edges)
        delete_stored(hooks)
        edges = contracted
    delete_stored(edges)
    return labels
