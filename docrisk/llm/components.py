"""Connected components of a large graph: smallest label over neighbours with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; ``label`` is the smallest node of the component.

    Each round takes the smallest label among the neighbours and then the label of that label, and is stored,
    so the lineage stays short. Stars, as made by buckets, end after two rounds. A hub's edges are the side of
    the join an adaptive plan splits; minima combine before the shuffle.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(low.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def of_members(pairs: DataFrame, node: str, lead: str) -> DataFrame:
    """(node, label) from rows that tie nodes to leads, where a lead is tied to itself, too.

    A node follows its smallest lead. Only leads that share a node are edges, each to the smallest of that node and
    counted once, so what the rounds join grows with the leads and not with the members of their groups.
    """
    tied = pairs.select(F.col(node).alias("node"), F.col(lead).alias("lead"))
    led = tied.withColumn("first", F.min("lead").over(Window.partitionBy("node")))
    labels = components(led.where("lead <> first").select(F.col("lead").alias("a"), F.col("first").alias("b")).distinct())
    members = led.select("node", "first").distinct()
    return members.join(labels.select(F.col("node").alias("first"), "label"), "first", "left").select("node", F.coalesce("label", "first").alias("label"))
