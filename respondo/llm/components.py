"""Connected components of a link table, by joins and aggregations.

Every node starts with its own number as label. In each round a node takes
the smallest label among its neighbours (the aggregation is combined before
the shuffle, so a node with very many links costs little) and then the label
of its label (pointer jumping), until no label changes. Each round is a
written table; nothing is gathered on the driver but the number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondo.llm.common import stage


def fewer(links: DataFrame) -> DataFrame:
    """The same components with fewer links (a < b): a node keeps the link
    to its smallest neighbour, which its other smaller neighbours get."""
    least = F.min("a").over(Window.partitionBy("b")).alias("least")
    near = stage(links.select("a", "b", least), "near-links")
    return (near.select(F.col("least").alias("a"), "b")
            .union(near.where("a <> least").select("least", "a")).distinct())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable,
    for every node with a link. Null ends and links to itself are ignored."""
    real = links.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    real = fewer(fewer(real))
    both = stage(real.select(F.col("a").alias("u"), F.col("b").alias("v"))
                 .union(real.select("b", "a")), "links")
    labels = stage(both.groupBy(F.col("u").alias("node"))
                   .agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("next"))
        after = stage(lower.join(jump, "best").select(
            "node", F.least("best", "next").alias("label"),
            (F.least("best", "next") < F.col("label")).alias("moved")), "labels")
        if not after.where("moved").limit(1).count():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, component, ...) with ``component_id`` (the smallest
    id in the component; null if it has none), ``kept`` (the row's id is
    that) and ``first`` (true for exactly one row of each component)."""
    heads = stage(rows.groupBy("component").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("head")), "heads")
    return (rows.join(heads, "component")
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
            .withColumn("first", F.col("row") == F.col("head.row")).drop("head"))
