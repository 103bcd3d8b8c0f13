"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``); the component is its smallest node.

    Every round maps each node to the smallest of itself and its neighbours and relabels the edges; loops
    and repeats go. The smallest node of a component maps to itself throughout, so it is what remains.
    A hub's edges collapse on the map side. Rounds are logarithmic in the longest chain of falling ids.
    """
    spark = edges.sparkSession
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).withColumn("low", F.least("node", "low")), "step")
        if label is None:
            label = step.withColumnRenamed("low", "component")
        else:
            label = cut(
                label.join(step.withColumnRenamed("node", "component"), "component", "left").select(
                    "node", F.coalesce("low", "component").alias("component")
                ),
                "label",
            )
        left, right = (step.select(F.col("node").alias(c), F.col("low").alias(f"{c}2")) for c in ("a", "b"))
        edges = cut(
            edges.join(left, "a")
            .join(right, "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .filter("a < b")
            .distinct(),
            "edges",
        )
    return label if label is not None else spark.createDataFrame([], "node bigint, component bigint")
