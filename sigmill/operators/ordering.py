"""A global row order without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.session import cut


def order_ids(df: DataFrame, order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """Adds a bigint that increases with ``order`` (unique, with gaps between partitions).

    Range partitioning spreads the rows evenly whatever the values, provided ``order`` ends in a
    unique column. The result is written down: range bounds are sampled, so a recomputed
    partition could otherwise number its rows differently.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "ordered")


def dense_order_ids(df: DataFrame, order: Sequence[str | Column], name: str = "seq", part_name: str | None = None) -> DataFrame:
    """Like ``order_ids`` but consecutive from zero; ``part_name`` adds the number of each row's partition."""
    gapped = order_ids(df, order, "_gapped")
    part = F.shiftright("_gapped", 33)
    # One row per partition: a handful of numbers, summed on the driver.
    sizes = sorted(gapped.groupBy(part.cast("int").alias("part")).count().collect())
    offsets, total = {}, 0
    for row in sizes:
        offsets[row["part"]] = total
        total += row["count"]
    if not offsets:
        none = gapped.withColumnRenamed("_gapped", name)
        return none.withColumn(part_name, F.lit(0)) if part_name else none
    spark = df.sparkSession
    starts = spark.createDataFrame([(k, v) for k, v in offsets.items()], "_part int, _start bigint")
    numbered = (
        gapped.withColumn("_part", part.cast("int"))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_gapped").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_start", "_gapped")
    )
    return numbered.withColumnRenamed("_part", part_name) if part_name else numbered.drop("_part")


def with_rank_in_group(df: DataFrame, group: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """One-based rank inside each group. A group may span many partitions.

    Where a group begins is found from one row per partition and group, and each row meets the row of its own
    partition and group, so a group that holds a third of all rows is as many join keys as it has partitions.
    """
    ordered = dense_order_ids(df, [group, *order], "_seq", "_in")
    heads = ordered.groupBy(F.col("_in").alias("_at"), F.col(group).alias("_group")).agg(F.min("_seq").alias("_head"))
    first = heads.groupBy(F.col("_group").alias("_name")).agg(F.min("_head").alias("_first"))
    begins = heads.join(first, F.col("_group").eqNullSafe(F.col("_name"))).select("_at", "_group", "_first")
    same = (F.col("_in") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group"))
    ranked = ordered.join(begins, same).withColumn(name, F.col("_seq") - F.col("_first") + 1)
    return ranked.select(*df.columns, name)


def with_previous(df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``previous_<column>`` from the row before in the same group, NULL on the first.

    Neighbours are matched by consecutive order numbers: every join key is unique, so one group
    holding most of the rows does not gather in one task.
    """
    ordered = dense_order_ids(df, [group, *order], "_seq")
    before = ordered.select(
        (F.col("_seq") + 1).alias("_seq"),
        F.col(group).alias("_group"),
        *[F.col(c).alias(f"previous_{c}") for c in columns],
    )
    joined = ordered.join(before, "_seq", "left")
    same = F.col("_group").eqNullSafe(F.col(group))
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(same, F.col(f"previous_{c}")).alias(f"previous_{c}") for c in columns],
    )
