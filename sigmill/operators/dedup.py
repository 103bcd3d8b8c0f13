"""Keep-first dedup, insert selection and key-coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``.

    An aggregate rather than a row-number window: copies are dropped on the map side before the
    shuffle, so a key that holds a third of all rows sends one row per task, not a third of them.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Like ``keep_first``; without an order the least of the other columns stays, so the choice is fixed."""
    rest = [c for c in df.columns if c not in keys]
    return keep_first(df, keys, list(order) or rest) if rest else df.distinct()


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Row count, distinct keys and surplus rows."""
    # Two partial aggregates; no task ever holds all rows of one key.
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def not_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str], offered: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not stored.

    The stored keys are first cut down to those on offer. With a small batch that is a broadcast
    of the batch, so a huge stored table is scanned for its keys but never shuffled. ``offered``
    may name a cheaper frame with (at least) the same keys.
    """
    names = list(keys)
    seen = stored.select(*names).join((new if offered is None else offered).select(*names), names, "left_semi")
    return new.join(seen, names, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only; both counts are zero when the key sets are equal."""
    marks = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = marks.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both_sides"),
    )
