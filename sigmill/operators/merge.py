"""Batch merges over table snapshots: inserts, upserts, keyed updates, deletes, versions.

Each is a function from DataFrames to the next state of the table. The stored side is only ever
joined on its key; a small batch is broadcast by the optimizer after its size is measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.counters import side_by_side
from sigmill.operators.dedup import keep_first, not_stored
from sigmill.schemas import natural_id


class UnknownKeyError(LookupError):
    """A keyed change names a row that does not exist."""


def insert_if_absent(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """First wins. Returns ``(rows to append, counts)`` with ``inserted`` and ``skipped``."""
    fresh = not_stored(keep_first(new, keys, order), stored, keys, offered=new)
    counts = side_by_side(
        new.agg(F.count(F.lit(1)).alias("offered")), fresh.agg(F.count(F.lit(1)).alias("inserted"))
    )
    return fresh, counts.select("inserted", (F.col("offered") - F.col("inserted")).alias("skipped"))


def get_or_create(stored: DataFrame, names: DataFrame, name_col: str) -> DataFrame:
    """``(id, name)`` for every name: the stored id, or the id its natural key gives."""
    wanted = names.select(name_col).distinct()
    known = stored.groupBy(name_col).agg(F.min("id").alias("id"))
    return wanted.join(known, name_col, "left").select(
        F.coalesce("id", natural_id(F.col(name_col))).alias("id"), name_col
    )


def upsert_last_wins(
    stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ("id",)
) -> DataFrame:
    """The latest change per key replaces the stored row; ``keep`` columns stay as stored.

    Updates and inserts are two joins rather than one full outer join: with a small batch both
    broadcast it, and the stored table is not shuffled.
    """
    rest = [c for c in changes.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_new"))
    joined = stored.join(latest, list(keys), "left")
    changed = F.col("_new").isNotNull()
    updated = joined.select(
        *[
            F.when(changed, F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c) if c in rest and c not in keep else F.col(c)
            for c in stored.columns
        ]
    )
    types = {f.name: f.dataType for f in stored.schema.fields}
    inserted = not_stored(latest, stored, keys, offered=changes).select(
        *[
            F.col(c) if c in keys else (F.col(f"_new.`{c}`") if c in rest else F.lit(None)).cast(types[c]).alias(c)
            for c in stored.columns
        ]
    )
    return updated.unionByName(inserted)


def update_keyed(
    stored: DataFrame, changes: DataFrame, key: str, strict: bool = False, order: Sequence[str] = ()
) -> DataFrame:
    """Set the columns ``changes`` carries on the rows it names; NULL is a value like any other.

    Of several changes of one key the last in ``order`` holds, or the greatest where none is given, so no
    stored row is ever repeated. Order columns that the table lacks are not set. ``strict`` makes an unknown key an error, otherwise it is
    ignored.
    """
    if strict:
        unknown = not_stored(changes, stored, [key]).select(key).take(1)
        if unknown:
            raise UnknownKeyError(f"unknown {key}: {unknown[0][0]}")
    columns = [c for c in changes.columns if c != key and (c not in order or c in stored.columns)]
    marked = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*(order or columns))).alias("_new"))
    joined = stored.join(marked, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in stored.columns
        ]
    )


def delete_keys(stored: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(remaining rows, keys with a hit flag)``."""
    remaining = stored.join(gone.select(key), key, "left_anti")
    hits = (
        gone.select(key)
        .distinct()
        .join(stored.select(key, F.lit(True).alias("deleted")).distinct(), key, "left")
        .select(key, F.coalesce("deleted", F.lit(False)).alias("deleted"))
    )
    return remaining, hits


def set_single_active(stored: DataFrame, key: str, target: str) -> DataFrame:
    """Exactly ``target`` becomes active; an unknown target changes nothing and is an error."""
    if stored.filter(F.col(key) == target).isEmpty():
        raise UnknownKeyError(f"unknown {key}: {target}")
    return stored.withColumn("is_active", F.col(key) == target)


def set_inactive(stored: DataFrame, key: str, target: str) -> DataFrame:
    """Disabling may leave no active row."""
    if stored.filter(F.col(key) == target).isEmpty():
        raise UnknownKeyError(f"unknown {key}: {target}")
    return stored.withColumn("is_active", F.col("is_active") & (F.col(key) != target))


def fill_missing(stored: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Fill NULL cells only; a second run finds nothing to do. Of several values of a key the least is used."""
    new = values.groupBy(key).agg(F.min(column).alias("_fill"))
    return stored.join(new, key, "left").select(
        *[F.coalesce(column, "_fill").alias(column) if c == column else F.col(c) for c in stored.columns]
    )


def merge_maps(left: Column, right: Column) -> Column:
    """Key-wise sum of two counter maps."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def overlay_maps(old: Column, new: Column) -> Column:
    """Key-wise replacement: the new value wins."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
