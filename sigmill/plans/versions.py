"""Append-only versioned texts (prompts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.dedup import keep_one, not_stored
from sigmill.operators.merge import UnknownKeyError
from sigmill.operators.ordering import with_rank_in_group
from sigmill.schemas import natural_id


def active_versions(versions: DataFrame) -> DataFrame:
    """The row with the highest version per name: numbers are aggregated, the bodies of other versions never move."""
    best = versions.groupBy(F.col("name").alias("_name")).agg(F.max("version").alias("_version"))
    return versions.join(best, (F.col("name") == F.col("_name")) & (F.col("version") == F.col("_version")), "left_semi")


def names(versions: DataFrame) -> DataFrame:
    return versions.select("name").distinct().orderBy("name")


def versions_of(versions: DataFrame, name: str) -> DataFrame:
    return versions.filter(F.col("name") == name).orderBy("version")


def version(versions: DataFrame, name: str, number: int) -> DataFrame:
    return versions.filter((F.col("name") == name) & (F.col("version") == number))


def next_versions(versions: DataFrame, bodies: DataFrame, order: Sequence[str], now: Column, source: str = "ui") -> DataFrame:
    """Rows to append for new ``(name, body, *order)``: versions continue from the highest stored.

    Several new bodies of one name are numbered in ``order``, which must tell them apart.
    """
    top = versions.groupBy("name").agg(F.max("version").alias("_top"))
    # Ranks are worked out on the order columns alone; the bodies are joined to them once.
    keys = ["name", *[c for c in order if c != "body"]]
    ranks = with_rank_in_group(bodies.select(*keys, *(["body"] if "body" in order else [])), "name", order)
    numbered = ranks if "body" in order else bodies.join(ranks, keys)
    number = (F.coalesce("_top", F.lit(0)) + F.col("rank")).cast("int")
    return numbered.join(top, "name", "left").select(
        natural_id(F.col("name"), number).alias("id"),
        "name",
        number.alias("version"),
        "body",
        F.lit(source).alias("source"),
        now.alias("created_at"),
    )


def rollback(versions: DataFrame, name: str, number: int, now: Column) -> DataFrame:
    """Row to append: the old body under the next version. History is never rewritten."""
    target = version(versions, name, number)
    if target.isEmpty():
        raise UnknownKeyError(f"{name} has no version {number}")
    return next_versions(versions, target.select("name", "body"), ["body"], now)


def register(versions: DataFrame, shipped: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Rows to append for shipped ``(name, version, body, ...)``; a stored body never changes.

    A version shipped twice is one row, the first in ``order`` (by its other columns where no order is given).
    """
    keys = ["name", "version"]
    return not_stored(keep_one(shipped, keys, order), versions, keys, offered=shipped)


def seed(versions: DataFrame, shipped: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Like ``register``, but a name with any version at all is left alone."""
    once = keep_one(shipped, ["name", "version"], order)
    return not_stored(once, versions, ["name"], offered=shipped).select(*shipped.columns)


def _rising(places: Column) -> Column:
    """Length of the longest rising run within ``places``: the least end of a run of every length, kept up to date."""

    def onward(tails: Column, x: Column) -> Column:
        before = F.filter(tails, lambda t: t < x)
        after = F.slice(tails, F.size(before) + 2, F.greatest(F.size(tails) - F.size(before) - 1, F.lit(0)))
        return F.concat(before, F.array(x), after)

    return F.size(F.aggregate(places, F.array().cast("array<int>"), onward))


# Bytes of bodies that one task compares, about.
DELTA_BYTES = 8 << 20


def line_delta(versions: DataFrame) -> DataFrame:
    """``name, version, previous_version, added, dropped, moved``: how each version differs from the one before it.

    ``added`` and ``dropped`` hold a line as many times as the version has it more often, or less often, in
    the order of the lines themselves. ``moved`` counts lines that are once in both but not in the longest
    run of such lines that stands in the same order in both. Versions of a name are consecutive, so the one
    before is found by its number. Lines are counted by hash aggregates; bodies meet once, by their key, in as
    many tasks as their bytes need.
    """
    size = versions.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    tasks = max(int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // DELTA_BYTES + 1)
    versions = versions.select("name", "version", "body")
    before = versions.select(
        "name", F.col("version").alias("previous_version"), (F.col("version") + 1).alias("version"), F.col("body").alias("previous_body")
    )
    keys = ["name", "version"]
    paired = versions.repartition(tasks, *keys).join(before.repartition(tasks, *keys), keys).select(
        "name", "version", "previous_version", F.split("body", "\n").alias("new"), F.split("previous_body", "\n").alias("old")
    )

    def lines(column: str, sign: int) -> DataFrame:
        each = paired.select("name", "version", F.posexplode(column).alias("at", "line"))
        return each.select("name", "version", "line", F.lit(sign).alias("sign"), "at")

    new, old = F.col("sign") > 0, F.col("sign") < 0
    counted = lines("new", 1).unionByName(lines("old", -1)).groupBy("name", "version", "line").agg(
        F.sum("sign").cast("int").alias("more"), F.count_if(new).alias("n"), F.count_if(old).alias("o"),
        F.min(F.when(new, F.col("at"))).alias("new_at"), F.min(F.when(old, F.col("at"))).alias("old_at"),
    )
    changed = F.col("more") != 0
    once = (F.col("n") == 1) & (F.col("o") == 1)
    per_version = counted.groupBy("name", "version").agg(
        F.sort_array(F.collect_list(F.when(changed, F.struct("line", "more")))).alias("changed"),
        F.sort_array(F.collect_list(F.when(once, F.struct("new_at", "old_at")))).alias("kept"),
    )

    def times(sign: int) -> Column:
        wanted = F.filter("changed", lambda c: c["more"] * sign > 0)
        return F.flatten(F.transform(wanted, lambda c: F.array_repeat(c["line"], F.abs(c["more"]))))

    return per_version.select(
        "name", "version", (F.col("version") - 1).cast("int").alias("previous_version"), times(1).alias("added"), times(-1).alias("dropped"),
        (F.size("kept") - _rising(F.transform("kept", lambda k: k["old_at"]))).cast("bigint").alias("moved"),
    )
