"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable, so it is evaluated once.

    A column used in many places is copied into each of them when the optimizer moves a filter
    below the projection that defines it. A bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters do not evaluate a second time.

    The optimizer moves a filter below a projection by copying the expression into it. It does not
    move one below a generator that makes the column, here of exactly one row. (The outer form,
    since a plain ``explode`` infers such a filter by itself.)
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def lookup(table: Mapping[str, object]) -> Column:
    """A constant map from strings to strings, as one expression rather than two per entry."""
    text = "\u0001".join(f"{key}\u0002{value}" for key, value in table.items())
    return F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))
