"""Vector expressions over ``array<float>`` columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.cast("array<double>")


def norm(vector: Column | str) -> Column:
    total = F.aggregate(_double(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(total)


def unit(vector: Column | str) -> Column:
    """Scaled to length one; a zero vector is returned as it is."""
    length = norm(vector)
    return F.when(length == 0, _double(vector)).otherwise(F.transform(_double(vector), lambda x: x / length))


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(_double(left), _double(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def from_literal(text: Column | str) -> Column:
    """``[a,b,...]`` text as a vector."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    parts = F.filter(F.split(inner, ","), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.trim(p).cast("float"))


def to_literal(vector: Column | str) -> Column:
    """A vector as ``[a,b,...]`` text with six significant digits."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(
        F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6g", x.cast("double"))), ","), F.lit("]")
    )
