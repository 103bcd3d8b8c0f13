"""Integer vectors from columns of floating numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this size count as this size: 64 squared differences then still fit a long.
BOUND = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither a null nor a non-finite component."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component ``x``, taken as a double."""
    bound = F.lit(BOUND).cast("bigint")
    whole = F.transform(vector, lambda x: F.greatest(-bound, F.least(bound, F.floor(x.cast("double") * F.lit(float(factor))))))
    return whole.cast("array<int>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` integers; a shorter list is filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < size[:, None]] = flat
    return out
