"""Centroid clustering of integer vectors by scalar lookup tables.

A component has few different values, so a round does no arithmetic on vectors: for every dimension it
tabulates the squared difference of each integer that occurs there to each centroid, and a distance is a
sum of gathers from these tables. A task holds ``BLOCK`` vectors and their tables at a time.

Every round is one pass: tasks add up counts and components per centroid, the sums of all tasks are added
by Spark, and the driver sees one row per centroid and dimension. All sums are integers, so results don't
depend on how rows are dealt.

Defined cases: a vector takes part if it has exactly ``dims`` components, none null or non-finite; a null
vector doesn't. Integers beyond 2**27 in size count as 2**27. Repeated rows are vectors of their own. A
null id takes part, but is chosen as a first centroid only after all others. With fewer vectors than
centroids there are fewer centroids; an empty table gives an empty result. A sum of distances beyond a
long is null. Only the id and the vector are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm import vectors
from sigmill.session import cut

CENTROIDS, ROUNDS, DIMS, FACTOR, SEED = 8, 10, 64, 1024, 3
#: Vectors whose values are tabulated together.
BLOCK = 16_384


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``BLOCK`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point (the smaller of equals) and its squared distance."""
    distance = np.zeros((len(points), len(centroids)), np.int64)
    for d in range(points.shape[1]):
        values, code = np.unique(points[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        distance += table[code]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in blocks(batches):
            points = vectors.matrix(batch.column("vector"), dims)
            best, _ = nearest(points, centroids)
            count += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += points[best == c].sum(axis=0)
        if count.any():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(k, dtype=np.int32), dims)),
                    pa.array(np.tile(np.arange(dims, dtype=np.int32), k)),
                    pa.array(np.repeat(count, dims)),
                    pa.array(total.ravel()),
                ],
                names=["cluster", "dim", "n", "total"],
            )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            best, distance = nearest(vectors.matrix(batch.column("vector"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their points; one without points stays."""
    sums = points.select("vector").mapInArrow(_sums(centroids), "cluster int, dim int, n bigint, total bigint")
    total = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for row in total.collect():  # centroids x dimensions
        if row["n"]:
            out[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return out


def cluster(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    factor: int = FACTOR,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part.

    The first centroids are the ``k`` vectors whose ``sha256(seed:id)`` is smallest.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    used = rows.filter(vectors.finite(vector) & (F.size(vector) == dims))
    points = cut(used.select(F.col(id_col).alias("vec_id"), vectors.scaled(vector, factor).alias("vector")), "points")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(mark.asc_nulls_last(), "vector").limit(k).collect()
    schema = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"
    if not first:
        none = spark.createDataFrame([], schema)
        return none.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["vector"] for r in first], np.int64)
    for _ in range(rounds):
        last, centroids = centroids, moved(points, centroids)
        if np.array_equal(last, centroids):  # every later round would give the same
            break
    final = cut(points.mapInArrow(_assign(centroids), schema), "assigned")
    inertia = dict(final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect())

    def long(n: int):
        return F.lit(n if n < 1 << 63 else None).cast("bigint")

    each = F.array(*[long(int(inertia.get(c, 0))) for c in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    return final.select(
        "*",
        F.get(each, F.col("cluster")).alias("cluster_inertia"),
        long(int(sum(inertia.values()))).alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
