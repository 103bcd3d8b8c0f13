"""Shared pieces of the corpus operators.

Conventions of every operator here: a null text counts as empty; a null ``doc_id`` is an ordinary id
that sorts first; columns other than the ones an operator names are never read, so their names can't
clash; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.session import configure, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one step of a Python worker handles at once.
STEP_BYTES = 1_000_000
#: What goes to a Python worker at once: whole texts, so rows alone are no bound.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    ship(spark, "sigmill")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blank(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each are about ``most`` bytes; a longer text stays whole, alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if at > start and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def same_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``dropped`` (all or some of the keys); of the rows whose keys are in ``repeated``, one.

    Rows keep all their columns, whatever their names. ``repeated`` is empty unless whole rows recur, and
    only then are its rows brought together.
    """
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])

    def match(other: DataFrame):
        cond = F.lit(True)
        for k in other.columns:
            cond = cond & rows[k].eqNullSafe(other[k])
        return cond

    kept = rows.join(dropped, match(dropped), "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = rows.join(repeated, match(repeated), "left_semi").dropDuplicates(list(keys))
    rest = kept.join(repeated, match(repeated), "left_anti")
    return rest.unionByName(once.join(dropped, match(dropped), "left_anti")).select("row.*")
