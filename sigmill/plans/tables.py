"""Writing state: appends, and snapshots behind a view.

Tables are ordinary Spark tables in the session catalog, bucketed by their key where one is
given so that later merges on the key do not shuffle the stored side. A snapshot is a new table;
the public name is a view that is replaced once the new table is complete, so a reader sees the
old state or the new one and a failed job leaves the old one in place.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from sigmill.operators.dedup import not_stored


# Bytes of a bucket, about, where the number of buckets is not given.
BUCKET_BYTES = 256 << 20


def _buckets(df: DataFrame, wanted: int | None) -> int:
    """From the size of the plan's input as the optimizer estimates it; at least one per shuffle partition."""
    if wanted:
        return wanted
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(100_000, max(least, -(-size // BUCKET_BYTES)))


def _writer(df: DataFrame, key: str | None, buckets: int | None):
    if not key:
        return df.write.format("parquet")
    # One task per bucket writes one file; sorted buckets let later joins on the key skip the sort.
    n = _buckets(df, buckets)
    return df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)


def publish(df: DataFrame, name: str, key: str | None = None, buckets: int | None = None, keep: int = 2) -> str:
    """Write a full snapshot and point ``name`` at it. Returns the snapshot's table name.

    The newest ``keep`` snapshots stay for readers that still hold an older one; the rest are dropped.
    """
    spark = df.sparkSession
    if _is_append_table(spark, name):
        raise ValueError(f"{name} is an append table")
    snapshot = f"{name}__{time.time_ns():020d}_{uuid.uuid4().hex}"
    _writer(df, key, buckets).mode("errorifexists").saveAsTable(snapshot)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {snapshot}")
    old = sorted(r.name for r in spark.catalog.listTables(pattern=f"{name}__*") if r.tableType != "VIEW")
    for table in old[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return snapshot


def append(df: DataFrame, name: str, key: str | None = None, buckets: int | None = None) -> None:
    """Append rows to ``name``; the first append creates it and fixes its buckets."""
    spark = df.sparkSession
    if key and spark.catalog.tableExists(name):
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        buckets = int(described.get("Num Buckets", buckets or 1))
    _writer(df, key, buckets).mode("append").saveAsTable(name)


def append_new(df: DataFrame, name: str, key: str, buckets: int | None = None) -> None:
    """Append the rows whose key is not stored yet. Running it again appends nothing."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        stored = spark.table(name)
        df = not_stored(df, stored, [key]).select(*stored.columns)
    append(df, name, key, buckets)


def compact(spark: SparkSession, name: str, key: str, buckets: int | None = None) -> None:
    """Rewrite an append table with one file per bucket, its number chosen anew from the table's size.

    The new table is complete before the old one goes; no append may run meanwhile.
    """
    fresh = f"{name}__compact_{uuid.uuid4().hex}"
    _writer(spark.table(name), key, buckets).saveAsTable(fresh)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def _is_append_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW"
