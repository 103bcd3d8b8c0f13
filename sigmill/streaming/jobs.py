"""Incremental forms of collect, the run ledger and source health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sigmill.functions import urls
from sigmill.functions.expr import with_once
from sigmill.operators.dedup import keep_first
from sigmill.plans.ledger import fold_partials, partial_runs
from sigmill.plans.tables import append_new


def canonical_posts(landed: DataFrame) -> DataFrame:
    """Landed posts with their canonical URL. Repeats stay: which of them is the first is decided per batch."""
    return with_once(landed, "url_canon", urls.canonical_url("url")).filter("url_canon IS NOT NULL")


def first_posts(landed: DataFrame, order: Sequence[str] = ("published_at", "url")) -> DataFrame:
    """One batch of posts, the first in ``order`` of each canonical URL."""
    return keep_first(canonical_posts(landed), ["url_canon"], order)


def collect_stream(
    landed: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ("published_at", "url"), buckets: int | None = None
) -> DataStreamWriter:
    """Continuous collect into an append table with a global unique canonical URL.

    Of a batch's repeats the first in ``order`` stays; one that is stored already stays whatever comes
    later. The stream keeps no state of its own. A replayed batch appends nothing.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        append_new(first_posts(batch, order), table, "url_canon", buckets)

    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ledger_stream(events: DataFrame) -> DataFrame:
    """Running ledger per run and stage, for ``outputMode("update")``."""
    return events.groupBy("run_id", "stage").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.sum("cost_delta").alias("cost"),
        F.count(F.lit(1)).alias("events"),
    )


def store_partials(batch: DataFrame, path: str, epoch: int) -> None:
    """One batch's additions to the ledger, under its own number: storing a batch again replaces what it stored."""
    partial_runs(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def ledger_table_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Continuous ledger as a table under ``path``, read by ``stored_ledger``.

    Each batch adds one row per run and stage that it touches and never reads what is stored, so its work
    follows the batch. A batch replayed after a failure replaces its own rows, so nothing counts twice.
    """
    return events.writeStream.foreachBatch(lambda batch, epoch: store_partials(batch, path, epoch)).option("checkpointLocation", checkpoint)


def stored_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger as of the last batch."""
    return fold_partials(spark.read.option("basePath", path).parquet(f"{path}/epoch=*"))


def windowed_health(
    rows: DataFrame, ts: str, source: str, failed: Column, width: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Counts and failures per window and source; rows later than the watermark are dropped.

    Runs unchanged on a batch frame, where the watermark has no effect.
    """
    return (
        rows.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), F.col(source).alias("source"))
        .agg(F.count(F.lit(1)).alias("total_count"), F.count_if(failed).alias("failed_count"))
        .select(F.col("w.start").alias("window_start"), "source", "total_count", "failed_count")
    )
