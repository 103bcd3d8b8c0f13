"""Token ids in Parquet files: list columns under dictionary or delta encoding, in ascending document order.

Row groups are small and pages short, and the files carry column and offset indexes, so a reader that wants
the ids of a few documents, or only the lengths of all, touches little else. Ids of a vocabulary fit a
dictionary page; where a chunk outgrows it, the writer goes on with delta encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import arrow_map, blank, steps
from sigmill.llm.tokens import encoder

#: Writer settings of the format. Version 2 pages use delta encoding for numbers outside a dictionary.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "part int, pos bigint, doc_id {}, n_tokens bigint, ids array<int>"


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``part, pos, doc_id, n_tokens, ids`` in ascending ``doc_id`` order over the partitions.

    The order of rows that share an id is by text. ``part`` and ``pos`` number partitions and their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in steps(batches):
            ids, at = enc.encode(batch.column("text").to_pylist())
            n = len(batch)
            flat, ends = np.insert(ids, at[1:], end_id).astype(np.int32), at + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(pos, pos + n)),
                    batch.column("doc_id"),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                ],
                ["part", "pos", "doc_id", "n_tokens", "ids"],
            )
            pos += n

    rows = docs.select("doc_id", blank().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_map(ordered, run, SCHEMA.format(dict(docs.dtypes)["doc_id"]))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    encoded(docs, vocabulary, end_id).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalogue(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of written token files.

    ``start`` counts the ids of all documents before: those of earlier parts, one number per part, and
    those earlier in the part. No task sees more than one part's measures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[at[i] : at[i + 1]].tobytes()) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("pos"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "pos", "doc_id", "n_tokens", "ids_crc32"],
            )

    kind = dict(tokens.dtypes)["doc_id"]
    rows = arrow_map(tokens.select("part", "pos", "doc_id", "ids"), run, f"part int, pos bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), none).alias("before"))  # one row per part
    inside = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("part").orderBy("pos")), none)
    return (
        rows.withColumn("inside", inside)
        .join(offsets, "part")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
