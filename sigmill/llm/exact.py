"""Exact deduplication by 128-bit content hash, with byte comparison inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import ascii_lower, blank, same_rows
from sigmill.session import cut


def _keys(docs: DataFrame) -> DataFrame:
    text = ascii_lower(blank())
    return docs.select("doc_id", text.alias("norm")).select(
        "doc_id", "norm", F.unhex(F.md5("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256")
    )


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The row with the largest
    ``doc_id`` stays (``keep="min"``: the smallest). The rows are aggregated on hash *and* text, so groups
    are compared byte by byte, and copies collapse before the shuffle however many there are. Rows then
    find their group by its digests alone; should two different texts ever share them, the job fails
    instead of merging them.

    Rows that repeat a ``doc_id`` with an equal text each give a row, are all ``kept`` if that id is kept,
    and all count in ``group_size``. A null id is smaller than any other. Empty table: no rows.
    """
    rows = _keys(docs)
    chosen = F.max("doc_id") if keep == "max" else F.min("doc_id")
    texts = rows.groupBy("hash", "norm", "text_sha256").agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = (
        texts.groupBy("hash", "text_sha256")
        .agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .select(
            "hash",
            "text_sha256",
            "keep_id",
            F.when(F.col("texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("different texts share both digests")).cast("bigint"))
            .alias("group_size"),
        )
    )
    return rows.drop("norm").join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row per group of equal texts, all columns kept."""
    found = cut(exact_groups(docs), "exact")
    key = ["doc_id", "text_sha256"]
    repeated = found.filter("kept").groupBy(key).count().filter("count > 1").select(key)
    return same_rows(
        docs,
        found.filter("not kept").select(key).distinct(),
        repeated,
        {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(ascii_lower(blank()), 256)},
    )
