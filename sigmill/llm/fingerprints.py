"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the ``K`` smallest distinct shingle hashes of a text, so the sketch of a whole is the bottom
k of its parts' sketches. Two sketches estimate resemblance and containment; one estimates the number of
distinct shingles. A text of at most ``K`` shingles is sketched exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.llm import shingles
from sigmill.llm.common import arrow_map, blank, steps

U = np.uint64
K = 128
#: Bytes of text in a partition of the ordered pass, about.
PART_BYTES = 64 << 20


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Bottom k of sorted distinct hashes."""
    return hashes[:k]


def write(s: np.ndarray) -> str:
    """Sixteen hexadecimal digits per hash, ascending; an empty sketch is the empty string."""
    return s.astype(">u8").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(U)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the bottom k of the union that is in both; exact for small sets. Two empty sketches: 1, one: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = merge(a, b, k)
    return shingles.common(low, np.intersect1d(a, b, assume_unique=True)) / len(low)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that is in the second; an empty set is contained in any."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return float(min(1.0, max(0.0, resemblance(a, b, k) * union / distinct(a, k))))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; a null or empty one has the empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            h, at = shingles.shingle_sets(batch.column("text"))
            prints = [write(sketch(h[at[i] : at[i + 1]], k)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return arrow_map(docs.select("doc_id", blank().alias("text")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """``key, fingerprint``: sketches of whole groups from those of their members.

    The k smallest hashes per key are cut on the map side first, so a group of any size ships k per task.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("fingerprint"), F.lit(16)))
    hashes = prints.filter("fingerprint <> ''").select(F.col(key).alias("key"), "fingerprint", at.alias("at"))
    hashes = hashes.select("key", F.expr("substr(fingerprint, at, 16)").alias("hash")).distinct()
    low = hashes.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("hash"))).filter(F.col("rank") <= k)
    full = low.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("hash")), "").alias("fingerprint"))
    keys = prints.select(F.col(key).alias("key")).distinct()
    return keys.join(full, keys.key.eqNullSafe(full.key), "left").select(keys.key.alias(key), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def edit_probe(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint beside that of its edit and of the next document.

    The edit replaces the second half of a text with the beginning of the next one, by ascending ``doc_id``
    (equal ids by text); the last is followed by the first. ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Null text: empty. A single document follows itself.

    Texts are shuffled once, into ranges of ids. Each range also gets the first row of the next one, marked,
    so every row meets its follower while the range streams by; at most one row is held back.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", blank().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    parts = 4 * partitions  # ranges are hashed to partitions; several each even them out
    # Bounds from the ids alone: one number per range.
    ids = rows.select(F.col("doc_id").cast("bigint").alias("id")).filter("id is not null")
    bounds = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    spark = docs.sparkSession
    firsts_of = np.array([int(b) for b in bounds], np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("id").fill_null(-(2**63)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(np.searchsorted(firsts_of, x, "right").astype(np.int32))], ["doc_id", "text", "part"]
            )

    schema = f"doc_id {kind}, text string, part int"
    dealt = arrow_map(rows.select("doc_id", "text", F.col("doc_id").cast("bigint").alias("id")), number, schema)
    # The first id of each range that has rows, and the range before it; the first range's follows the last.
    lows = arrow_map(rows.select("doc_id", F.lit("").alias("text"), F.col("doc_id").cast("bigint").alias("id")), number, schema)
    found = sorted((r["part"], r["low"]) for r in lows.groupBy("part").agg(F.min("doc_id").alias("low")).collect())
    heads = [(low, found[i - 1][0]) for i, (_, low) in enumerate(found)]
    nulls = lows.filter("doc_id is null").limit(1).count() and found
    if nulls:  # a null id comes before any other and is in the first range
        heads[0] = (None, heads[0][1])
    head = spark.createDataFrame(heads, f"head {kind}, part int")
    marked = rows.join(F.broadcast(head), rows.doc_id.eqNullSafe(head["head"])).select("doc_id", "text", "part", F.lit(1).alias("mark"))
    both = dealt.withColumn("mark", F.lit(0)).unionByName(marked)
    ordered = both.repartition(partitions, "part").sortWithinPartitions("part", "mark", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        held: tuple | None = None  # part, doc_id, text, sketch of a row that waits for its follower
        for batch in steps(batches):
            id_type = batch.schema.field("doc_id").type
            h, at = shingles.shingle_sets(batch.column("text"))
            prints = [sketch(h[at[i] : at[i + 1]], k).copy() for i in range(len(batch))]
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            part, mark = batch.column("part").to_pylist(), batch.column("mark").to_pylist()
            ready = []
            for i, text in enumerate(texts):
                if held is not None and held[0] == part[i]:
                    ready.append((held[1], held[2], held[3], _edited(held[2], text), prints[i]))
                held = None if mark[i] else (part[i], names[i], text, prints[i])
            if not ready:
                continue
            eh, eat = shingles.shingle_sets(pa.array([r[3] for r in ready], pa.string()))
            own = [sketch(eh[eat[i] : eat[i + 1]], k) for i in range(len(ready))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in ready], id_type),
                    pa.array([len(r[1]) for r in ready], pa.int64()),
                    pa.array([hashlib.sha256(r[3].encode()).hexdigest() for r in ready]),
                    pa.array([write(r[2]) for r in ready]),
                    pa.array([write(e) for e in own]),
                    pa.array([resemblance(r[2], e, k) for r, e in zip(ready, own, strict=True)]),
                    pa.array([resemblance(r[2], r[4], k) for r in ready]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    out = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(ordered, run, out)
