"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are cut at every ``size`` ids; whole pieces are sequences of their own. The histogram of the
other lengths, at most ``size`` numbers whatever the corpus, decides everything else: lengths are placed
longest first, each into the open packs with most room, as counts of packing patterns rather than packs.
Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.llm.common import arrow_map, blank, steps
from sigmill.llm.tokens import encoder
from sigmill.session import cut

SIZE = 1024
#: Pieces ranked in one window group, about.
RANK_GROUP = 50_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns as ``(packs, ((length, pieces of it in a pack), ...))``, in an order the histogram fixes.

    Ties between packs of equal room go to the pattern opened last. When no open pack has room, new packs
    take as many pieces of the length as fit.
    """
    room: dict[int, list[list]] = {}
    closed: list[Pattern] = []

    def put(count: int, runs: tuple[tuple[int, int], ...], left: int) -> None:
        if not count:
            return
        if left:
            room.setdefault(left, []).append([count, runs])
        else:
            closed.append((count, runs))

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        n = histogram[length]
        while n:
            most = max((r for r in room if room[r]), default=0)
            if most < length:
                each = size // length
                put(n // each, ((length, each),), size - each * length)
                if n % each:
                    put(1, ((length, n % each),), size - n % each * length)
                break
            count, runs = room[most].pop()
            took = min(count, n)
            put(count - took, runs, most)
            if runs[-1][0] == length:
                runs = (*runs[:-1], (length, runs[-1][1] + 1))
            else:
                runs = (*runs, (length, 1))
            put(took, runs, most - length)
            n -= took
    return closed + [(c, runs) for left in sorted(room) for c, runs in room[left]]


class Slots:
    """Where the pieces of each length go: by rank, to a sequence and an offset in it. Bounded by the patterns."""

    def __init__(self, patterns: list[Pattern], first: int) -> None:
        used: dict[int, int] = {}
        rows, base = [], first
        for packs, runs in patterns:
            offset = 0
            for length, each in runs:
                low = used.get(length, 0)
                rows.append(((length << 44) + low, low, base, offset, each, length))
                used[length] = low + packs * each
                offset += each * length
            base += packs
        rows.sort()
        self.sequences = base
        self.key, self.low, self.base, self.offset, self.each, self.length = np.array(rows or np.empty((0, 6)), np.int64).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        within = rank - self.low[at]
        return self.base[at] + within // self.each[at], self.offset[at] + within % self.each[at] * self.length[at]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: each document's ids and the end id, cut at every ``size``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null or empty text gives the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in steps(batches):
            ids, at = enc.encode(batch.column("text").to_pylist())
            docs_, starts, lengths, raw, totals = [], [], [], [], []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for s in range(0, len(own), size):
                    part = own[s : s + size]
                    docs_.append(doc)
                    starts.append(s)
                    lengths.append(len(part))
                    raw.append(part.tobytes())
                    totals.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, batch.schema.field("doc_id").type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary()), pa.array(totals, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", blank().alias("text")), run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")


def placed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (``doc_id, start, length, doc_tokens`` and more) with ``sequence_id`` and ``offset``.

    A rank is the pieces of that length in earlier hash groups plus the rank in the piece's own group, so
    one length may hold any share of the rows. Equal rows are told apart by their rank only. ``parts`` is read
    several times and must be a written table.
    """
    cols = parts.columns
    total = parts.count()
    groups = max(1, -(-total // RANK_GROUP))
    order = [c for c in ("doc_id", "start", "doc_tokens", "ids_crc32") if c in cols]
    grouped = parts.withColumn("group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = grouped.groupBy("length", "group").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    whole = histogram.pop(size, 0)
    slots = Slots(shortest_pack_first(histogram, size), whole)
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy(*order)) - 1
    ranked = grouped.withColumn("own", rank).join(counts.select("length", "group", "before"), ["length", "group"])
    ranked = ranked.select(*cols, (F.col("own") + F.col("before")).cast("bigint").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = at.copy(), np.zeros_like(at)
            part = length < size
            if part.any():
                sequence[part], offset[part] = slots.find(length[part], at[part])
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return arrow_map(ranked, run, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Only the pieces' measures are written and shuffled, not their ids. Rows that repeat a ``doc_id`` are
    packed each. Empty table: no rows.
    """
    parts = pieces(docs, vocabulary, end_id, size)
    measures = parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return placed(cut(measures, "pieces"), size)


def sequences(parts: DataFrame, places: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """``sequence_id, tokens, ids``: the packed sequences themselves, padded unless their length is a power of two.

    ``parts`` as ``pieces`` gives them, with distinct ``doc_id, start``; ``places`` from ``placed``. A group
    holds at most ``size`` ids.
    """
    joined = places.select("doc_id", "start", "sequence_id", "offset", "length").join(parts.select("doc_id", "start", "ids"), ["doc_id", "start"])
    rows = joined.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    gap = F.when(power, 0).otherwise(size - F.col("tokens")).cast("int")
    return rows.select("sequence_id", "tokens", F.concat(ids, F.aggregate(F.array_repeat(pad, gap), F.lit(b""), lambda a, p: F.concat(a, p))).alias("ids"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
