"""Byte-level BPE of whole corpora, with tree concatenation for long texts.

A text of more than ``LONG`` characters is halved again and again down to pieces, which tasks all over the
cluster encode on their own. Neighbours are then joined pairwise, up to the whole text: the last ids of one
side and the first of the other are decoded and encoded again together, in a window that doubles until its
outer ids are the same as before on both sides. From there on nothing can differ: a sequence of ids is the
encoding of its text when every adjoining pair in it is, and each pair now stands in the left side, the
window or the right side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import arrow_map, blank, steps
from sigmill.llm.tokens import Encoder, encoder

#: Characters from which a text is encoded in pieces.
LONG = 32_768
#: Ids of each side in the first window, and how many must agree at each end of a window.
WINDOW, AGREE = 16, 4


def halves(text: str, most: int = LONG) -> list[str]:
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], most) + halves(text[middle:], most)


def join(left: np.ndarray, right: np.ndarray, enc: Encoder, window: int = WINDOW) -> np.ndarray:
    """The encoding of two texts together, from the encodings of each."""

    def inside(ids: np.ndarray, at: int) -> bool:
        """Whether the id at ``at`` begins within a character."""
        return 0 < at < len(ids) and 0x80 <= enc.token_bytes[int(ids[at])][0] < 0xC0

    k = window
    while True:
        i, j = max(0, len(left) - k), min(len(right), k)
        while inside(left, i):
            i -= 1
        while inside(right, j):
            j += 1
        tail, head = left[i:], right[:j]
        new = np.array(enc.exact(enc.decode_bytes(np.concatenate([tail, head])).decode()), np.uint32)
        a, b = min(AGREE, len(tail)), min(AGREE, len(head))
        fits_left = i == 0 or np.array_equal(new[:a], tail[:a])
        fits_right = j == len(right) or np.array_equal(new[len(new) - b :], head[len(head) - b :])
        if fits_left and fits_right:
            return np.concatenate([left[:i], new, right[j:]])
        k *= 2


def join_all(parts: list[np.ndarray], enc: Encoder) -> np.ndarray:
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], enc) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode(docs: DataFrame, vocabulary: str, most: int = LONG) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit ids of each whole text, as the library gives them.

    A null or empty text has no ids. Rows that repeat a ``doc_id`` give a row each.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", blank().alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in steps(batches):
            ids, at = enc.encode(batch.column("text").to_pylist())
            raw = [_packed(ids[at[i] : at[i + 1]]) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = halves(text, most)
                n = len(parts)
                same = [pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type) for c in ("doc_id", "digest")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array(parts)], ["doc_id", "digest", "idx", "part"])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in steps(batches, "part"):
            ids, at = enc.encode(batch.column("part").to_pylist())
            raw = [_packed(ids[at[i] : at[i + 1]]) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "digest", "idx")], pa.array(raw, pa.binary())], ["doc_id", "digest", "idx", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        idx, raw = group.column("idx").to_pylist(), group.column("ids").to_pylist()
        parts = {i: np.frombuffer(r, "<u4") for i, r in zip(idx, raw, strict=True)}  # a repeated row has the same pieces
        ids, n = _packed(join_all([parts[i] for i in sorted(parts)], encoder(vocabulary))), idx.count(0)
        return pa.table({"doc_id": pa.array(group.column("doc_id").to_pylist()[:1] * n, group.schema.field("doc_id").type), "ids": pa.array([ids] * n, pa.binary())})

    short = arrow_map(rows.filter(F.char_length("text") <= most), whole, f"doc_id {kind}, ids binary")
    long_ = rows.filter(F.char_length("text") > most).select("doc_id", F.md5("text").alias("digest"), "text")
    cut_up = arrow_map(long_, split, f"doc_id {kind}, digest string, idx int, part string").repartition("digest", "idx")
    done = arrow_map(cut_up, piece, f"doc_id {kind}, digest string, idx int, ids binary")
    return short.unionByName(done.groupBy("doc_id", "digest").applyInArrow(joined, f"doc_id {kind}, ids binary"))


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded texts; the ids are decoded back here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in steps(batches, "ids"):
            raw = batch.column("ids").to_pylist()
            texts = [decode(np.frombuffer(r, "<u4"), enc) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(encoded.dtypes)["doc_id"]
    return arrow_map(encoded, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode(ids: np.ndarray, enc: Encoder) -> str:
    """The text of the ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
    return enc.decode_bytes(ids).decode(errors="replace")
