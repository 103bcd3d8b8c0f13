"""Text to vector: a pluggable encoder over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Task prefixes and encoder batch size.
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
BATCH_SIZE = 32
# An encoder's batch ends early at this many characters, so that its memory doesn't follow the length of texts.
BATCH_CHARS = 1 << 17
# Rows of an Arrow batch that are Python objects at once.
_ROWS = 128

Encoder = Callable[[list[str]], np.ndarray]


def _units(vectors: np.ndarray) -> np.ndarray:
    matrix = np.array(vectors, dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=matrix, where=length > 0).astype(np.float32)


def _encoded(encode: Encoder, texts: list[str], batch_size: int) -> np.ndarray:
    parts, start, chars = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and (i - start == batch_size or chars + len(text) > BATCH_CHARS):
            parts.append(_units(encode(texts[start:i])))
            start, chars = i, 0
        chars += len(text)
    return np.concatenate([*parts, _units(encode(texts[start:]))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def encode_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make_encoder: Callable[[], Encoder],
    prefix: str = PASSAGE_PREFIX,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``(id, embedding)`` with unit-length vectors.

    ``make_encoder`` runs once per task, so a model loads there and is never shipped per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in _slices(batches):
            vectors = _encoded(encode, [prefix + t for t in batch.column("text").to_pylist()], batch_size)
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["id", "embedding"]
            )

    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, embedding array<float>").withColumnRenamed("id", id_col)


def backfill_embeddings(pains: DataFrame, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Encode only the rows without a vector; the others pass untouched, so a rerun does nothing.

    One pass over the rows, no join. A row without a body keeps no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in _slices(batches):
            at = batch.schema.get_field_index("embedding")
            have, bodies = batch.column(at).to_pylist(), batch.column("body").to_pylist()
            open_ = [i for i, v in enumerate(have) if v is None and bodies[i] is not None]
            if open_:
                for i, v in zip(open_, _encoded(encode, [PASSAGE_PREFIX + bodies[i] for i in open_], BATCH_SIZE), strict=True):
                    have[i] = v
            yield batch.set_column(at, "embedding", pa.array(have, batch.schema.field(at).type)) if open_ else batch

    return pains.mapInArrow(run, pains.schema)
