"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``width`` consecutive words of one document. Every word is removed that a window covers whose word
sequence also starts earlier: in a smaller document, or earlier in the same one.

1. Every window has an anchor, the run of ``GRAM`` words in it with the smallest hash; equal windows have equal
   anchors at equal places. Anchors are counted over all documents, and for each one that recurs the first
   document that has it is its reference. Nothing else of a text can recur.
2. Reference documents are dealt into blocks of bounded size. A task indexes the anchors of a block and parses the
   documents that have one of them: from an anchor, the longest factor that agrees with the reference is taken
   word by word, and the parse goes on behind it. Factors of at least a window become duplicate spans.
3. Windows of recurring anchors that reach over a factor's boundaries can only recur outside the reference. They
   are looked up by their anchor's and their own hash among all such windows; the first one stays.

Documents meet a block only if they share an anchor with it, and a block that many documents meet is dealt to
several tasks, so a passage that a third of all documents hold makes neither pairs of documents nor one long task.
Windows are compared by 64-bit hashes of every word, or at boundaries by 128 bits.

Defined cases: a null text has no words; a text of fewer words than a window loses none. Documents are ordered by
id, nulls first; texts under the same id are ordered by digest, and rows that repeat both id and text are one
document, whose result each of them gets. An empty table gives an empty result. Only id and text are read, so
other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from sigmill.llm import shingles
from sigmill.llm.common import arrow_map, blank, steps
from sigmill.operators.ordering import order_ids
from sigmill.session import cut

WIDTH = 20
#: Words of an anchor.
GRAM = 8
#: Text for each block of references; documents that meet one copy of a block.
BLOCK_BYTES, PER_BLOCK = 16 << 20, 4096

U = np.uint64
_GRAM_STEP, _WINDOW_STEP = U(0xD6E8FEB86659FD93), U(0xCA5A826395121157)


def _runs(words: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """A hash of each ``n`` consecutive words."""
    m = max(0, len(words) - n + 1)
    run = words[:m].copy()
    for k in range(1, n):
        run = run * step + words[k : k + m]
    return shingles.mix(run)


class Words:
    """The words of some texts: where each begins and ends, its hash, and where each text's words begin."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = shingles.text_bytes(column)
        self.start, self.end = shingles.spans(shingles._INK[self.data], self.offsets)
        self.at = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        return shingles.Hashes(self.data).of(self.start, self.end)


def anchors(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows, the place of each one's anchor, and the hash of the run at every place.

    Places count from the first word of the first text; no window crosses two texts.
    """
    grams = _runs(words, GRAM, _GRAM_STEP)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    m = max(0, len(words) - width + 1)
    starts = np.flatnonzero(text[:m] == text[width - 1 :]) if m else np.empty(0, np.int64)
    if not len(starts):
        return starts, starts, grams
    view = np.lib.stride_tricks.sliding_window_view(grams, width - GRAM + 1)
    return starts, starts + view[starts].argmin(axis=1), grams


def _emit_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            w = Words(batch.column("text"))
            _, place, grams = anchors(w.hashes(), w.at, width)
            place = np.unique(place)
            if not len(place):
                continue
            row = np.searchsorted(w.at, place, "right") - 1
            h = grams[place]
            order = np.lexsort((place, h, row))
            again = np.zeros(len(place), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(row)), pa.array((place - w.at[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(again)],
                names=["doc", "place", "anchor", "again"],
            )

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries of two arrays are equal; looks no further than about twice that."""
    n, lo, size = min(len(a), len(b)), 0, 32
    while lo < n:
        differ = np.flatnonzero(a[lo : min(n, lo + size)] != b[lo : min(n, lo + size)])
        if len(differ):
            return lo + int(differ[0])
        lo, size = lo + size, 2 * size
    return n


class Block:
    """Reference documents with their anchors."""

    def __init__(self, width: int) -> None:
        self.width, self.docs = width, {}

    def add(self, docs: list[int], column: pa.Array) -> None:
        w = Words(column)
        words = w.hashes()
        _, place, grams = anchors(words, w.at, self.width)
        place = np.unique(place)
        cuts = np.searchsorted(place, w.at)
        for i, doc in enumerate(docs):
            own = place[cuts[i] : cuts[i + 1]]
            h, first = np.unique(grams[own], return_index=True)
            self.docs[doc] = (words[w.at[i] : w.at[i + 1]].copy(), h, own[first] - w.at[i])

    def parse(self, words: np.ndarray, places: np.ndarray, hashes: np.ndarray, refs: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
        """The factors found from the anchors at ``places``, whose windows begin from ``low`` to ``high``."""
        source = np.empty(len(places), np.int64)
        for ref in np.unique(refs):
            mine = refs == ref
            _, known, first = self.docs[ref]
            source[mine] = first[np.searchsorted(known, hashes[mine])]
        factors: list[tuple[int, int]] = []
        begin = end = 0
        j = 0
        while j < len(places):
            if low[j] >= begin and high[j] + self.width <= end:  # inside the last factor: on behind it
                j = max(j + 1, int(np.searchsorted(high, end - self.width, "right")))
                continue
            q, r, other = int(places[j]), int(source[j]), self.docs[refs[j]][0]
            left = _agree(words[:q][::-1], other[:r][::-1])
            right = _agree(words[q:], other[r:])
            j += 1
            if left + right >= self.width:
                begin, end = q - left, q + right
                factors.append((begin, end))
        return factors


OUT = "doc bigint, begin int, end int, anchor bigint, window bigint"


def _parse(width: int):
    """Rows sorted by (block, salt, mark): a block's references (mark 0), then the documents to parse, which stream by.

    Gives spans (``anchor`` null), and windows that are to be looked up.
    """

    def document(block: Block, doc: int, words: np.ndarray, places: np.ndarray, refs: np.ndarray, out: list) -> None:
        starts, place, grams = anchors(words, np.array([0, len(words)]), width)
        own = np.flatnonzero(np.isin(place, places))
        order = np.argsort(places, kind="stable")
        places, refs = places[order], refs[order]
        low, high = np.searchsorted(place, places), np.searchsorted(place, places, "right") - 1
        factors = block.parse(words, places, grams[places], refs, low, high)
        covered = np.zeros(len(starts), bool)
        for begin, end in factors:
            covered[begin : end - width + 1] = True
        spans = list(factors)
        rest = own[~covered[own]]
        h, v = grams[place[rest]], _runs(words, width, _WINDOW_STEP)[rest]
        by = np.lexsort((rest, v, h))
        again = np.zeros(len(rest), bool)
        again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (v[by[1:]] == v[by[:-1]])
        spans += [(int(i), int(i) + width) for i in rest[again]]
        once = ~again
        n, m = len(spans), int(once.sum())
        found = np.array(spans, np.int32).reshape(n, 2)
        none = np.zeros(n, np.int64)
        out.append((
            np.full(n + m, doc), np.concatenate([found[:, 0], rest[once].astype(np.int32)]), np.concatenate([found[:, 1], (rest[once] + width).astype(np.int32)]),
            np.concatenate([none, h[once].view(np.int64)]), np.concatenate([none, v[once].view(np.int64)]), np.concatenate([np.ones(n, bool), np.zeros(m, bool)]),
        ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(width)
        for batch in steps(batches):
            keys = list(zip(batch.column("block").to_pylist(), batch.column("salt").to_pylist(), batch.column("mark").to_pylist(), strict=True))
            lo, out = 0, []
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                part = batch.slice(lo, hi - lo)
                docs = part.column("doc").to_pylist()
                if keys[lo][:2] != key:
                    key, block = keys[lo][:2], Block(width)
                if keys[lo][2] == 0:
                    block.add(docs, part.column("text"))
                else:
                    w = Words(part.column("text"))
                    words = w.hashes()
                    places, refs = part.column("places").to_pylist(), part.column("refs").to_pylist()
                    for i, doc in enumerate(docs):
                        document(block, doc, words[w.at[i] : w.at[i + 1]], np.array(places[i]), np.array(refs[i]), out)
                lo = hi
            if out:
                doc, begin, end, h, v, span = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(begin), pa.array(end), pa.array(h, mask=span), pa.array(v, mask=span)],
                    names=["doc", "begin", "end", "anchor", "window"],
                )

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id, text, doc`` and documents as ``doc, text``; ``doc`` is a number that follows their order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), blank(F.col(text_col)).alias("text"))
    whole = isinstance(rows.schema["doc_id"].dataType, ByteType | ShortType | IntegerType | LongType)
    if whole and rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        rows = rows.withColumn("doc", F.col("doc_id").cast("bigint"))
        return rows, rows.select("doc", "text")
    marked = rows.withColumn("digest", F.sha2("text", 256))
    keys = order_ids(marked.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "doc")
    same = marked["doc_id"].eqNullSafe(keys["doc_id"]) & (marked["digest"] == keys["digest"])
    rows = cut(marked.join(keys, same).select(marked["doc_id"], "text", "doc"), "numbered")
    return rows, rows.select("doc", "text").dropDuplicates(["doc"])


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc, begin, end``: words ``begin`` to ``end`` are covered by windows that also start earlier. Spans may overlap."""
    if width < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    every = cut(arrow_map(docs, _emit_anchors(width), "doc bigint, place int, anchor bigint, again boolean"), "anchors")
    # Written down, so that the join's sides are shuffles of their own and a hot anchor can be split.
    first = cut(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("ref")).filter("n > 1").drop("n"), "first")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("ref"), F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("int")
    # All but the first place of a recurring anchor.
    hits = every.join(first, "anchor").filter("doc <> ref OR again").withColumn("block", block)
    met = cut(hits.groupBy("doc", "block").agg(F.collect_list("place").alias("places"), F.collect_list("ref").alias("refs")), "met")
    salts = cut(met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PER_BLOCK).cast("int").alias("salts")), "salts")
    parsed = met.join(salts, "block").select(
        "doc", "block", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("mark"), "places", "refs"
    )
    refs = met.select(F.explode(F.array_distinct("refs")).alias("doc"), "block").distinct().join(salts, "block").select(
        "doc", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("mark"),
        F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<bigint>").alias("refs"),
    )
    dealt = parsed.unionByName(refs).join(docs, "doc").repartition("block", "salt").sortWithinPartitions("block", "salt", "mark", "doc")
    found = cut(arrow_map(dealt, _parse(width), OUT), "factors")
    open_ = found.filter("anchor IS NOT NULL")
    one = cut(open_.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter("n > 1").drop("n"), "one")
    later = open_.join(one, ["anchor", "window"]).filter("doc > first")
    return found.filter("anchor IS NULL").select("doc", "begin", "end").unionByName(later.select("doc", "begin", "end"))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its ``spans``."""
    for batch in steps(batches):
        w = Words(batch.column("text"))
        n_words = np.diff(w.at)
        cover = np.zeros(len(w.start) + 1, np.int64)
        spans = batch.column("spans")
        row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        np.add.at(cover, w.at[row] + flat.field("begin").to_numpy(zero_copy_only=False), 1)
        np.add.at(cover, w.at[row] + flat.field("end").to_numpy(zero_copy_only=False), -1)
        kept = np.flatnonzero(np.cumsum(cover)[: len(w.start)] == 0)
        at = np.searchsorted(kept, w.at)
        # A kept word and the byte behind it, which becomes a space; none behind a text's last word.
        stop = w.end[kept] + 1
        last = at[1:][at[1:] > at[:-1]] - 1
        stop[last] -= 1
        edge = np.zeros(len(w.data) + 2, np.int32)
        edge[w.start[kept]] += 1
        np.add.at(edge, stop, -1)
        chosen = np.cumsum(edge)[: len(w.data)] > 0
        text = np.where(shingles._INK[w.data], w.data, 0x20).astype(np.uint8)[chosen].tobytes()
        size = np.zeros(len(kept) + 1, np.int64)
        np.cumsum(stop - w.start[kept], out=size[1:])
        texts = [text[size[a] : size[b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words.astype(np.int64)),
                pa.array((n_words - np.diff(at)).astype(np.int64)),
                pa.array([t.decode() for t in texts]),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            ],
            names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of every row; ``kept`` are its kept words joined by a space."""
    rows, each = numbered(docs, id_col, text_col)
    spans = repeated_spans(each, width).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return arrow_map(joined, _rest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
