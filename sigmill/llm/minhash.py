"""Near-duplicate groups by min-max hashing, banding and confirmation on full shingle sets.

Each of ``PERMUTATIONS`` hash functions gives two signature values of a set, its smallest and its largest
hash, so a signature of 128 values costs 64 evaluations per shingle. Bands of four values make candidate
buckets; a pair at similarity 0.75 misses all 32 bands with probability 5e-6, at 0.8 with 5e-8.

Every candidate that could join two groups is compared on full sets, but pairs within a group are not
spelled out: equal sets are one node; each node is first compared with one centre of its buckets; only
buckets that then still hold several groups are searched again, between their groups, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm import shingles
from sigmill.llm.common import arrow_map, blank, same_rows, steps
from sigmill.llm.components import components
from sigmill.session import cut

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket compared with each other at once; larger buckets are dealt over pairs of blocks.
BLOCK = 512
#: Members compared with one copy of their centre's set in a task.
PER_CENTRE = 512

_U = np.uint64
MULTIPLIERS = np.random.default_rng(20240229).integers(0, 2**63, PERMUTATIONS, dtype=_U) * _U(2) + _U(1)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of minima, then maxima, under each permutation, for each (non-empty) set."""
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), dtype=_U)
    start = 0
    while start < len(out):  # blocks of about 32k shingles stay in the cache
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + 32_768, "right")) - 1)
        block, at = h[offsets[start] : offsets[end]], offsets[start:end] - offsets[start]
        for k, a in enumerate(MULTIPLIERS):
            x = block * a
            out[start:end, k] = np.minimum.reduceat(x, at)
            out[start:end, PERMUTATIONS + k] = np.maximum.reduceat(x, at)
        start = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), dtype=_U)
    for b in range(BANDS):
        x = np.full(len(sig), _U(b))
        for k in range(ROWS):
            x = shingles.mix(x ^ sig[:, b * ROWS + k]) + _U(k)
        keys[:, b] = x
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        h, at = shingles.shingle_sets(batch.column("text"))
        n = np.diff(at)
        full = np.flatnonzero(n)
        sig = signatures(h, np.append(at[:-1][full], at[-1])) if len(full) else np.empty((0, 2 * PERMUTATIONS), _U)
        keys = band_keys(sig).view(np.int64)
        small = ((sig >> _U(16)) & _U(255)).astype(np.uint8)
        sets, bands, marks = [None] * len(n), [None] * len(n), [None] * len(n)
        for j, i in enumerate(full):
            sets[i], bands[i], marks[i] = shingles.set_digest(h[at[i] : at[i + 1]]), keys[j], small[j].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(sets, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(marks, pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_id", "bands", "marks"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, bands, marks``; the last three are null for an empty set."""
    schema = "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>, marks binary"
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), blank().alias("text")), _sign, schema)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, b), the centre's own row (b null) first: the pairs that are linked."""
    held, centres = None, []
    for batch in steps(batches):
        h, at = shingles.shingle_sets(batch.column("text"))
        a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
        found = []
        for i in range(len(a)):
            if (a[i], part[i]) != held:
                held, centres = (a[i], part[i]), []
            own = h[at[i] : at[i + 1]]
            if b[i] is None:
                centres.append(own.copy())
            else:
                for c in centres:
                    both = shingles.common(c, own)
                    if both and 100 * both >= 75 * (len(c) + len(own) - both):
                        found.append((a[i], b[i]))
                        break
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` linked on their full sets. ``texts``: ``node, text``.

    Members meet their centre in parts of bounded size, each with its own copy of the centre's text, and
    stream past it; so neither a hub's members nor its copies gather in one task.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_CENTRE).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    centres = parts.join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text"
    )
    both = centres.unionByName(members)
    return arrow_map(both.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")), _confirm, "a bigint, b bigint")


def _candidates(rows: dict[str, np.ndarray], left: int, right: int, key: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member, the later ones of other groups it may link with, and on how many values they agree.

    A pair that shares several buckets belongs to the one of its first common band.
    """
    comp, n, marks, bands, block = (rows[c] for c in ("comp", "n", "marks", "bands", "block"))
    inner = left == right
    mine = np.arange(len(n)) if inner else np.flatnonzero(block == left)
    theirs = mine if inner else np.flatnonzero(block == right)
    for k, i in enumerate(mine):
        other = theirs[k + 1 :] if inner else theirs
        other = other[(comp[other] != comp[i]) & (4 * np.minimum(n[other], n[i]) >= 3 * np.maximum(n[other], n[i]))]
        if not len(other):
            continue
        agree = np.count_nonzero(marks[other] == marks[i], axis=1)
        first = np.argmax(bands[other] == bands[i], axis=1)
        own = bands[i][first] == key
        if own.any():
            yield i, other[own], agree[own]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """The rows of each (key, left, right), which come sorted by them."""
    rest = None
    for batch in _with_end(batches):
        whole = rest if batch is None else pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if whole is None or not len(whole):
            continue
        whole = whole.combine_chunks()
        key, left, right = (whole.column(c).to_numpy() for c in ("key", "left", "right"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1
        if batch is None:
            ends = np.append(ends, len(key))
        rest = whole.slice(ends[-1]) if len(ends) else whole
        rows = {c: whole.column(c).to_numpy() for c in ("node", "comp", "n", "block")}
        rows["marks"] = np.frombuffer(b"".join(whole.column("marks").to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
        rows["bands"] = whole.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        start = 0
        for end in ends:
            yield whole.slice(start, end - start), {c: v[start:end] for c, v in rows.items()}
            start = end


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in some candidate pair of their block."""
    for table, rows in _blocks(batches):
        used = np.zeros(len(table), dtype=bool)
        for i, other, _ in _candidates(rows, *(table.column(c)[0].as_py() for c in ("left", "right", "key"))):
            used[i] = used[other] = True
        if used.any():
            yield from table.filter(pa.array(used)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the groups of each block, found on full sets; one link per two groups is enough."""
    for table, rows in _blocks(batches):
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        sets, found = None, []
        node, comp = rows["node"], rows["comp"]
        for i, other, agree in _candidates(rows, *(table.column(c)[0].as_py() for c in ("left", "right", "key"))):
            if sets is None:
                h, at = shingles.shingle_sets(table.column("text").combine_chunks())
                sets = [h[at[j] : at[j + 1]] for j in range(len(table))]
            for j in other[np.argsort(-agree, kind="stable")]:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b:
                    both = shingles.common(sets[i], sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        up[max(a, b)] = min(a, b)
                        found.append((int(node[i]), int(node[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _in_groups(rows: DataFrame, comp: DataFrame) -> DataFrame:
    named = comp.select("node", F.col("component").alias("found"))
    return rows.join(named, "node", "left").select(*rows.columns, F.coalesce("found", "node").alias("comp"))


def _searched(buckets: DataFrame, nodes: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """The links ``a, b`` between different groups of a bucket, for every bucket that holds several groups.

    Members meet in blocks of bounded size. Signatures go first; texts follow for members of candidate pairs
    only. Pairs are formed within a task and only links leave it.
    """
    grouped = _in_groups(buckets, comp)
    open_ = (
        grouped.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        .filter("low < high")
        .select("key", "blocks")
    )
    rows = (
        grouped.join(open_, "key")
        .join(nodes.select("node", "n", "bands", "marks"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "comp", "n", "bands", "marks"
        )
    )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "node")

    schema = "key bigint, left int, right int, block int, node bigint, comp bigint, n bigint, bands array<bigint>, marks binary"
    wanted = cut(arrow_map(dealt(rows), _wanted, schema), "wanted")
    return arrow_map(dealt(wanted.join(texts, "node").select(*wanted.columns, "text")), _linked, "a bigint, b bigint")


def _stars(buckets: DataFrame, scramble: int) -> DataFrame:
    """Each node with one centre: the least, in a scrambled order, of the centres of its buckets."""
    mask = F.lit(scramble)
    order = F.col("node").bitwiseXOR(mask)
    centres = buckets.groupBy("key").agg(F.min(order).alias("centre"))
    one = buckets.join(centres, "key").groupBy("node").agg(F.min("centre").bitwiseXOR(mask).alias("centre"))
    return one.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents link when their shingle sets share at least 75 of 100 parts of their union. The component id
    is the smallest doc_id reachable. An empty set links with nothing. Rows that repeat a ``doc_id`` are one
    vertex, whatever their texts; each gives a row. A null id sorts first. Empty table: no rows.
    """
    first = F.lit(-(2**63))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), first).alias("doc_id"), "text")
    marked = cut(signed(ids), "signatures")
    sets = marked.filter("set_id is not null")
    nodes = cut(
        sets.groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")
        ),
        "nodes",
    )
    placed = marked.join(nodes.select("set_id", "node"), "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    buckets = cut(keyed.join(shared, "key"), "buckets")

    same_id = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("a", "b")
    wanted = buckets.select("node").distinct()
    texts = ids.select(F.col("doc_id").alias("node"), blank().alias("text")).join(wanted, "node", "left_semi")

    pairs = cut(_stars(buckets, 0).unionByName(_stars(buckets, 0x5DEECE66D)).distinct(), "pairs")
    links = cut(confirmed(pairs, texts).unionByName(same_id), "links")
    comp = components(links)
    comp = components(links.unionByName(cut(_searched(buckets, nodes, comp, texts), "links")))

    def shown(c: str) -> Column:
        return F.nullif(F.col(c), first)

    named = comp.select("node", "component")
    return placed.join(named, "node", "left").select(
        shown("doc_id").alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component", "node"), first).alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "node")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row per group of near-duplicates, all columns kept; of repeated whole rows, one."""
    found = cut(near_groups(docs), "near")
    key = {"doc_id": F.col("doc_id").cast("bigint"), "digest": F.md5(blank())}
    own = docs.select(*[c.alias(k) for k, c in key.items()])
    repeated = own.groupBy(*key).count().filter("count > 1").select(*key)
    return same_rows(docs, found.filter("not kept").select("doc_id").distinct(), repeated, key)
