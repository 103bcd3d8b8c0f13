"""Exact leader clustering: points in order join the nearest earlier leader or become one.

The sequential rule: going through the points in order, a point joins the most similar cluster
leader so far if that similarity reaches the threshold (the latest leader wins a tie), otherwise
it becomes a leader itself. A leader's vector never moves.

The parallel form keeps the rule exact. A metric index says who can meet whom: every point belongs to
the cell of its nearest pivot, and angles obey the triangle inequality, so a point whose angle to some
pivot differs from all of a cell's by more than the threshold's angle can't reach anything in that cell.
A cell is dealt into tiles of bounded size; a point visits the tiles it can reach and no others.

Leaders are found by all tiles at once. A point is open while an earlier point that could reach it is open.

1. Open points visit the other tiles; those that reach an earlier open point there are held back.
2. Every tile applies the rule in order to its own points. One that depends on a point held back is held
   back too; all others are decided for good.
3. What is left visits the new leaders, and who reaches an earlier one is covered.

A round is a fixed number of jobs. The first open point is decided in every round, and so is everything
that doesn't depend on another tile, so the number of rounds is the number of times the longest chain of
dependent points changes its tile: none at all where there is one tile or where nothing reaches anything.
Equal vectors are one point until the end, so a group of copies costs nothing. Finally every point visits
the leaders once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.operators.ordering import order_ids
from sigmill.session import cut, discard

DEFAULT_THRESHOLD = 0.88

# Size bounds of what one task holds of a cell.
TILE_BYTES = 64 << 20
MAX_TILE_ROWS = 32768
# Pivots and so cells, at most: the index on the driver is a square of this.
MAX_PIVOTS = 64

# Similarities closer than this are one value: matrix products of different shapes may differ in
# the last bits, and all phases must agree on who reaches the threshold.
EPSILON = 5e-13
# What rounding may add to an angle.
SLACK = 1e-6

_ROWS = 1024
_COLS = 1024
# Visits that routing works out at once, and rows that it gives out at once.
_VISITS = 1 << 18
_ROUTED = 8192


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix of unit rows in double; zero rows stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    if flat.size % n or len(set(column.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("all vectors must have the same length")
    matrix = flat.reshape(n, flat.size // n)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, norms, out=matrix, where=norms > 0)  # the cast above is a copy


def _reached(points: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which points reach the threshold with any of the others; tiles bound the memory."""
    hit = np.zeros(len(points), dtype=bool)
    for start in range(0, len(others), _COLS):
        open_rows = np.flatnonzero(~hit)
        tile = others[start : start + _COLS]
        for lo in range(0, len(open_rows), _ROWS):
            rows = open_rows[lo : lo + _ROWS]
            hit[rows] = (points[rows] @ tile.T).max(axis=1) >= threshold - EPSILON
    return hit


HELD, LEADER, COVERED = 0, 1, 2


def _decide(vectors: np.ndarray, held: np.ndarray, threshold: float, strip_rows: int = 512) -> np.ndarray:
    """The rule over one ordered tile: what each point is, given which ones depend on other tiles."""
    what = np.full(len(vectors), COVERED, dtype=np.int8)
    for start in range(0, len(vectors), strip_rows):
        rows = vectors[start : start + strip_rows]
        before = what[:start]
        covered = _reached(rows, vectors[:start][before == LEADER], threshold)
        doubtful = held[start : start + strip_rows] | _reached(rows, vectors[:start][before == HELD], threshold)
        inside = rows @ rows.T >= threshold - EPSILON
        for i in np.flatnonzero(~covered):
            if covered[i]:
                continue
            if doubtful[i]:
                what[start + i] = HELD
                doubtful[i + 1 :] |= inside[i, i + 1 :]
            else:
                what[start + i] = LEADER
                covered[i + 1 :] |= inside[i, i + 1 :]
    return what


class Index(NamedTuple):
    """Pivots, the angles to each pivot that occur in each cell, and how many tiles each cell has."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tiles: np.ndarray

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Each point's own cell; -1 for a zero vector, which nothing reaches."""
        own = (units @ self.pivots.T).argmax(axis=1)
        return np.where(np.any(units, axis=1), own, -1)

    def reachable(self, units: np.ndarray, threshold: float) -> np.ndarray:
        """Points x cells: whether a point may reach the threshold with something in the cell."""
        alpha = np.arccos(np.clip(threshold - 2 * EPSILON, -1.0, 1.0)) + SLACK
        angles = self.angles(units)
        out = np.repeat(np.any(units, axis=1)[:, None], len(self.pivots), axis=1)
        for p in range(len(self.pivots)):
            out &= (angles[:, p, None] >= self.low[None, :, p] - alpha) & (angles[:, p, None] <= self.high[None, :, p] + alpha)
        return out


def tile_rows_of(dim: int) -> int:
    return max(1, min(MAX_TILE_ROWS, TILE_BYTES // (8 * max(dim, 1))))


def _tile(seqs: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    """Which of its cell's tiles a point belongs to: spread by a multiplicative hash of its number."""
    mixed = seqs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % tiles.astype(np.uint64)).astype(np.int32)


def _located(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cells(_unit_rows(batch.column("vector"))) if batch.num_rows else np.empty(0, np.int64)
            tile = _tile(batch.column("seq").to_numpy(), index.tiles[cell])
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(tile)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "tile"])

    return run


def located(points: DataFrame, index: Index) -> DataFrame:
    """``points`` (``seq, vector`` and more) with their ``cell`` and ``tile``."""
    names = [c for c in points.columns if c not in ("cell", "tile")]
    base = points.select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(_located(index), f"{schema}, cell int, tile int")


def _spread(pivots: np.ndarray):
    """Smallest and largest angle to each pivot, and number of points, per cell of this task."""
    blank = Index(pivots, np.empty(0), np.empty(0), np.empty(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots)
        low, high, count = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                units = _unit_rows(batch.column("vector"))
                cells, angles = blank.cells(units), blank.angles(units)
                for c in np.unique(cells[cells >= 0]):
                    own = angles[cells == c]
                    low[c], high[c] = np.minimum(low[c], own.min(axis=0)), np.maximum(high[c], own.max(axis=0))
                    count[c] += len(own)
        c, p = np.divmod(np.arange(k * k), k)
        some = count[c] > 0
        arrays = [c[some].astype(np.int32), p[some].astype(np.int32), low[c, p][some], high[c, p][some], count[c][some]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["c", "p", "low", "high", "n"])

    return run


def build_index(points: DataFrame, tile_rows: int | None = None) -> Index | None:
    """The index over ``points`` (``seq, vector``); None if there are no points.

    As many pivots as the points fill tiles, ``MAX_PIVOTS`` at most: the points with the smallest hash.
    """
    size = F.size("vector")
    n, dim, least = points.agg(F.count(F.lit(1)), F.max(size), F.min(size)).first()
    if not n:
        return None
    if dim != least:
        raise ValueError("all vectors must have the same length")
    rows = tile_rows or tile_rows_of(dim)
    k = min(MAX_PIVOTS, -(-n // rows))
    if k == 1:  # one tile: nothing to route
        return Index(np.eye(1, dim), np.zeros((1, 1)), np.full((1, 1), np.pi), np.ones(1, np.int64))
    picked = points.select("seq", "vector").orderBy(F.xxhash64("seq"), "seq").limit(k).collect()
    units = _unit_rows(pa.array([r["vector"] for r in picked], pa.list_(pa.float64())))
    pivots = units[np.any(units, axis=1)]
    if not len(pivots):
        pivots = np.eye(1, dim)
    k = len(pivots)
    spread = points.select("vector").mapInArrow(_spread(pivots), "c int, p int, low double, high double, n bigint")
    low, high, count = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
    for r in spread.groupBy("c", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low[r["c"], r["p"]], high[r["c"], r["p"]], count[r["c"]] = r["low"], r["high"], r["n"]
    return Index(pivots, low, high, np.maximum(1, -(-count // rows)))


def _improve(
    points: np.ndarray, at: np.ndarray, leaders: np.ndarray, leader_at: np.ndarray, threshold: float, whether: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Best similarity and the position of a leader that reaches it, -1 where none reaches the threshold.

    Only leaders before the point count; among equal ones the latest wins. ``leader_at`` is sorted. With
    ``whether`` it only matters if there is one: a point that has met one is not compared further.
    """
    best, choice = np.full(len(points), threshold), np.full(len(points), -1, dtype=np.int64)
    usable = int(np.searchsorted(leader_at, at.max()))
    for start in range(0, usable, _COLS):
        cols = slice(start, min(start + _COLS, usable))
        rows = np.flatnonzero(choice < 0) if whether else np.arange(len(points))
        for lo in range(0, len(rows), _ROWS):
            r = rows[lo : lo + _ROWS]
            sims = points[r] @ leaders[cols].T
            sims[leader_at[cols][None, :] >= at[r][:, None]] = -np.inf
            top = sims.max(axis=1)
            near = sims >= top[:, None] - EPSILON
            latest = near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)
            better = top >= best[r] - EPSILON
            best[r] = np.where(better, np.maximum(top, best[r]), best[r])
            choice[r] = np.where(better, latest + start, choice[r])
    return best, choice


def _routed(index: Index, threshold: float, elsewhere: bool):
    """Each point once for every tile it can reach; with ``elsewhere`` not for its own ``cell`` and ``tile``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _VISITS // int(index.tiles.sum()))
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            reach = index.reachable(_unit_rows(batch.column("vector")), threshold)
            row, cell = np.nonzero(reach)
            times = index.tiles[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            tile = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            if elsewhere:
                own = (batch.column("cell").to_numpy()[row] == cell) & (batch.column("tile").to_numpy()[row] == tile)
                row, cell, tile = row[~own], cell[~own], tile[~own]
            for lo in range(0, len(row), _ROUTED):
                part = slice(lo, lo + _ROUTED)
                visitors = batch.select(["seq", "vector"]).take(pa.array(row[part]))
                marks = [cell[part].astype(np.int32), tile[part].astype(np.int32), np.ones(len(row[part]), np.int32)]
                yield pa.RecordBatch.from_arrays([*visitors.columns, *map(pa.array, marks)], names=["seq", "vector", "cell", "tile", "mark"])

    return run


def _streamed(threshold: float, whether: bool):
    """Rows sorted by (cell, tile, mark, seq): each tile's residents (mark 0), then its visitors, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, leaders = None, [], None
        seqs, names = np.empty(0, np.int64), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "tile", "mark")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if tuple(keys[:2, lo]) != where:
                    where, held, leaders = tuple(keys[:2, lo]), [], None
                if keys[2, lo] == 0:
                    held.append(part)
                    leaders = None
                    continue
                if not held:
                    continue
                if leaders is None:
                    group = pa.Table.from_batches(held).combine_chunks()
                    seqs, names = group.column("seq").to_numpy(), group.column("id").combine_chunks()
                    leaders = _unit_rows(group.column("vector"))
                    del group
                    held = held[:1]  # all residents have come
                at = part.column("seq").to_numpy()
                best, choice = _improve(_unit_rows(part.column("vector")), at, leaders, seqs, threshold, whether)
                found = np.flatnonzero(choice >= 0)
                if len(found):
                    chosen = choice[found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[found]), pa.array(seqs[chosen]), names.take(pa.array(chosen)), pa.array(best[found])],
                        names=["seq", "leader_seq", "leader_id", "similarity"],
                    )

    return run


def _met(
    points: DataFrame, residents: DataFrame, index: Index, threshold: float, elsewhere: bool = False, whether: bool = False
) -> DataFrame:
    """``seq, leader_seq, leader_id, similarity``: each point's best earlier resident of each tile it reaches.

    ``residents`` have ``seq, id, vector, cell, tile``; so must the points with ``elsewhere``, which meet
    other tiles than their own. With ``whether`` any earlier resident within the threshold stands for the best.
    """
    id_type = residents.schema["id"].dataType.simpleString()
    columns = ["seq", "vector", "cell", "tile"] if elsewhere else ["seq", "vector"]
    vector = residents.schema["vector"].dataType.simpleString()
    visitors = points.select(*columns).mapInArrow(
        _routed(index, threshold, elsewhere), f"seq bigint, vector {vector}, cell int, tile int, mark int"
    )
    both = residents.filter("cell >= 0").select("seq", "id", "vector", "cell", "tile", F.lit(0).alias("mark")).unionByName(
        visitors.withColumn("id", F.lit(None).cast(id_type))
    )
    dealt = both.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "mark", "seq")
    return dealt.mapInArrow(_streamed(threshold, whether), f"seq bigint, leader_seq bigint, leader_id {id_type}, similarity double")


def routing(points: DataFrame, index: Index, threshold: float) -> DataFrame:
    """``seq, met, skipped``: how many tiles each point visits and how many it needn't."""
    visits = points.mapInArrow(_routed(index, threshold, False), f"seq bigint, vector {points.schema['vector'].dataType.simpleString()}, cell int, tile int, mark int")
    met = visits.groupBy("seq").agg(F.count(F.lit(1)).alias("met"))
    some = F.coalesce("met", F.lit(0))
    return points.select("seq").join(met, "seq", "left").select("seq", some.alias("met"), (F.lit(int(index.tiles.sum())) - some).alias("skipped"))


def _ruled(threshold: float):
    """Rows sorted by (cell, tile, seq), ``held`` among them: what each one is by the rule in its tile."""

    def decided(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(rows).combine_chunks()
        if block.column("cell")[0].as_py() < 0:  # zero vectors reach nothing
            what = np.full(block.num_rows, LEADER, np.int8)
        else:
            what = _decide(_unit_rows(block.column("vector")), block.column("held").to_numpy(zero_copy_only=False), threshold)
        table = block.drop_columns(["held"]).append_column("what", pa.array(what.astype(np.int32)))
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rows = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "tile")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if tuple(keys[:, lo]) != where:
                    if rows:
                        yield decided(rows)
                    where, rows = tuple(keys[:, lo]), []
                rows.append(batch.slice(lo, hi - lo))
                if keys[0, lo] < 0:  # however many there are, none waits for another
                    yield decided(rows)
                    rows = []
        if rows:
            yield decided(rows)

    return run


def find_leaders(points: DataFrame, index: Index, threshold: float) -> DataFrame:
    """The leaders among ``points`` (``seq, id, vector``): ``seq, id, vector, cell, tile``, a written table."""
    # A copy is never a leader: whatever covers the first of equal vectors covers it, or the first does.
    first = points.groupBy("vector").agg(F.min("seq").alias("seq"))
    zero = F.forall("vector", lambda x: x == 0)
    heads = points.join(first.select("seq"), "seq", "left_semi").filter(~zero).unionByName(points.filter(zero))
    open_ = cut(located(heads.select("seq", "id", "vector"), index), "open")
    several, leaders = int(index.tiles.sum()) > 1, []
    while True:
        held = open_.withColumn("held", F.lit(False))
        if several:
            waiting = _met(open_, open_, index, threshold, elsewhere=True, whether=True).select("seq").distinct()
            held = open_.join(waiting.withColumn("held", F.lit(True)), "seq", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        ruled = held.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "seq")
        schema = ", ".join(f"`{c}` {t}" for c, t in open_.dtypes)
        what = cut(ruled.mapInArrow(_ruled(threshold), f"{schema}, what int"), "ruled")
        new = what.filter(F.col("what") == LEADER).drop("what")
        leaders.append(new)
        rest = what.filter(F.col("what") == HELD).drop("what")
        last = open_
        if not several or rest.isEmpty():
            discard(last)
            break
        covered = _met(rest, new, index, threshold, whether=True).select("seq").distinct()
        open_ = cut(rest.join(covered, "seq", "left_anti"), "open")
        discard(last)
    out = leaders[0]
    for part in leaders[1:]:
        out = out.unionByName(part)
    return out


def _assigned(points: DataFrame, leaders: DataFrame, index: Index | None, threshold: float) -> DataFrame:
    id_type = points.schema["id"].dataType.simpleString()
    names = [c for c in points.columns if c != "vector"]
    if index is None:
        return points.select(*names, F.lit(None).cast(id_type).alias("leader_id"), F.lit(None).cast("double").alias("similarity"))
    found = _met(points, leaders, index, threshold)
    if int(index.tiles.sum()) == 1:  # one entry per point
        best = found.select("seq", "leader_id", "similarity")
        return points.select(*names).join(best, "seq", "left")
    # At most one entry per tile, in the order of the leaders: the rule's own fold.
    each = found.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("leader_seq", "similarity", "leader_id"))).alias("each"))
    start = F.struct(F.lit(float(threshold)).alias("similarity"), F.lit(None).cast(id_type).alias("leader_id"))
    best = F.aggregate(
        "each",
        start,
        lambda acc, x: F.when(
            x["similarity"] >= acc["similarity"] - EPSILON,
            F.struct(F.greatest(x["similarity"], acc["similarity"]).alias("similarity"), x["leader_id"].alias("leader_id")),
        ).otherwise(acc),
    )
    return points.select(*names).join(each.select("seq", best.alias("best")), "seq", "left").select(*names, "best.leader_id", "best.similarity")


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")


def nearest_leaders(points: DataFrame, leaders: DataFrame, threshold: float, tile_rows: int | None = None) -> DataFrame:
    """Most similar leader before each point, if it reaches the threshold: adds ``leader_id, similarity``.

    Both sides hold ``(seq, id, vector)``, ``seq`` unique on either; other columns of the points stay and the
    vector goes. Among equally similar leaders the latest wins.
    """
    _checked(threshold)
    index = build_index(leaders, tile_rows)
    if index is None:
        return _assigned(points, leaders, None, threshold)
    return _assigned(points, located(leaders.select("seq", "id", "vector"), index), index, threshold)


def leader_clusters(
    points: DataFrame,
    id_col: str,
    vector_col: str,
    order: Sequence[str],
    threshold: float = DEFAULT_THRESHOLD,
    tile_rows: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Cluster assignment of every point that has a vector: ``id, seq, cluster_id, similarity``.

    ``cluster_id`` is the id of the cluster's leader; a leader has no similarity. ``order`` must
    end in a unique column. ``keep`` columns travel along, which saves a join afterwards.
    """
    _checked(threshold)
    keys = list(dict.fromkeys(order))
    base = points.filter(F.col(vector_col).isNotNull()).select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)],
        F.col(id_col).alias("id"),
        F.col(vector_col).cast("array<float>").alias("vector"),
        *keep,
    )
    ordered = order_ids(base, [f"_o{i}" for i in range(len(keys))]).select("seq", "id", "vector", *keep)
    index = build_index(ordered, tile_rows)
    leaders = find_leaders(ordered, index, threshold) if index is not None else None
    return _assigned(ordered, leaders, index, threshold).select(
        "id", "seq", F.coalesce("leader_id", "id").alias("cluster_id"), "similarity", *keep
    )
