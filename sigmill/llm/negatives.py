"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

Anchors meet all rows in cells: a block of rows and a block of anchors, both of bounded size, in one task.
There the block of rows becomes an inverted index, a list of rows and values per dimension. A row's
components are taken from the largest to the smallest; the last ones, whose norm alone can't lift a score
to the threshold, are left out of the lists. Anchors walk the lists and add up partial scores; a pair
whose partial score, plus the norm left out times the anchor's norm, stays below the anchor's threshold
is pruned, and only the rest is completed to exact scores.

Thresholds start high and are lowered for the anchors whose windows aren't full: first for their positives,
where rows of other labels are never met, then for the score windows of their negatives. Every row at
or above a threshold is found, so a full window is exact. Only the best few of each window leave a task.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a
shorter vector counts as filled up with zeros; integers beyond 2**27 in size count as 2**27. Repeated rows
are rows of their own: each is another candidate and, as an anchor, has windows of its own. A null id is
never an anchor and comes first among ties. An anchor alone with its label, or one whose scores leave a
window empty, gives no rows there; an empty table gives an empty result. Only id, label and vector are
read, so other columns and their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.llm import vectors
from sigmill.session import cut

FACTOR, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Thresholds of the search for positives, as parts of the rows' mean norm times the anchor's; then none.
POSITIVE_LEVELS = (0.5, 0.3, 0.18, 0.1)
#: Thresholds of the search for negatives, as parts of a window's upper end; then its lower end.
NEGATIVE_LEVELS = (0.9, 0.7)
#: A row's unlisted components have at most this part of the norm that could matter, so that partial scores prune.
UNLISTED = 0.5
#: Rows and anchors that meet in one task, at most; and tasks at least, where there are a thousand rows for each.
ROWS, ANCHORS, CELLS = 16_384, 1_024, 8
#: Pairs whose partial scores are held at once.
PAIRS = 1 << 20
NONE = -(1 << 62)


class Index:
    """An inverted index over the rows of a matrix, for thresholds of at least ``reach`` per unit of anchor norm."""

    def __init__(self, x: np.ndarray, reach: float, kind: type) -> None:
        n, dims = x.shape
        order = np.argsort(-np.abs(x), axis=1, kind="stable")
        squares = np.take_along_axis(x.astype(np.float64) ** 2, order, axis=1)
        suffix = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
        listed = np.zeros((n, dims), bool)
        np.put_along_axis(listed, order, suffix >= max(reach, 0.0), axis=1)
        self.unlisted = np.where(listed, 0, x).astype(kind)
        self.rest = np.sqrt((self.unlisted.astype(np.float64) ** 2).sum(axis=1))
        self.lists = []
        for d in range(dims):
            at = np.flatnonzero(listed[:, d] & (x[:, d] != 0))
            self.lists.append((at, x[at, d].astype(kind)[:, None]))
        self.size, self.kind = n, kind

    def pairs(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``anchor, row, score`` of every pair whose score is at least the anchor's ``least``."""
        q = q.astype(self.kind)
        partial = np.zeros((self.size, len(q)), self.kind)
        for d, (at, values) in enumerate(self.lists):
            partial[at] += values * q[:, d]
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        most = partial + self.rest[:, None] * norm * (1 + 1e-9) + 1e-6
        row, anchor = np.nonzero(most >= least)
        score = partial[row, anchor].astype(np.int64)
        for lo in range(0, len(row), PAIRS // 8):
            part = slice(lo, lo + PAIRS // 8)
            score[part] += np.einsum("ij,ij->i", self.unlisted[row[part]], q[anchor[part]]).astype(np.int64)
        good = score >= least[anchor]
        return anchor[good], row[good], score[good]


def _kind(x: np.ndarray, q: np.ndarray) -> type:
    """A number type in which all sums of products are exact."""
    most = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()) * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max())
    return np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64


def _firsts(group: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first ``most`` of their group; equal groups stand together."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    start = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < most


def _best(rows: pa.Table, anchors: pa.Table, same: bool, most: int) -> pa.Table:
    """The best ``most`` rows in each window of each anchor."""
    names = ["anchor", "k", "row", "id", "score"]
    types = [pa.int64(), pa.int32(), pa.int64(), rows.schema.field("vec_id").type, pa.int64()]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    # Rows in the order of ties.
    rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending"), ("row", "ascending")], null_placement="at_start")).combine_chunks()
    anchors = anchors.combine_chunks()
    x_col, q_col = (t.column("vector").combine_chunks() for t in (rows, anchors))
    dims = max(pc.max(x_col.value_lengths()).as_py(), pc.max(q_col.value_lengths()).as_py())
    x, q = vectors.matrix(x_col, dims), vectors.matrix(q_col, dims)
    own, label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    row_no, row_label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
    k_of, least_of, most_of = (anchors.column(c).to_pylist() for c in ("ks", "leasts", "mosts"))
    slots = max(map(len, k_of))
    ks = np.zeros((len(q), slots), np.int64)
    least, cap = np.full((len(q), slots), 1 << 62), np.full((len(q), slots), NONE)
    for i, (a, b, c) in enumerate(zip(k_of, least_of, most_of, strict=True)):
        ks[i, : len(a)], least[i, : len(a)], cap[i, : len(a)] = a, b, c
    lowest = least.min(axis=1)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    reach = UNLISTED * float(np.divide(lowest, norm, out=np.zeros(len(q)), where=norm > 0).min())
    index = Index(x, reach, _kind(x, q))
    parts = []
    step = max(1, PAIRS // len(x))
    for lo in range(0, len(q), step):
        a, r, s = index.pairs(q[lo : lo + step], lowest[lo : lo + step])
        a = a + lo
        allowed = row_no[r] != own[a] if same else row_label[r] != label[a]
        a, r, s = a[allowed], r[allowed], s[allowed]
        order = np.lexsort((r, -s, a))
        a, r, s = a[order], r[order], s[order]
        for k in range(slots):
            inside = np.flatnonzero((s >= least[a, k]) & (s <= cap[a, k]))
            inside = inside[_firsts(a[inside], most)]
            parts.append((a[inside], ks[a[inside], k], r[inside], s[inside]))
    a, k, r, s = (np.concatenate([p[i] for p in parts]) for i in range(4))
    found = [pa.array(own[a]), pa.array(k.astype(np.int32)), pa.array(row_no[r]), rows.column("vec_id").combine_chunks().take(pa.array(r)), pa.array(s)]
    return pa.table(found, names=names)


def _blocks(n: Column, size: int, least: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size), F.least(F.lit(least), F.ceil(n / 1000))).cast("int")


def _meet(rows: DataFrame, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """The best ``most`` rows in each window (``ks, leasts, mosts``) of each anchor: ``anchor, k, row, id, score``.

    With ``same``, anchors meet the other rows of their label, else those of other labels.
    """
    n, m = F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("m")
    across, down = _blocks(F.col("n"), ROWS, CELLS), _blocks(F.col("m"), ANCHORS, 1)
    if same:
        sizes = cut(rows.groupBy(F.col("label").alias("cell")).agg(n).join(anchors.groupBy(F.col("label").alias("cell")).agg(m), "cell"), "sizes")
        rows, anchors = (d.withColumn("cell", F.col("label")).join(sizes, "cell") for d in (rows, anchors))
    else:
        sizes = [F.lit(d.count()).alias(c) for d, c in ((rows, "n"), (anchors, "m"))]
        rows, anchors = (d.select("*", F.lit(0).alias("cell"), *sizes) for d in (rows, anchors))

    def dealt(d: DataFrame, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
        d = d.withColumn(own, F.pmod(F.xxhash64("row"), own_n).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1))).drop("n", "m")

    left = dealt(rows, "i", across, "j", down).groupBy("cell", "i", "j")
    right = dealt(anchors, "j", down, "i", across).groupBy("cell", "i", "j")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"anchor bigint, k int, row bigint, id {kind}, score bigint"
    found = left.cogroup(right).applyInArrow(lambda r, a: _best(r, a, same, most), schema)
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest_same(rows: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """The best ``most`` other rows of each anchor's label: ``anchor, row, id, score, rank``."""
    count = rows.groupBy("label").agg(F.least(F.count(F.lit(1)) - 1, F.lit(most)).alias("need"))
    open_ = cut(anchors.join(count, "label").filter("need > 0"), "open")
    mean = rows.agg(F.avg("norm")).first()[0] or 0.0
    parts = []
    for level in (*POSITIVE_LEVELS, None):
        least = F.lit(NONE) if level is None else F.ceil(F.col("norm") * F.lit(level * mean))
        asked = open_.select(
            "row", "label", "vector", F.array(F.lit(0)).alias("ks"), F.array(least.cast("bigint")).alias("leasts"),
            F.array(F.lit(1 << 62)).alias("mosts"),
        )
        found = cut(_meet(rows, asked, True, most), "positives")
        full = found.groupBy(F.col("anchor").alias("row")).agg(F.count(F.lit(1)).alias("n"))
        open_ = cut(open_.join(full, "row", "left").filter(F.coalesce("n", F.lit(0)) < F.col("need")).drop("n"), "open")
        parts.append(found.join(open_.select(F.col("row").alias("anchor")), "anchor", "left_anti"))
        if open_.isEmpty():
            break
    return _union(parts).select("anchor", "row", "id", "score", "rank")


def window_negatives(rows: DataFrame, anchors: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows of other labels in each window (``anchor, k, low, high``): ``anchor, k, id, score, rank``."""
    open_ = cut(windows.filter("low <= high"), "windows")
    parts = []
    for level in (*NEGATIVE_LEVELS, None):
        least = F.col("low") if level is None else F.greatest("low", F.ceil(F.col("high") * F.lit(level)))
        held = open_.withColumn("least", least.cast("bigint"))
        # An anchor has as many windows as positives.
        asked = held.groupBy("anchor").agg(F.collect_list(F.struct("k", "least", "high")).alias("w"))
        asked = anchors.join(asked, anchors["row"] == asked["anchor"]).select(
            "row", "label", "vector", F.col("w.k").alias("ks"), F.col("w.least").alias("leasts"), F.col("w.high").alias("mosts")
        )
        found = cut(_meet(rows, asked, False, most), "negatives")
        full = found.groupBy("anchor", "k").agg(F.count(F.lit(1)).alias("n"))
        rest = held.join(full, ["anchor", "k"], "left").filter((F.coalesce("n", F.lit(0)) < most) & (F.col("least") > F.col("low")))
        open_ = cut(rest.select(*open_.columns), "windows")
        parts.append(found.join(open_.select("anchor", "k"), ["anchor", "k"], "left_anti"))
        if open_.isEmpty():
            break
    return _union(parts).select("anchor", "k", "id", "score", "rank")


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    factor: int = FACTOR,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says by the ids (as ``vec_id``) which rows are anchors. A negative of a positive with score ``p``
    has another label and a score from ``low`` to ``high`` hundredths of ``p``.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    used = rows.filter(vectors.finite(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), label.cast("bigint").alias("label"), vectors.scaled(F.col(vector_col), factor).alias("vector")
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    table = cut(used.filter("label IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "*", norm.alias("norm")), "rows")
    asked = cut(table.filter(F.coalesce(anchor, F.lit(False))), "anchors")
    near = cut(nearest_same(table, asked, positives), "near")
    score = F.col("score").cast("decimal(25,0)")
    windows = near.select(
        "anchor", F.col("rank").alias("k"), F.ceil(score * F.lit(low) / F.lit(100)).cast("bigint").alias("low"),
        F.floor(score * F.lit(high) / F.lit(100)).cast("bigint").alias("high"),
    )
    found = window_negatives(table, asked, windows, negatives)
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = near.select("anchor", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.withColumnRenamed("score", "negative_score")
        .join(pairs, ["anchor", "k"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
    )
