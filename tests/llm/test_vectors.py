"""Hard negatives and centroids against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import centroids, negatives, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, cell int, vector string, anchor int, rank int, distance int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "r", 1, "v", 2, 3, 4, 5) for i, v, k in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, factor):
    return [max(-vectors.BOUND, min(vectors.BOUND, math.floor(factor * float(np.float32(x))))) for x in v]


AWKWARD = [
    (900, None, 1), (901, [0.5, None, 0.1, 0.2], 1), (902, [float("nan"), 0.0, 0.0, 1.0], 1), (903, [float("inf"), 0.0, 0.0, 1.0], 2),
    (904, [0.1, 0.2, 0.3, 0.4], None), (None, [0.3, 0.2, 0.1, 0.4], 1), (950, [0.0, 0.0, 0.0, 0.0], 2), (951, [0.4, 0.4], 1),
    (1000, [0.9, 0.1, 0.0, 0.2], 77), (905, [], 1), (350, [0.5, 0.5, 0.5, 0.5], 1), (350, [0.5, 0.5, 0.5, 0.5], 1),
]


def some(n, dims, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        near = base[rng.randrange(6)]
        v = [x + rng.gauss(0, 0.4) for x in near] if rng.random() < 0.5 else [rng.gauss(0, 1) for _ in range(dims)]
        rows.append((i, [round(x, 1) for x in v], rng.choice([0, 0, 0, 1, 2, 3])))
    return rows


def hard_negatives(rows):
    used = [(i, whole(v, 256), k, n) for n, (i, v, k) in enumerate(rows) if usable(v) and k is not None]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    def order(x):
        return (-x[0], x[1] is not None, x[1] or 0, x[2])

    out = []
    for i, v, k, n in used:
        if i is None or i % 50:
            continue
        same = sorted(((score(v, w), j, m) for j, w, l, m in used if l == k and m != n), key=order)[:5]
        other = sorted(((score(v, w), j, m) for j, w, l, m in used if l != k), key=order)
        for p, j, _ in same:
            window = [x for x in other if 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate(window)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(16_384, 1_024, 8), (40, 3, 3)])
def test_hard_negatives(spark, rows, monkeypatch, blocks):
    for name, value in zip(("ROWS", "ANCHORS", "CELLS"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    table = some(420, 4, 1) + AWKWARD
    got = negatives.mine(frame(spark, table), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard_negatives(table)
    assert rows(got) == want
    assert {w[0] for w in want} > {0, 350}


def test_hard_negatives_of_hot_groups_and_huge_numbers(spark, rows):
    copies = [(1000 + i, [0.6, 0.8, 0.0], 1) for i in range(300)] + [(2000 + i, [0.5, 0.6, 0.1], 2) for i in range(30)]
    huge = [(3000, [1e30, 0.0, 0.0], 3), (3001, [1e30, 1.0, 0.0], 3), (3002, [1e29, 1e5, 1.0], 4), (3050, [3e5, -1e5, 0.5], 3)]
    table = copies + huge
    assert rows(negatives.mine(frame(spark, table), F.col("vec_id") % 50 == 0)) == hard_negatives(table)


def test_hard_negatives_of_few_rows(spark, rows):
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    alone = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 2)]
    assert negatives.mine(frame(spark, alone), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(frame(spark, some(30, 3, 2)[1:]), F.col("vec_id") % 50 == 0).count() == 0


def test_index_leaves_dimensions_out_and_loses_no_pair():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-200, 200, (300, 24)), rng.integers(-200, 200, (20, 24))
    score = q @ x.T
    for least in (200_000, 100_000, 0, negatives.NONE):
        reach = 0.5 * least / np.linalg.norm(q, axis=1).max()
        index = negatives.Index(x, reach, np.float64)
        a, r, s = index.pairs(q, np.full(20, least))
        assert sorted(zip(a.tolist(), r.tolist(), s.tolist(), strict=True)) == [(i, j, score[i, j]) for i in range(20) for j in range(300) if score[i, j] >= least]
        listed = sum(len(at) for at, _ in index.lists)
        assert (listed < 0.9 * np.count_nonzero(x)) == (least >= 100_000)


def clusters(rows, dims, k, rounds, seed=3):
    points = [(i, whole(v, 1024)) for i, v, _ in rows if usable(v) and len(v) == dims]
    first = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"{seed}:{p[0]}".encode()).hexdigest(), p[1]))[:k]
    cs = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs)) for _, v in points]

    for _ in range(rounds):
        best = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, b) in zip(points, best, strict=True) if b == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = assign()
    inertia = [sum(d for d, b in best if b == j) for j in range(len(cs))]
    return sorted(
        ((i, b, d, inertia[b], sum(inertia), hashlib.sha256(",".join(map(str, cs[b])).encode()).hexdigest()) for (i, _), (d, b) in zip(points, best, strict=True)),
        key=repr,
    )


@pytest.mark.parametrize("block", [centroids.BLOCK, 7])
def test_centroids(spark, rows, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    table = some(150, 4, 7) + AWKWARD + [(5000, [1e30, -1e30, 0.0, 1.0], 1)]
    got = centroids.cluster(frame(spark, table), dims=4, rounds=4)
    assert rows(got) == clusters(table, 4, 8, 4)


def test_centroids_without_points_stay_and_few_rows(spark, rows):
    # More centroids than different points: some never get any.
    table = [(i, [float(i % 3), 1.0], 0) for i in range(20)]
    assert rows(centroids.cluster(frame(spark, table), dims=2)) == clusters(table, 2, 8, 10)
    few = table[:3]
    assert rows(centroids.cluster(frame(spark, few), dims=2)) == clusters(few, 2, 8, 10)
    none = centroids.cluster(frame(spark, []), dims=2)
    assert none.count() == 0 and none.columns == centroids.cluster(frame(spark, few), dims=2).columns
