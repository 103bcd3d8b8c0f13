"""Exact deduplication, sharding and near-duplicates against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sigmill.llm import exact, minhash, sharding, shingles
from sigmill.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id bigint, text string, row string, hash int, kept string, node int, key string, part int, toxic int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "r", 1, "k", 2, "y", 3, 4, 5) for d, t in rows], CLASH)


AWKWARD = [(None, "Null id"), (1, None), (2, ""), (3, "Same TEXT"), (4, "same text"), (4, "same text"), (5, "É same"), (6, "é same"), (7, "w " * 30_000), (8, " \n\t")]


def test_exact_groups(spark):
    rows = AWKWARD + [(100 + i, f"Copy {i % 3}") for i in range(60)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(FOLD)].append(d)
    want = []
    for d, t in rows:
        own = groups[(t or "").translate(FOLD)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((d, keep, len(own), d == keep, hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    least = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(frame(spark, rows), keep="min").collect()}
    assert least[159] == 100 + 159 % 100 % 3


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    docs = frame(spark, AWKWARD)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert got == sorted([(None, "Null id"), (2, ""), (4, "same text"), (5, "É same"), (6, "é same"), (7, "w " * 30_000), (8, " \n\t")], key=repr)
    assert exact.drop_copies(docs.limit(0)).count() == 0


def test_shards_are_even_and_places_gapless(spark):
    random.seed(3)
    rows = AWKWARD + [(1000 + i, "x" * random.randint(0, 400)) for i in range(1500)] + [(9000 + i, "copy " * 20) for i in range(700)]
    got = sharding.shard(frame(spark, rows), shards=10, slots=512).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    load = Counter()
    for s in range(10):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    for r in got:
        load[r["shard"]] += r["size"]
    small = sum(v for v in load.values()) - 60_016
    assert max(v for s, v in load.items()) <= max(60_016 + small / 50, 1.02 * small / 9)
    assert sharding.shard(frame(spark, rows[:0]), shards=10, slots=512).count() == 0


def test_map_edits():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 5000, 1024).tolist()
    start = sharding.first_map(1024, 16)
    even = sharding.rebalance(start, sizes, 16)
    load = np.bincount(even, sizes, minlength=16)
    assert load.max() - load.min() <= 0.001 * load.mean()
    assert sum(a != b for a, b in zip(start, even, strict=True)) < 512
    grown = sharding.add_shard(even, sizes, 16)
    assert all(b in (a, 16) for a, b in zip(even, grown, strict=True))
    load = np.bincount(grown, sizes, minlength=17)
    assert load.max() < 1.15 * load.mean()


def test_the_stored_map_is_edited_not_made_anew(spark, tmp_path):
    path = str(tmp_path / "map")
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(1200)]

    def run(rows, shards):
        got = sharding.shard(frame(spark, rows), shards=shards, slots=256, path=path).collect()
        return {r["doc_id"]: r["shard"] for r in got}, got[0]["map_version"]

    first, version = run(rows, 8)
    assert version == 1 and sharding.stored_versions(spark, path) == [0, 1]
    assert run(rows, 8) == (first, 1)  # nothing to edit
    more = rows + [(5000 + i, "y" * rng.randint(0, 300)) for i in range(150)]
    grown, version = run(more, 8)
    assert version == 2 and sharding.stored_versions(spark, path) == [0, 1, 2]
    moved = sum(grown[d] != s for d, s in first.items())
    assert 0 < moved < 0.3 * len(first)
    old = [r["shard"] for r in sharding.stored_map(spark, path, 1).orderBy("vslot").collect()]
    wide, version = run(more, 9)
    assert version >= 3 and set(wide.values()) == set(range(9))
    added = [r["shard"] for r in sharding.stored_map(spark, path, 3).orderBy("vslot").collect()]
    newest = [r["shard"] for r in sharding.stored_map(spark, path, 2).orderBy("vslot").collect()]
    assert all(b == a or b == 8 for a, b in zip(newest, added, strict=True)) and old != newest
    with pytest.raises(ValueError):
        run(more, 8)


def test_components_match_union_find(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shingle_sets():
    texts = ["", None, "one", "One two\tthree four", "a b c d e", "a b c d e a b c d e", " A b\nc d  e ", "é É x y z w", "a\x0bb\x0cc d e f"]
    h, at = shingles.shingle_sets(pa.array(texts))
    sets = [frozenset(h[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 5, 1, 2, 2]
    assert sets[4] == sets[6] and sets[4] < sets[5]
    alone = [shingles.shingle_sets(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert [sorted(s) for s in sets] == alone


def brute(rows):
    sets, up = {}, {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = lambda d: -(2**63) if d is None else d

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(low(rows[i][0])), find(low(rows[j][0]))))
                up[b] = a
    out = []
    for i, (d, _) in enumerate(rows):
        c = find(low(d))
        out.append((d, len(sets[i]), None if c == -(2**63) else c, low(d) == c))
    return out


def near_rows():
    random.seed(8)
    words = [f"w{i}" for i in range(500)]
    rows = list(AWKWARD)
    base = random.choices(words, k=120)
    for i in range(90):  # a group in which many pairs are below the bound, but most are linked by others
        t = list(base)
        for _ in range(random.randint(0, 5)):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((200 + i, " ".join(t)))
    chain = random.choices(words, k=100)
    for i in range(12):  # each links to the one before only
        chain = chain[2:] + random.choices(words, k=2)
        rows.append((400 - i, " ".join(chain)))
    half = " ".join(random.choices(words, k=60))
    rows += [(500 + i, half + " " + " ".join(random.choices(words, k=30))) for i in range(30)]
    rows += [(600 + i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(60)]
    return rows + [(700 + i, "short one") for i in range(20)] + [(730, "one two three four five"), (731, "one two three four")]


@pytest.mark.parametrize(("block", "per_centre"), [(512, 512), (8, 4)])
def test_near_groups(spark, monkeypatch, block, per_centre):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PER_CENTRE", per_centre)
    rows = near_rows()
    got = [tuple(r) for r in minhash.near_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_drop_near_copies(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = Counter((r[0], rows[i][1]) for i, r in enumerate(brute(rows)) if r[3])
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(dict.fromkeys(want, 1))
    assert minhash.drop_near_copies(docs.limit(0)).count() == 0


def test_min_max_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    got = []
    for _ in range(60):
        own = rng.permutation(pool)
        a, b = np.sort(own[:700]), np.sort(own[100:800])
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, 700, 1400]))
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 600 / 800) < 0.015
