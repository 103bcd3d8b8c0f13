from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmill.operators import containment, dedup, leaders, merge, ordering, prompts
from sigmill.operators.encode import backfill_embeddings, encode_texts
from sigmill.operators.leaders import leader_clusters, nearest_leaders
from workload.base import trigram_encoder


def sequential(vectors, threshold):
    """The rule itself, one point at a time."""
    leaders, out = [], []
    for i, raw in enumerate(vectors):
        v = np.asarray(raw, np.float32).astype(float)
        n = np.linalg.norm(v)
        v = v / n if n else v
        best, best_sim = None, threshold - 5e-13
        for j, u in leaders:
            sim = float(v @ u)
            if sim >= best_sim - 5e-13:
                best, best_sim = j, max(sim, best_sim)
        if best is None:
            leaders.append((i, v))
            best = i
        out.append(best)
    return out


def clustered(spark, vectors, threshold, **sizes):
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>"
    ).repartition(3)
    found = leader_clusters(frame, "id", "v", ["id"], threshold, **sizes)
    return [r["cluster_id"] for r in found.orderBy("id").collect()]


@pytest.mark.parametrize("seed", range(6))
def test_leaders_equal_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    points = centres[rng.integers(0, 6, 90)] + rng.normal(scale=[0.1, 0.4, 0.9][seed % 3], size=(90, 8))
    points[rng.integers(0, 90, 20)] = points[3]  # a group of copies
    points[5] = 0
    points[41] = 0
    threshold = [0.88, 0.6, 0.3][seed % 3]
    wanted = sequential(points, threshold)
    assert clustered(spark, points, threshold) == wanted
    # Small tiles: points wait for other tiles.
    assert clustered(spark, points, threshold, tile_rows=7) == wanted


def test_leaders_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(leaders, "_ROUTED", 9)
    rng = np.random.default_rng(17)
    points = rng.normal(size=(70, 5))
    wanted = sequential(points, 0.7)
    assert clustered(spark, points, 0.7, tile_rows=20) == wanted
    # The same leaders, given in tiles of three, are found again.
    frame = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(points)], "seq bigint, id bigint, vector array<float>")
    heads = frame.filter(F.col("id").isin(sorted(set(wanted))))
    found = nearest_leaders(frame, heads, 0.7, tile_rows=3).orderBy("seq").collect()
    assert [i if r["leader_id"] is None else r["leader_id"] for i, r in enumerate(found)] == wanted


def test_chains_that_cross_tiles(spark):
    """Every point only reaches its neighbours in order, so every second one is a leader."""
    points = [[np.cos(0.3 * i), np.sin(0.3 * i), 0.0] for i in range(10)]
    wanted = sequential(points, np.cos(0.35))
    assert wanted == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]
    assert clustered(spark, points, float(np.cos(0.35)), tile_rows=3) == wanted


def test_points_skip_tiles_that_they_cannot_reach(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)
    points = centres[np.arange(400) % 8] + rng.normal(scale=0.05, size=(400, 8))
    frame = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(points)], "seq bigint, id bigint, vector array<float>")
    index = leaders.build_index(frame, 25)
    rows = leaders.routing(frame, index, 0.88).collect()
    assert len(rows) == 400 and len({r["met"] + r["skipped"] for r in rows}) == 1
    assert sum(r["met"] for r in rows) < 0.4 * sum(r["met"] + r["skipped"] for r in rows)
    assert all(r["met"] for r in rows)
    # Nothing within the threshold is skipped.
    units = points / np.linalg.norm(points, axis=1)[:, None]
    reach, cells = index.reachable(units, 0.88), index.cells(units)
    for i, j in np.argwhere(units @ units.T >= 0.88):
        assert reach[i, cells[j]]
    assert clustered(spark, points[:120], 0.88, tile_rows=15) == sequential(points[:120], 0.88)


def test_copies_and_vectors_of_several_lengths(spark):
    points = [[1.0, 0.0]] * 40 + [[0.0, 0.0]] * 3 + [[0.9, 0.1]] * 40 + [[0.0, 1.0]] * 5
    assert clustered(spark, points, 0.88, tile_rows=5) == sequential(points, 0.88)
    with pytest.raises(ValueError):
        clustered(spark, [[1.0, 0.0], [1.0]], 0.88)


def test_drift_regime_keeps_two_clusters(spark):
    """Two themes with close members and a cross similarity below the threshold stay apart."""
    intra, cross = 0.8853, 0.8380
    rows = []
    for theme in range(2):
        for member in range(8):
            v = np.zeros(20)
            v[0] = np.sqrt(cross)
            v[1 + theme] = np.sqrt(intra - cross)
            v[3 + theme * 8 + member] = np.sqrt(1 - intra)
            rows.append(v)
    mixed = [rows[i // 2 + 8 * (i % 2)] for i in range(16)]
    got = clustered(spark, mixed, 0.88)
    assert got == [i % 2 for i in range(16)]


def test_ties_go_to_the_latest_leader(spark):
    assert clustered(spark, [[1, 0, 0], [0, 1, 0], [1, 1, 0], [1, 1, 0]], 0.7) == [0, 1, 1, 1]


def test_no_vectors_and_bad_threshold(spark):
    empty = spark.createDataFrame([(1, None)], "id bigint, v array<float>")
    assert leader_clusters(empty, "id", "v", ["id"]).count() == 0
    with pytest.raises(ValueError):
        leader_clusters(empty, "id", "v", ["id"], threshold=0.0)


def test_contained_phrases(spark, rows, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc é"), size=n)) for n in rng.integers(0, 60, 60)]
    phrases = sorted({t[i : i + n] for t in texts[:20] for i, n in ((0, 1), (2, 3), (5, 17), (1, 30))} - {""}) + ["zzz", "b"]
    text_frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    phrase_frame = spark.createDataFrame([*enumerate(phrases), (999, "")], "pos bigint, phrase string")
    wanted = sorted(((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t), key=repr)
    assert rows(containment.contained_phrases(text_frame, phrase_frame)) == wanted
    # Short windows and pieces, and no word that phrases may share.
    for name, value in (("WINDOW_CHARS", 8), ("PIECE_CHARS", 5), ("SHARED", 0)):
        monkeypatch.setattr(containment, name, value)
        assert rows(containment.contained_phrases(text_frame, phrase_frame)) == wanted
    capped = rows(containment.first_matches(containment.contained_phrases(text_frame, phrase_frame), 3), "id", "pos")
    per_text: dict = {}
    for i, j in sorted(wanted):
        per_text.setdefault(i, []).append(j)
    assert capped == sorted(((i, j) for i, js in per_text.items() for j in js[:3]), key=repr)


def test_keep_first_and_reports(spark, rows):
    frame = spark.createDataFrame([("u", 3, "c"), ("u", 1, "a"), ("v", 2, "b"), ("u", 2, None)], "k string, seq int, body string")
    assert rows(dedup.keep_first(frame, ["k"], ["seq"])) == [("u", 1, "a"), ("v", 2, "b")]
    assert rows(dedup.duplicate_report(frame, "k")) == [(4, 2, 2)]
    other = spark.createDataFrame([("v",), ("w",)], "k string")
    assert rows(dedup.coverage(frame, other, "k")) == [(1, 1, 1)]


def test_dense_order_rank_and_previous(spark, rows):
    data = [(g, v, f"{g}{v}") for g in "abc" for v in range(1, 40)]
    frame = spark.createDataFrame(data, "name string, version int, body string").repartition(5)
    ids = ordering.dense_order_ids(frame, ["name", "version"])
    assert [r["body"] for r in ids.orderBy("seq").collect()] == [d[2] for d in data]
    assert [r["seq"] for r in ids.orderBy("seq").collect()] == list(range(len(data)))
    ranked = ordering.with_rank_in_group(frame, "name", ["version"])
    assert ranked.filter("rank <> version").count() == 0
    previous = ordering.with_previous(frame, "name", ["version"], ["body"])
    got = {r["body"]: r["previous_body"] for r in previous.collect()}
    assert got == {f"{g}{v}": f"{g}{v - 1}" if v > 1 else None for g in "abc" for v in range(1, 40)}


def test_insert_if_absent_is_idempotent(spark, rows):
    stored = spark.createDataFrame([("u", "old")], "k string, body string")
    new = spark.createDataFrame([("u", "x", 1), ("v", "later", 3), ("v", "first", 2)], "k string, body string, seq int")
    fresh, counts = merge.insert_if_absent(stored, new, ["k"], ["seq"])
    assert rows(fresh, "k", "body") == [("v", "first")]
    assert rows(counts) == [(1, 2)]
    again, counts = merge.insert_if_absent(stored.unionByName(fresh.select("k", "body")), new, ["k"], ["seq"])
    assert again.count() == 0 and rows(counts) == [(0, 3)]


def test_upsert_update_delete(spark, rows):
    stored = spark.createDataFrame([("1", "a", 1, "x"), ("2", "b", 2, None)], "id string, k string, v int, note string")
    changes = spark.createDataFrame([("9", "b", 7, 1), ("8", "b", 8, 2), ("3", "c", 3, 1)], "id string, k string, v int, ts int")
    merged = merge.upsert_last_wins(stored, changes, ["k"], ["ts"])
    wanted = [("1", "a", 1, "x"), ("2", "b", 8, None), ("3", "c", 3, None)]
    assert rows(merged) == wanted
    assert rows(merge.upsert_last_wins(merged, changes, ["k"], ["ts"])) == wanted
    label = spark.createDataFrame([("a", None), ("zz", "new")], "k string, note string")
    assert rows(merge.update_keyed(stored, label, "k"), "k", "note") == [("a", None), ("b", None)]
    with pytest.raises(merge.UnknownKeyError):
        merge.update_keyed(stored, label, "k", strict=True)
    left, hits = merge.delete_keys(stored, label, "k")
    assert rows(left, "k") == [("b",)] and rows(hits) == [("a", True), ("zz", False)]


def test_single_active(spark, rows):
    stored = spark.createDataFrame([("a", True), ("b", False)], "name string, is_active boolean")
    assert rows(merge.set_single_active(stored, "name", "b")) == [("a", False), ("b", True)]
    assert rows(merge.set_inactive(stored, "name", "a")) == [("a", False), ("b", False)]
    for change in (merge.set_single_active, merge.set_inactive):
        with pytest.raises(merge.UnknownKeyError):
            change(stored, "name", "nobody")


def test_map_merges(spark):
    a, b = F.expr("map('x', 1L, 'y', 2L)"), F.expr("map('y', 5L, 'z', 1L)")
    row = spark.range(1).select(merge.merge_maps(a, b).alias("s"), merge.overlay_maps(a, b).alias("o")).first()
    assert row["s"] == {"x": 1, "y": 7, "z": 1} and row["o"] == {"x": 1, "y": 5, "z": 1}


def test_render(spark):
    frame = spark.createDataFrame([("body {{ x }}",)], "t string")
    text = frame.select(prompts.render("{#- note -#}\n{{ n }}: {{ t }}\n", n=F.lit(3), t=F.col("t")).alias("p")).first()["p"]
    assert text == "3: body {{ x }}\n"
    for template in ("{{ missing }}", "{% if x %}", "{{ n | upper }}"):
        with pytest.raises(prompts.PromptTemplateError):
            prompts.render(template, n=F.lit(1))


def test_body_parts_join_back(spark):
    data = [("hot", i, f"b{i}") for i in range(50)] + [("cold", 0, "only")]
    frame = spark.createDataFrame(data, "cluster_id string, seq int, body string").repartition(4)
    parts = prompts.body_parts(frame, "cluster_id", ["seq"], per_part=16)
    got = {}
    for r in parts.orderBy("cluster_id", "part").collect():
        assert len(r["bodies"]) <= 16
        got.setdefault(r["cluster_id"], []).extend(r["bodies"])
    assert got == {"hot": [f"b{i}" for i in range(50)], "cold": ["only"]}


def test_encoder_and_backfill(spark):
    frame = spark.createDataFrame(
        [("1", "late parcel", None), ("2", "late parcel!", None), ("3", "", [1.0, 0.0])], "id string, body string, embedding array<float>"
    )
    filled = backfill_embeddings(frame, lambda: trigram_encoder(32))
    got = {r["id"]: np.asarray(r["embedding"]) for r in filled.collect()}
    assert np.linalg.norm(got["1"]) == pytest.approx(1) and list(got["3"]) == [1.0, 0.0]
    assert got["1"] @ got["2"] > 0.8
    again = backfill_embeddings(filled, lambda: trigram_encoder(32))
    assert {r["id"]: list(r["embedding"]) for r in again.collect()} == {k: list(v) for k, v in got.items()}
    assert encode_texts(frame, "id", "body", lambda: trigram_encoder(8), batch_size=1).count() == 3


def test_copies_of_phrases_are_expanded_after_the_last_shuffle(spark, rows):
    texts = spark.range(40).selectExpr("id", "concat('so it says here: ', id % 2, ' of two') AS text")
    phrases = spark.range(60).selectExpr("id AS pos", "concat('says here: ', id % 3, ' of') AS phrase")
    found = containment.contained_phrases(texts, phrases)
    assert rows(found) == sorted(((i, j) for i in range(40) for j in range(60) if i % 2 == j % 3), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Generate explode(coalesce(members"):]
    assert "Exchange" not in plan[: plan.index("Generate explode(coalesce(members")].replace("BroadcastExchange", "") and "Exchange" in above


def test_rows_of_one_phrase_with_many_texts_and_copies_are_dealt_out(spark, rows, monkeypatch):
    for name, value in (("BLOCK_TEXTS", 16), ("BLOCK_COPIES", 16), ("TASK_ROWS", 1024)):
        monkeypatch.setattr(containment, name, value, raising=False)
    texts = spark.range(200).selectExpr("nullif(id, 7) AS id", "concat('so it says here ', id) AS text")
    phrases = spark.range(150).selectExpr("id AS pos", "if(id = 5, 'here 1', 'it says here') AS phrase")
    found = containment.contained_phrases(texts, phrases)
    one = [i for i in range(200) if str(i).startswith("1")]
    wanted = [(i, j) for i in range(200) for j in range(150) if j != 5] + [(i, 5) for i in one]
    assert rows(found) == sorted(((None if i == 7 else i, j) for i, j in wanted), key=repr)
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 10 and max(per_task) < len(wanted) / 4


def test_phrases_that_share_their_words_are_found_where_words_begin(spark, rows, monkeypatch):
    def characters(*_):
        raise AssertionError("looked at character by character")

    monkeypatch.setattr(containment, "_by_run", characters)
    monkeypatch.setattr(containment, "MANY", 256, raising=False)
    phrases = [f" the of to {i:03d}abcdefghijklm" for i in range(300)]
    texts = [f"é\U0001F600 all{phrases[i]}no and{phrases[(i * 7) % 300]}" for i in range(40)] + ["the of to 001abcdefghijklm"]
    text_frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    phrase_frame = spark.createDataFrame(list(enumerate(phrases)), "pos bigint, phrase string")
    wanted = sorted(((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t), key=repr)
    assert rows(containment.contained_phrases(text_frame, phrase_frame)) == wanted


def test_places_of_words_in_pieces_of_awkward_texts(spark, rows, monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab \n é\U0001F600"), size=n)) for n in rng.integers(0, 120, 60)]
    phrases = sorted({t[i : i + n] for t in texts for i, n in ((0, 5), (3, 9), (7, 14), (20, 40))} - {""})
    text_frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    phrase_frame = spark.createDataFrame(list(enumerate(phrases)), "pos bigint, phrase string")
    for name, value in (("START_LENGTHS", (2, 4, 8)), ("START_CHARS", 10), ("PIECE_CHARS", 50), ("MANY", 1)):
        monkeypatch.setattr(containment, name, value, raising=False)
    wanted = sorted(((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t), key=repr)
    assert rows(containment.contained_phrases(text_frame, phrase_frame)) == wanted


def test_few_phrases_are_found_in_one_pass(spark, rows, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab.[^-]\\Q é\n\U0001F600"), size=n)) for n in rng.integers(0, 90, 50)]
    phrases = sorted({t[i : i + n] for t in texts for i, n in ((0, 1), (2, 2), (3, 3), (5, 6))} - {""})
    text_frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    phrase_frame = spark.createDataFrame(list(enumerate(phrases)), "pos bigint, phrase string")
    wanted = sorted(((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t), key=repr)
    for name, value in (("PIECE_CHARS", 5), ("FEW", 0), ("FEW", len(phrases))):
        monkeypatch.setattr(containment, name, value)
        found = containment.contained_phrases(text_frame, phrase_frame)
        assert rows(found) == wanted
    assert "regexp_extract_all" in found._jdf.queryExecution().toString()


def test_encoders_batches_end_at_a_number_of_characters(spark, monkeypatch):
    from sigmill.operators import encode

    monkeypatch.setattr(encode, "BATCH_CHARS", 100)
    seen, texts = [], ["a" * n for n in (30, 30, 30, 300, 5, 99, 1, 1)]

    def lengths(some):
        seen.append([len(t) for t in some])
        return np.array([[len(t), 1.0] for t in some])

    vectors = encode._encoded(lengths, texts, 3)
    assert seen == [[30, 30, 30], [300], [5], [99, 1], [1]]
    assert np.allclose(vectors[:, 0] / vectors[:, 1], [len(t) for t in texts])


def traced(work):
    import tracemalloc

    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_products_are_taken_in_small_blocks():
    units = np.eye(16)[np.arange(6000) % 16]
    assert traced(lambda: leaders._improve(units, np.arange(6000), units, np.arange(6000), 0.5)) < 48 << 20


def test_reach_is_decided_in_small_blocks():
    points, others = np.eye(32)[np.arange(4096) % 16], np.eye(32)[16 + np.arange(6000) % 16]
    assert traced(lambda: leaders._reached(points, others, 0.5)) < 48 << 20


def test_unit_rows_are_made_in_place():
    vectors = pa.array([[3.0, 0.0, 4.0, 0.0] * 16, [0.0] * 64] * 10000, pa.list_(pa.float32()))
    units = []
    assert traced(lambda: units.append(leaders._unit_rows(vectors))) < 1.5 * 20000 * 64 * 8
    assert units[0][:2].tolist() == [[0.15, 0.0, 0.2, 0.0] * 16, [0.0] * 64]


def test_visits_are_worked_out_in_small_parts():
    n, tiles = 10000, 400
    index = leaders.Index(np.eye(1, 4), np.zeros((1, 1)), np.full((1, 1), np.pi), np.array([tiles]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([[1.0, 0, 0, 0]] * n)], names=["seq", "vector"])
    visits = []
    assert traced(lambda: visits.extend(b.num_rows for b in leaders._routed(index, 0.5, False)(iter([batch])))) < 48 << 20
    assert sum(visits) == n * tiles


def test_zero_vectors_are_not_gathered():
    names, taken = ["seq", "vector", "cell", "tile", "held"], []

    def batches():
        for k in range(3):
            taken.append(k)
            marks = [pa.array([-1] * 5, pa.int32()), pa.array([0] * 5, pa.int32()), pa.array([False] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array(range(5 * k, 5 * k + 5)), pa.array([[0.0, 0.0]] * 5), *marks], names=names)

    out = leaders._ruled(0.5)(batches())
    assert next(out).column("what").to_pylist() == [leaders.LEADER] * 5 and taken == [0]
    assert [s for b in out for s in b.column("seq").to_pylist()] == list(range(5, 15))


def test_a_point_that_has_met_a_leader_is_not_compared_further():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(5000, 8))
    units /= np.linalg.norm(units, axis=1)[:, None]
    at = np.arange(5000)
    for threshold in (0.5, 0.9, 0.97):
        best, full = leaders._improve(units, at, units, at, threshold)
        some, met = leaders._improve(units, at, units, at, threshold, whether=True)
        assert ((full >= 0) == (met >= 0)).all() and (met <= full).all() and (some <= best + leaders.EPSILON).all()
        found = np.flatnonzero(met >= 0)
        assert (met[found] < found).all() and ((units[found] * units[met[found]]).sum(axis=1) >= threshold - 1e-9).all()
