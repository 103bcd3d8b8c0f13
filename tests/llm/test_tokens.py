"""Token ids, packing, token files and tree concatenation against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sigmill.llm import bpe, packing, token_files
from sigmill.llm.tokens import Encoder
from tests.llm.test_dedup import AWKWARD, frame

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = ["a", "B", "é", " ", "\n", "  ", "\t", "'s", "'S", "1", "22", "!", "<|endoftext|>", "<|", "|>", "ß", "İ", "中", " ", "\xa0", "\x1c", "ö", "word", "the", "ing", "\r\n", "_", "–", "don't", "Σ", "😀", "œ", "é", ",", "."]


@pytest.fixture(scope="module")
def encoders():
    return {v: Encoder(v) for v in (BYTE, WORD)}


def made(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
def test_ids_are_the_librarys(encoders, vocabulary):
    enc = encoders[vocabulary]
    texts = made(1, 3000, 14)
    for _ in range(2):  # the second time from the memo
        ids, at = enc.encode(texts)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.exact(t), repr(t)
    assert enc.encode([])[1].tolist() == [0]


def test_memo_is_bounded(encoders, monkeypatch):
    from sigmill.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    enc = Encoder(BYTE)
    for k in range(5):
        texts = made(k, 100, 10)
        ids, at = enc.encode(texts)
        assert all(ids[at[i] : at[i + 1]].tolist() == enc.exact(t) for i, t in enumerate(texts))
    assert len(enc.memo) < 1000 and len(enc.at) <= len(enc.memo) + 1000


def test_decoding_round_trip(encoders):
    enc = encoders[BYTE]
    for t in made(2, 500, 20):
        ids = np.array(enc.exact(t), np.uint32)
        assert bpe.decode(ids, enc) == t == enc.library.decode(ids.tolist(), skip_special_tokens=False)
    broken = np.array(enc.exact("é中")[:1], np.uint32)
    assert bpe.decode(broken, enc) == enc.library.decode(broken.tolist(), skip_special_tokens=False)


def test_joining_halves(encoders):
    enc = encoders[BYTE]
    rng = random.Random(5)
    long_runs = [" " * 3000, "a" * 2500, "ab" * 1500, "x=1;" * 700, "é" * 900, "\n" * 700 + "x", "😀" * 300, "the" * 800, "'s" * 900, "<|endoftext|>" * 60]
    for t in long_runs + made(6, 60, 400):
        for window in (1, 2, 16):
            cuts = sorted(rng.sample(range(1, len(t)), min(len(t) - 1, 5))) if len(t) > 1 else []
            pieces = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
            ids = [np.array(enc.exact(p), np.uint32) for p in pieces]
            done = ids[0]
            for p in ids[1:]:
                done = bpe.join(done, p, enc, max(window, 16))
            assert done.tolist() == enc.exact(t), (t[:40], cuts)


def test_encode_with_long_texts(spark, encoders):
    rows = [(i, t) for i, t in enumerate(made(7, 60, 120))] + AWKWARD + [(77, "é" * 500), (78, "ab " * 400), (78, "ab " * 400)]
    enc = encoders[BYTE]
    got = bpe.encode(frame(spark, rows), BYTE, most=40)
    want = Counter((d, np.array(enc.exact(t or ""), "<u4").tobytes()) for d, t in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got.collect()) == want
    digests = {r["doc_id"]: r for r in bpe.digests(got, BYTE).collect()}
    assert digests[77]["decoded_sha256"] == hashlib.sha256(("é" * 500).encode()).hexdigest()
    assert digests[1]["n_tokens"] in (0, len(enc.exact(rows[1][1])))
    assert bpe.encode(frame(spark, []), BYTE).count() == 0


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 4000):
        lengths = np.minimum(rng.geometric(0.004, n), 1023)
        histogram = dict(Counter(lengths.tolist()))
        patterns = packing.shortest_pack_first(histogram)
        used = Counter()
        for count, runs in patterns:
            assert count > 0 and sum(k * m for k, m in runs) <= 1024
            for k, m in runs:
                used[k] += count * m
        assert used == Counter(histogram)
        packs = sum(c for c, _ in patterns)
        assert packs <= np.ceil(lengths.sum() / 1024) * 1.01 + 1
    assert packing.shortest_pack_first({300: 10}) == [(3, ((300, 3),)), (1, ((300, 1),))]


def test_packed_rows(spark, encoders):
    enc = encoders[BYTE]
    rows = [(1000 + i, t) for i, t in enumerate(made(9, 200, 60))] + [(5000 + i, "same again") for i in range(120)] + AWKWARD
    docs = frame(spark, rows)
    got = packing.packed(docs, BYTE, size=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    want = Counter()
    for d, t in rows:
        ids = [*enc.exact(t or ""), 0]
        for s in range(0, len(ids), 64):
            part = np.array(ids[s : s + 64], "<u4")
            want[(d, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert packing.packed(docs.limit(0), BYTE).count() == 0


def test_sequences(spark, encoders):
    enc = encoders[BYTE]
    rows = [(i, t) for i, t in enumerate(made(11, 40, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts = packing.pieces(docs, BYTE, size=64)
    places = packing.packed(docs, BYTE, size=64)
    where = {(r["doc_id"], r["start"]): r for r in places.collect()}
    built = {r["sequence_id"]: r for r in packing.sequences(parts, places, size=64).collect()}
    for (d, s), r in where.items():
        ids = [*enc.exact(rows[d][1]), 0][s : s + r["length"]]
        row = np.frombuffer(built[r["sequence_id"]]["ids"], "<u4")
        assert row[r["offset"] : r["offset"] + r["length"]].tolist() == ids
    for r in built.values():
        n = r["tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 64)


def test_token_files(spark, encoders, tmp_path):
    enc = encoders[WORD]
    rows = [(1000 - i, t) for i, t in enumerate(made(13, 300, 40))] + AWKWARD
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame(spark, rows), path, WORD, end_id=1)
    got = sorted(token_files.catalogue(token_files.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    start = 0
    for (d, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = np.array([*enc.exact(t or ""), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for f in sorted((tmp_path / "tokens").glob("*.parquet")):
        chunk = pq.ParquetFile(f).metadata.row_group(0).column(4)
        assert chunk.path_in_schema.startswith("ids") and chunk.has_column_index is not False
        assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(chunk.encodings)
    token_files.write_tokens(frame(spark, []), path + "0", WORD, end_id=1)
    assert token_files.catalogue(token_files.read_tokens(spark, path + "0")).count() == 0
