"""Substring deduplication against brute force, with awkward texts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from sigmill.llm import repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, doc int, place string, anchor int, block int, `a.b` int, spans string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(d, t, 1, "p", 2, 3, 4, "s") for d, t in rows], schema)


def brute(rows, width=20):
    order = {}
    for d, t in rows:
        t = t or ""
        order[(d is not None, d or 0, hashlib.sha256(t.encode()).hexdigest())] = (d, WORD.findall(t.encode()))
    seen, out = set(), {}
    for key in sorted(order):
        d, words = order[key]
        gone = set()
        for i in range(len(words) - width + 1):
            run = b" ".join(words[i : i + width])
            if run in seen:
                gone.update(range(i, i + width))
            seen.add(run)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[(d, key[2])] = (d, len(words), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest())
    return sorted((out[(d, hashlib.sha256((t or "").encode()).hexdigest())] for d, t in rows), key=repr)


def prose(rng, n, words=900):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (19, 20, 21, 40, 60, 150)]
    line = "the same line of seven words "
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(prose(rng, rng.randrange(0, 50)))
            if rng.random() < 0.5:
                p = rng.choice(passages).split(" ")
                a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
                parts.append(" ".join(p[a:b]) if rng.random() < 0.4 else " ".join(p))
            if rng.random() < 0.2:
                parts.append(line * rng.randrange(1, 9))
        sep = rng.choice([" ", "\n", " \t\r\n ", "\x0b\x0c"])
        rows.append((rng.randrange(10**6), sep.join(parts)))
    for _ in range(40):  # near and exact copies
        d, t = rng.choice(rows)
        w = t.split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "", "é ü", "W1"])
        rows.append((rng.randrange(10**6), " ".join(w)))
    return rows


AWKWARD = [(None, "n " * 30), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "w " * 5000), (5, "a b c " * 400), (6, " ".join("abc") + " " + "q " * 19), (7, "w " * 19), (8, "w " * 20)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_and_texts(spark, rows, seed):
    table = corpus(seed) + (AWKWARD if seed == 1 else [])
    got = repeats.drop_repeats(frame(spark, table))
    assert rows(got) == brute(table)


def test_repeated_ids_and_rows(spark, rows):
    rng = random.Random(9)
    a, b = prose(rng, 50), prose(rng, 60)
    table = [(5, a), (5, a), (5, b + " " + a), (5, None), (None, a), (None, a), (3, b), (3, "z"), (4, a)]
    assert rows(repeats.drop_repeats(frame(spark, table))) == brute(table)


def test_many_small_blocks_and_salts(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "PER_BLOCK", 7)
    table = corpus(4)
    assert rows(repeats.drop_repeats(frame(spark, table))) == brute(table)


def test_string_ids_other_widths_and_empty_table(spark, rows):
    table = [(f"d{d}", t) for d, t in corpus(5)[:60]]
    schema = SCHEMA.replace("doc_id bigint", "doc_id string")
    # Strings are ordered as strings: number them alike.
    place = {d: i for i, d in enumerate(sorted({d for d, _ in table}))}
    back = {i: d for d, i in place.items()}
    want = sorted(((back[r[0]], *r[1:]) for r in brute([(place[d], t) for d, t in table], 11)), key=repr)
    assert rows(repeats.drop_repeats(frame(spark, table, schema), width=11)) == want
    none = repeats.drop_repeats(frame(spark, []))
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    with pytest.raises(ValueError):
        repeats.drop_repeats(frame(spark, []), width=5)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, 400, dtype=np.uint64)
    text = np.concatenate([words[:200], rng.integers(0, 2**63, 37, dtype=np.uint64), words[50:180]])
    starts, place, grams = repeats.anchors(text, np.array([0, len(text)]), 20)
    for i in range(50, 161):
        j = 237 + i - 50
        assert place[i] - i == place[j] - j and grams[place[i]] == grams[place[j]]
    assert len(starts) == len(text) - 19


def test_agreement_is_counted_to_the_first_difference():
    a = np.arange(500)
    for n in (0, 1, 31, 32, 33, 100, 499, 500):
        b = a.copy()
        b[n:] += 1
        assert repeats._agree(a, b) == n
    assert repeats._agree(a, a[:0]) == 0
