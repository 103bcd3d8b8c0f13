"""Fingerprints, toxicity, licences, language-model scores and the pipeline."""

from __future__ import annotations

import hashlib
import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sigmill.llm import fingerprints, licenses, lm, shingles, toxicity
from tests.llm.test_dedup import AWKWARD, frame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    h, _ = shingles.shingle_sets(pa.array([text]))
    return h


def test_sketches():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    mixed = rng.permutation(pool)
    a, b = np.sort(mixed[:4000]), np.sort(mixed[1000:])
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    assert np.array_equal(fingerprints.read(fingerprints.write(x)), x)
    assert np.array_equal(fingerprints.merge(x, y), np.union1d(a, b)[:128])
    both = len(np.intersect1d(a, b))
    assert abs(fingerprints.resemblance(x, y) - both / len(np.union1d(a, b))) < 0.13
    assert abs(fingerprints.containment(x, y) - both / len(a)) < 0.2
    assert abs(fingerprints.distinct(x) / len(a) - 1) < 0.35
    none = np.empty(0, np.uint64)
    assert fingerprints.resemblance(none, none) == 1 and fingerprints.resemblance(none, x) == 0
    small = (pool[:50], pool[20:60])
    assert fingerprints.resemblance(*map(fingerprints.sketch, small)) == 30 / 60


def test_edit_probe(spark):
    random.seed(1)
    rows = [(i * 3, " ".join(random.choices(["aa", "bb", "cc", "é", "dd"], k=random.randint(0, 90)))) for i in range(150)] + AWKWARD
    got = fingerprints.edit_probe(frame(spark, rows)).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (d, t) in enumerate(ordered):
        n, other = len(t) // 2, ordered[(i + 1) % len(ordered)][1]
        edited = t[: len(t) - n] + other[:n]
        own, new, following = (fingerprints.sketch(shingle_set(x)) for x in (t, edited, other))
        want[
            (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.write(own), fingerprints.write(new),
             fingerprints.resemblance(own, new), fingerprints.resemblance(own, following))
        ] += 1
    assert Counter(tuple(r) for r in got) == want
    alone = fingerprints.edit_probe(frame(spark, [(5, "abcdef")])).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone[0]["near_next"] == 1
    assert fingerprints.edit_probe(frame(spark, [])).count() == 0


def test_merged_sketches(spark):
    rows = [(i % 3, f"{i} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(40))) for i in range(30)] + [(9, ""), (None, "a b c d e f")]
    prints = fingerprints.fingerprints(frame(spark, rows))
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.merged(prints, "doc_id").collect()}
    for key in (0, 1, 2, 9, None):
        every = np.unique(np.concatenate([shingle_set(t) for d, t in rows if d == key]))
        assert got[key] == fingerprints.write(every[:128])


def toxic_rows(n=900):
    random.seed(12)
    clean = [f"plain{i}" for i in range(400)]
    bad = ["vexord", "grumbit", "zolchik"] + [f"skarn{x}" for x in "abcdefgh"]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(clean, k=random.randint(3, 120))
        toxic = i % 6 == 0
        if toxic:
            for w in random.choices(bad, k=random.randint(2, 4)):
                words.insert(random.randrange(len(words)), w.capitalize() if i % 12 else w)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    truth = dict(labels)
    extra = [(5000, None), (5001, ""), (None, "vexord grumbit"), (5002, "skarnzz unseen skarnyy ending")]
    got = toxicity.toxicity(frame(spark, rows + extra), spark.createDataFrame([*labels, (1, None)], "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert 200 < len(held) < 400
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["predicted"] == 0 and by[5000]["score"] == by[5001]["score"]
    assert by[5002]["predicted"] == 1 and by[None]["held_out"]
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(d, 1 - t if by[d]["held_out"] else t) for d, t in labels], "doc_id bigint, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, rows + extra), other).collect()}
    assert again == {d: r["score"] for d, r in by.items()}


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_rows(60)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, rows), none).collect()} == {0}
    assert toxicity.toxicity(frame(spark, []), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_drop_toxic_keeps_clean_rows_and_columns(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows + [(5000, None), (1, rows[1][1])])
    left = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[5000] == 1 and ids[1] == 2
    assert sum(ids[d] for d, t in labels if t) <= 3 and sum(not ids[d] for d, t in labels if not t) == 0


MIT = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""


def test_license_rules(spark):
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nMore words"),
        (2, "prose without end\nLicensed under the Apache License, Version 2.0.\n" + "x " * 500 + "\nlicensed under cc by-nc 4.0"),
        (3, MIT + "filler. " * 3 + "This work is licensed under the GNU General Public License, version 3."),
        (4, "It is not released under the MIT license and others. Released under the MIT License and more words."),
        (5, None),
        (6, ""),
        (7, "é中. Licensed under CC BY-SA 3.0;"),
        (7, "é中. Licensed under CC BY-SA 3.0;"),
        (None, "RELEASED  UNDER\n * the mit\n * license"),
        (9, "Permission is hereby granted, free of charge, to any person. Licensed under CC BY 4.0\n"),
    ]
    got = sorted(((r["doc_id"], r["match"], r["license"], r["n_sentences"]) for r in licenses.scan(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(
        [
            (1, 0, "MIT", 1),
            (2, 0, "Apache-2.0", 1),
            (2, 1, "CC-BY-NC-4.0", 1),
            (3, 0, "MIT", 2),
            (3, 1, "GPL-3", 1),
            (7, 0, "CC-BY-SA-3.0", 1),
            (7, 0, "CC-BY-SA-3.0", 1),
            (None, 0, "MIT", 1),
            (9, 0, "CC-BY-4.0", 1),
        ],
        key=repr,
    )
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in licenses.scan(frame(spark, rows)).collect() if r["doc_id"] == 7}
    assert rows[6][1][slice(*spans[7])] == "Licensed under CC BY-SA 3.0"


def test_every_known_sentence_is_recognised():
    for name, sentence in licenses.SENTENCES:
        text = "Before it.\n" + sentence.replace("<n>", "2.1") + ".\nAfter it"
        assert [s[0] for s in licenses.sentences(text)] == [name], sentence
    assert {i for _, rule in licenses.RULES for i in rule} == {n for n, _ in licenses.SENTENCES} | {"spdx"}


def test_tags_single_sentences_and_sentences_far_apart(spark):
    said = dict(licenses.SENTENCES)
    grant, asis = said["mit-grant"] + ":", said["mit-asis"] + "."
    notice = said["mit-notice"] + "."
    rows = [
        (1, "// SPDX-License-Identifier: Apache-2.0\nint main;"), (2, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only)"),
        (3, f"Head.\n{grant}\n" + "other words. " * 400 + f"\n{notice}\n" + "x. " * 200_000 + f"\n{asis}"), (4, f"Head.\n{asis}"), (5, f"Head.\n{grant}"),
        (6, ""), (7, None), (8, "SPDX-License-Identifier:"),
    ]
    got = sorted((r["doc_id"], r["match"], r["license"], r["n_sentences"]) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == [(1, 0, "Apache-2.0", 1), (2, 0, "MIT OR GPL-2.0-only", 1), (3, 0, "MIT", 3), (4, 0, "MIT", 1), (5, 0, "MIT", 1)]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_scan_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter(r["doc_id"] for r in licenses.scan(docs).collect())
    lines = ("Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n = sum(r["text"].count(x) for x in lines)
        if n:
            want[r["doc_id"]] = n
    assert got == want and got


def test_gradients_descend():
    rng = np.random.default_rng(3)
    raws = [(rng.integers(0, 40, 400) * 7 % 1024).astype("<u2").tobytes()]
    target, near, _ = lm.windows(raws)
    m, seen = lm.new_model(), {k: np.zeros(s, np.float32) for k, s in lm.SHAPES.items()}
    before = lm.forward(m, target, near).mean()
    for _ in range(60):
        lm.descend(m, seen, target, near)
    assert lm.forward(m, target, near).mean() > before + 1
    # Probabilities over the whole vocabulary add up to one.
    one = np.repeat(near[:1], lm.VOCABULARY, axis=0)
    assert abs(np.exp(lm.forward(m, np.arange(lm.VOCABULARY), one)).sum() - 1) < 1e-3
    assert np.array_equal(lm.flat(lm.unflat(lm.flat(m))), lm.flat(m))


def test_lm_prefers_natural_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = lm.vocabulary(lm.word_counts(docs))
    every = docs.filter("doc_id % 5 > 0")
    tokens = lm.cut(lm.tokenised(every, words, 2), "test")
    model = lm.train(tokens, 2)
    held = lm.tokenised(docs.filter("doc_id % 5 = 0 and n_chars > 500"), words, 2).collect()
    counts = np.bincount(np.concatenate([np.frombuffer(r["ids"], "<u2") for r in tokens.collect()]), minlength=lm.VOCABULARY) + 1
    unigram = np.log(counts / counts.sum())
    rng, total, plain, n, wins = np.random.default_rng(0), 0.0, 0.0, 0, 0
    for r in held:
        ids = np.frombuffer(r["ids"], "<u2")
        natural = lm.forward(model, *lm.windows([r["ids"]])[:2]).sum()
        mixed = lm.forward(model, *lm.windows([rng.permutation(ids).tobytes()])[:2]).sum()
        total, plain, n, wins = total + natural, plain + unigram[ids].sum(), n + len(ids), wins + (natural > mixed)
    assert total / n > plain / n and wins > 0.7 * len(held)


def test_lm_scores_awkward_rows(spark):
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(frame(spark, AWKWARD)).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["log_likelihood"] == 0 and got[1]["per_token"] is None
    assert got[7]["n_tokens"] == 30_000 and math.isfinite(got[7]["log_likelihood"])
    assert lm.pseudo_likelihood(frame(spark, [])).count() == 0


def word_hashes(text):
    return shingles.words(*shingles.text_bytes(pa.array([text])))[0]


def test_words_of_one_shared_id_have_their_own_probability(spark):
    by_id = {}
    for i in range(4000):
        by_id.setdefault(int(word_hashes(f"rare{i}")[0] % np.uint64(lm.RARE)), []).append(f"rare{i}")
    known, gibberish, other = max(by_id.values(), key=len)[:3]
    frequent = " ".join(f"own{i}" for i in range(lm.SHARED))
    rows = [(i, frequent) for i in range(30)] + [(100, known), (101, gibberish), (102, f"own1 {other} own2 {known}")]
    rows += [(200 + i, f"own{i} {known}") for i in range(18)]
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(frame(spark, rows)).collect()}
    # Both stand alone, so the network says the same of both; only their counts, 20 and 1, differ.
    assert abs(got[100] - got[101] - math.log(20)) < 1e-4


def plain_log_probability(m, target, near):
    """The network's word for one token, in scalar arithmetic."""
    h = [math.tanh(float(m["bias"][j]) + sum(float(m["near"][k][near[k]][j]) for k in range(len(near)))) for j in range(lm.HIDDEN)]

    def log_softmax(weights, bias, at):
        out = [float(bias[c]) + sum(h[j] * float(weights[j][c]) for j in range(lm.HIDDEN)) for c in range(len(bias))]
        return out[at] - math.log(sum(math.exp(x) for x in out))

    c, t = divmod(target, lm.MEMBERS)
    return log_softmax(m["class"], m["class_bias"], c) + log_softmax(m["token"][c], m["token_bias"][c], t)


@pytest.mark.parametrize("held", [lm.HELD, 300, 0])
def test_scores_of_whole_texts(spark, held):
    """Word counts, shares and the summed score of whole texts, against brute force under the same network."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = lm.word_counts(docs.repartition(7))
    words = lm.vocabulary(counts, 20, held)
    every = Counter(h for r in docs.collect() for h in word_hashes(r["text"]).tolist())
    assert {r["hash"] % (1 << 64): r["n"] for r in counts.collect()} == every
    assert len(words.hashes) == 20 and len(words.known) <= held
    ids = dict(zip(every, words.ids_of(np.array(list(every), np.uint64)).tolist(), strict=True))
    of_ids = Counter()
    for h, n in every.items():
        of_ids[ids[h]] += n
    tokens = lm.cut(lm.tokenised(docs, words, 1), "test")
    model = lm.new_model(5)
    got = {r["doc_id"]: r for r in lm.scored(tokens, model, lm.open_logs(tokens, counts, words)).collect()}
    assert len(got) == docs.count()
    short = sorted((r for r in docs.collect() if r["text"]), key=lambda r: len(r["text"]))[:25]
    for r in short:
        hashes = word_hashes(r["text"]).tolist()
        row = [lm.VOCABULARY] * lm.REACH + [ids[h] for h in hashes] + [lm.VOCABULARY] * lm.REACH
        want = 0.0
        for i, h in enumerate(hashes):
            at = i + lm.REACH
            want += plain_log_probability(model, row[at], [row[at + o] for o in lm.OFFSETS])
            if ids[h] >= lm.SHARED:
                want += math.log(every[h]) - math.log(of_ids[ids[h]])
        assert got[r["doc_id"]]["n_tokens"] == len(hashes)
        assert abs(got[r["doc_id"]]["log_likelihood"] - want) < 1e-3 * max(1, len(hashes))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_entry_works_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('sigmill.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert len(names) > 100 and not any(n.startswith('op') for n in names) and 'pipeline' not in names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
