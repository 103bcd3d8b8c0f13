"""Toxicity scores by weak supervision.

1. Word and word-beginning features that toxic training rows hold far more often than clean ones make
   several lexicons.
2. Sixteen voters, each for one side or silent: lexicons, patterns of hits, patterns of the text.
3. A generative label model is fitted by expectation maximisation to how often each combination of votes
   occurs over *all* documents: at most 65,536 numbers. It estimates how often each voter speaks in either
   class and how voters of a class go together; voters that repeat each other are discounted.
4. A linear classifier on the features learns the model's posterior labels, and scores every text.

Labels enter from training rows only: in step 1, and in step 3 as rows whose class is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm import shingles
from sigmill.llm.common import arrow_map, blank, steps
from sigmill.session import cut

U = np.uint64
THRESHOLD = 0.7
#: A lexicon feature is in so many toxic training rows at least, whatever their number.
LEAST_ROWS = 3
#: Least log-odds, and least log-odds in standard errors, of a lexicon feature.
LEAST_ODDS, LEAST_ERRORS = 4.0, 2.6
#: Labelled training rows that the classifier is fitted on, about: all where there are fewer, else a share by hash.
SAMPLE_ROWS = 20_000
#: Training labels up to this number (16 bytes each) are sent to every task; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
BEGINNINGS = (4, 5, 6)
VOTERS = 16
#: The side each voter speaks for.
SIDES = np.array([1] * 12 + [0] * 4)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a row without an id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Features:
    """The features of a batch of texts: ``hash`` and the ``row`` each is in, with repeats."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = shingles.text_bytes(column)
        low = raw.copy()
        low[(raw >= 65) & (raw < 91)] += 32
        # Latin-1 capitals in UTF-8.
        second = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
        low[second] += 32
        start, end = shingles.spans(_LETTER[raw], offsets)
        hashes, row = shingles.Hashes(low), np.searchsorted(offsets, start, "right") - 1
        found = [(hashes.of(start, end), row)]
        for k in BEGINNINGS:
            longer = end - start > k
            found.append((shingles.mix(hashes.of(start[longer], start[longer] + k) + U(k)), row[longer]))
        self.hash = np.concatenate([h for h, _ in found])
        self.row = np.concatenate([r for _, r in found])
        self.kind = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
        self.rows = len(column)
        self.words = np.bincount(row, minlength=self.rows)
        sums = [np.concatenate([[0], np.cumsum(mask)]) for mask in (raw == 33, (raw >= 65) & (raw < 91), _LETTER[raw])]
        self.cries, self.capitals, self.letters = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)


class Known:
    """A sorted set of feature hashes with fast lookup."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes.astype(U))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hashes & U(0xFFFFF)).astype(np.int64)] = True

    def find(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, position in ``hashes``) pairs, sorted, and the kind of each."""
        maybe = np.flatnonzero(self.seen[(f.hash & U(0xFFFFF)).astype(np.int64)])
        h = f.hash[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        size = max(1, len(self.hashes))
        pair, first = np.unique(f.row[maybe[hit]] * size + at[hit], return_index=True)
        return pair // size, pair % size, f.kind[maybe[hit]][first]


def _counted(rows: DataFrame, known: Known | None) -> DataFrame:
    """``hash, kind, n``: rows that hold each feature (of ``known``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            f = Features(batch.column("text"))
            if known is None:
                order = np.lexsort((f.row, f.hash))
                h, r, k = f.hash[order], f.row[order], f.kind[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, k = h[new], k[new]
            else:
                _, at, k = known.find(f)
                h = known.hashes[at]
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(k[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["hash", "kind", "n"]
            )

    return arrow_map(rows.select(blank().alias("text")), run, "hash bigint, kind int, n bigint").groupBy("hash", "kind").agg(F.sum("n").alias("n"))


def lexicon(train: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and kinds of the features of toxic rows, sorted by hash, and the share of toxic rows.

    ``train``: ``text, toxic``. All rows count.
    """
    sizes = {bool(r["toxic"]): r["count"] for r in train.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic:
        return np.empty(0, U), np.empty(0, np.int64), 0.0
    often = _counted(train.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_ROWS)
    rest = _counted(train.filter("toxic = 0"), None).withColumnRenamed("n", "clean")
    t, c = F.col("n") + 0.5, F.coalesce("clean", F.lit(0)) + 0.5
    odds = F.log(t / (toxic + 1 - t)) - F.log(c / (clean + 1 - c))
    # All counts meet in Spark; only what enters the lexicon reaches the driver.
    kept = often.join(rest, ["hash", "kind"], "left").filter((odds >= LEAST_ODDS) & (odds / F.sqrt(1 / t + 1 / c) >= LEAST_ERRORS))
    found = kept.select("hash", "kind").toPandas()
    h = found["hash"].to_numpy(np.int64).view(U)
    order = np.argsort(h)
    return h[order], found["kind"].to_numpy(np.int64)[order], toxic / (toxic + clean)


def votes(f: Features, known: Known) -> np.ndarray:
    """A bit for each voter that speaks on a row."""
    row, at, kind = known.find(f)
    on = np.zeros((f.rows, VOTERS), dtype=bool)
    half = (known.hashes[at] >> U(40)).astype(np.int64) & 1
    on[row, 2 * kind + half] = True  # two lexicons of words, and two of each length of beginnings
    words_ = np.bincount(row[kind == 0], minlength=f.rows)
    starts = np.bincount(row[kind > 0], minlength=f.rows)
    hits = words_ + starts
    on[:, 8] = words_ >= 2
    on[:, 9] = starts >= 2
    on[:, 10] = hits * 40 >= np.maximum(f.words, 1)
    on[:, 11] = (f.cries >= 3) & (f.cries * 20 >= f.words)
    on[:, 12] = hits == 0
    on[:, 13] = (words_ == 0) & (f.words >= 20)
    on[:, 14] = (hits <= 1) & (f.words >= 200)
    on[:, 15] = (f.capitals * 3 < f.letters) & (f.cries == 0) & (hits == 0)
    return on @ (1 << np.arange(VOTERS))


def vote_counts(docs: DataFrame, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """How many documents gave each combination of votes; at most ``2 ** VOTERS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            v, n = np.unique(votes(Features(batch.column("text")), known), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(n.astype(np.int64))], ["votes", "n"])

    found = arrow_map(docs.select(blank().alias("text")), run, "votes int, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values("votes")
    return found["votes"].to_numpy(np.int64), found["n"].to_numpy(float)


class LabelModel:
    """Two classes; each voter speaks with a rate of its own in each, weighted by how far it repeats others."""

    def __init__(self, combos: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float, rounds: int = 60) -> None:
        """``counts``: rows without a training label by combination; ``known``: clean and toxic training rows."""
        on = (combos[:, None] >> np.arange(VOTERS)) & 1
        total = counts.sum() + known.sum()
        self.prior = min(max(prior, 1e-4), 0.5)
        overall = ((counts + known.sum(axis=0)) @ on + 0.5) / (total + 1)
        # At first a voter speaks more often in the class it speaks for.
        self.rate = np.array([np.clip(np.where(SIDES == c, overall * 1.5, overall * 0.5), 1e-6, 1 - 1e-6) for c in (0, 1)])
        self.weight = np.full(VOTERS, 0.5)
        self.correlation = np.zeros((2, VOTERS, VOTERS))
        for step in range(rounds):
            p = self.posterior_of(on)
            masses = [counts * (1 - p) + known[0], counts * p + known[1]]
            for c, mass in enumerate(masses):
                rate = (mass @ on + 0.1) / (mass.sum() + 0.2)
                self.rate[c] = np.clip(rate, 1e-6, 1 - 1e-6)
            # A voter may not change sides.
            wrong = np.where(SIDES == 1, self.rate[1] < self.rate[0], self.rate[0] < self.rate[1])
            self.rate[:, wrong] = self.rate[:, wrong].mean(axis=0)
            if step >= 5:
                self._correlate(on, masses)

    def _correlate(self, on: np.ndarray, masses: list[np.ndarray]) -> None:
        for c, mass in enumerate(masses):
            mass = mass / max(mass.sum(), 1e-9)
            mean = mass @ on
            cov = (on * mass[:, None]).T @ on - np.outer(mean, mean)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            self.correlation[c] = cov / np.outer(sd, sd)
        repeated = np.clip(self.correlation, 0, 1).mean(axis=0)
        np.fill_diagonal(repeated, 1)
        self.weight = 1 / repeated.sum(axis=1)

    def posterior_of(self, on: np.ndarray) -> np.ndarray:
        says = [np.log(r) * on + np.log(1 - r) * (1 - on) for r in self.rate]
        x = np.log(self.prior / (1 - self.prior)) + (says[1] - says[0]) @ self.weight
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def posterior(self, combos: np.ndarray) -> np.ndarray:
        return self.posterior_of((combos[:, None] >> np.arange(VOTERS)) & 1)


def fit_linear(row: np.ndarray, at: np.ndarray, label: np.ndarray, size: int, rounds: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features, by Adam over all rows at once."""
    w, b, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    n = max(1, len(label))
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[at], minlength=len(label))
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - label
        grad = np.append(np.bincount(at, g[row], minlength=size) / n + decay * w / np.sqrt(n), g.sum() / n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Scorer:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.known, self.weights, self.bias = Known(hashes), weights, bias

    def score(self, f: Features) -> np.ndarray:
        row, at, _ = self.known.find(f)
        z = self.bias + np.bincount(row, self.weights[at], minlength=f.rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``. Held-out and unlabelled rows give votes only.

    A row with a null label is unlabelled; an id labelled twice is toxic if either says so. Without toxic
    training rows every score is low.
    """
    marks = cut(labels.filter(~held_out()).filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "marks")
    few = marks.count() <= BROADCAST_LABELS
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id"), "training")
    hashes, _, prior = lexicon(rows)
    if not len(hashes):
        return Scorer(hashes, np.zeros(0), -3.0)
    known = Known(hashes)
    combos, counts = vote_counts(docs, known)
    labelled = np.zeros((2, len(combos)))
    for toxic in (0, 1):
        found, n = vote_counts(rows.filter(F.col("toxic") == toxic), known)
        labelled[toxic, np.searchsorted(combos, found)] = n
    model = LabelModel(combos, np.maximum(counts - labelled.sum(axis=0), 0), labelled, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            f = Features(batch.column("text"))
            label = model.posterior(votes(f, known))
            row, at, _ = known.find(f)
            ends = np.searchsorted(row, np.arange(f.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], ["label", "features"]
            )

    # A bounded sample of labelled rows, by the hash of the id: the same rows in whatever order they come.
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(rows.count(), 1))) < sample_rows)
    sample = arrow_map(chosen.select(blank().alias("text")), run, "label double, features array<int>").toPandas()
    sizes = np.array([len(x) for x in sample["features"]], np.int64)
    at = np.concatenate([np.asarray(x, np.int64) for x in sample["features"]]) if len(sample) else np.empty(0, np.int64)
    weights, bias = fit_linear(np.repeat(np.arange(len(sizes)), sizes), at, sample["label"].to_numpy(float), len(hashes))
    return Scorer(hashes, weights, bias)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score`` of every whole text; a null or empty one has no features and gets the lowest score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(Features(batch.column("text"))))], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", blank().alias("text")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per document. Equal texts have equal scores."""
    return scored(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    scorer = train(docs, labels)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        parts = [scorer.score(Features(b.column("text"))) for b in steps(iter(pa.table({"text": pa.array(text, pa.string(), from_pandas=True)}).to_batches()))]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.filter(score(blank()) < THRESHOLD)
