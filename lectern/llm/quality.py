"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

A text is the square roots of the shares of its hashed byte pairs, and the share of words that repeat
one of the few before them. A linear model is fitted to
trusted positives and unlabelled web text so that the unbiased estimate of the logistic risk is
least; the part of the risk that stands for the negatives is kept from falling below zero. The class prior
is estimated from the same two samples. No negative label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, mix, slices, span_hashes, text_bytes, words_of

PAIRS = 2048
#: How far back a word is looked for.
LAGS = (1, 2, 3)
FEATURES = PAIRS + len(LAGS)
#: Bounds of the training sample, rows of each kind.
POSITIVES = 3000
UNLABELLED = 5000
STEPS = 400
FOLDS, HELD_OUT = 4, 2
#: A score from which a text counts as good.
THRESHOLD = 0.7
#: The share of positives that a cut must leave above it to count in the estimate of the prior.
LEAST_SHARE = 0.2

_BIN = (mix(np.arange(65536, dtype=np.uint64) + np.uint64(0x51ED270B)) % np.uint64(PAIRS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text; an empty text is all zeros."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) > 1:
        text = np.repeat(np.arange(n), sizes)
        pairs = _BIN[data[:-1].astype(np.int64) << 8 | data[1:]]
        inside = text[:-1] == text[1:]
        counts = np.bincount((text[:-1] * PAIRS + pairs)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / np.maximum(sizes - 1, 1)[:, None])
        starts, ends, first = words_of(data, offsets)
        words, counts = span_hashes(data, starts, ends), np.diff(first)
        text = np.repeat(np.arange(n), counts)
        for column, lag in enumerate(LAGS, PAIRS):
            again = (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])
            out[:, column] = np.bincount(text[lag:][again], minlength=n) / np.maximum(counts, 1)
    return out


@dataclass
class Model:
    prior: float
    weights: np.ndarray | None = None
    bias: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features of a bounded sample: trusted positives outside the held-out fold, and any rows at all.

    Rows are taken in order of a hash of their id; whole texts are used.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    trusted = labels.where("quality = 1 and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    trusted = trusted.select("doc_id").orderBy(order, "doc_id").limit(POSITIVES)
    any_rows = docs.select("doc_id").where("doc_id is not null")
    any_rows = any_rows.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(UNLABELLED)
    marks = trusted.withColumn("positive", F.lit(True)).union(any_rows.withColumn("positive", F.lit(False))).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*text_bytes(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["doc_id", "positive", "x"],
                )

    rows = texts.mapInArrow(run, "doc_id long, positive boolean, x binary")
    rows = rows.orderBy(order, "doc_id", "positive", "x").limit(POSITIVES + UNLABELLED).collect()
    take = lambda mark: np.array(
        [np.frombuffer(r["x"], np.float16) for r in rows if r["positive"] == mark], np.float32
    ).reshape(-1, FEATURES)
    return take(True), take(False)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Least risk by Adam. prior None: the plain risk of telling positives from unlabelled rows."""
    w, b = np.zeros(positive.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        # derivative of log(1 + e^-z) is sigmoid(z) - 1, of log(1 + e^z) it is sigmoid(z)
        gp, gu = (sigmoid(zp) - 1) / len(zp), sigmoid(zu) / len(zu)
        if prior is not None:
            as_negative = sigmoid(zp) / len(zp)
            negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # below zero the model fits noise: then only that part is undone
            gp, gu = (prior * (gp - as_negative), gu) if negatives >= 0 else (prior * as_negative, -gu)
        g = np.append(positive.T @ gp + unlabelled.T @ gu + 1e-5 * w, gp.sum() + gu.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled scores.

    Above any cut the unlabelled rows hold at least the prior's share of the positives' share, so
    the least ratio of the two shares, over cuts that leave enough positives, bounds it well.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - LEAST_SHARE, 60))
    slack = np.sqrt(np.log(100) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5) / 2
    ratios = [((unlabelled >= c).mean(), (positive >= c).mean()) for c in cuts]
    best = min(ratios, key=lambda r: (r[0] + slack) / r[1])
    return float(np.clip(best[0] / best[1], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Without positives or unlabelled rows every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(0.5)
    # the prior from rows that the first model didn't see
    first = _descend(positive[::2], unlabelled[::2], None)
    seen = positive[1::2] if len(positive) > 1 else positive
    others = unlabelled[1::2] if len(unlabelled) > 1 else unlabelled
    prior = estimate_prior(seen @ first[0] + first[1], others @ first[0] + first[1])
    w, b = _descend(positive, unlabelled, prior)
    return Model(prior, w.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document's whole text, a row each.

    A null text counts as empty and is scored like any other; repeated rows and ids are kept;
    other columns are not looked at. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = sent.value.scores(features(*text_bytes(batch.column("text"))))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"]
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of a score of at least threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = sent.value.scores(features(*text_bytes(batch.column("text"))))
        return batch.filter(pa.array(scores >= threshold))

    return map_batches(docs, run, docs.schema)
