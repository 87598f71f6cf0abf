"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text is a row of words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased). A word has
hash buckets: its own, and those of its beginnings, as languages inflect. Buckets that enough
training documents hold have an embedding, the others share one of zeros; a word's embedding is the
sum over its buckets. Filters of several widths run over the embeddings of the whole text, the largest value of
each filter is kept, and a logistic layer makes the score. A threshold is calibrated for each
language on labelled rows that the training didn't see.

All labelled rows train. They are dealt to shards by a hash; in every epoch each shard trains on from the common
parameters in a task of its own, and the shards' results are averaged for the next epoch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import stage

from .common import fold, map_batches, mix, slices, span_hashes, text_bytes, words_of

BUCKET_BITS = 16
#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6, 8)
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 16
EPOCHS = 12
#: Rows and bytes of text of a shard, about; a text is in it whole.
SHARD_ROWS, SHARD_BYTES = 4000, 1 << 24
#: Labelled rows up to which texts are found by a broadcast of them.
BROADCAST_ROWS = 1_000_000
#: One in so many labelled rows calibrates the thresholds.
CALIBRATE = 5
#: Numbers in a row between tasks, when parameters are averaged.
PAGE = 1 << 14
#: Bounds of what ``sample`` takes: labelled rows of each class, and words of a row on average; texts are in it whole.
SAMPLE_ROWS = 3000
SAMPLE_WORDS = 3000
#: Texts of a training step.
STEP_TEXTS = 64
#: Buckets with an embedding at most, and the share of training documents that must hold one.
VOCABULARY = 20_000
LEAST_SHARE = 0.002
#: A language with fewer labelled rows of a class in the calibration part has the threshold of all.
LANGUAGE_ROWS = 15
FOLDS, HELD_OUT = 5, 0

#: Stands for a beginning that a word lacks; never has an embedding.
NO_BUCKET = 1 << BUCKET_BITS

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Zeros behind every text, so that no filter sees two; a filter that begins on them gives zero.
_PADS = max(WIDTHS) - 1


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (a row each; NO_BUCKET for a beginning it lacks), and each document's first word."""
    starts, ends, first = words_of(data, offsets, _SEPARATOR)
    out = np.full((len(starts), 1 + len(BEGINNINGS)), NO_BUCKET, np.int32)
    out[:, 0] = span_hashes(data, starts, ends, lower=True) >> np.uint64(64 - BUCKET_BITS)
    for column, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(ends - starts > n)
        begun = span_hashes(data, starts[long], starts[long] + n, lower=True)
        out[long, column] = mix(begun ^ np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)
    return out, first


@dataclass
class Model:
    """Row 0 of the embedding is for buckets without one and for what follows a text."""

    base: float
    rows: np.ndarray | None = None  # bucket to row
    embedding: np.ndarray | None = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width: (width, dimension, filter)
    filter_bias: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def padded(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of all words with _PADS zeros behind each text, and where each text begins."""
        counts = np.diff(first)
        begins = first[:-1] + _PADS * np.arange(len(counts))
        out = np.zeros((len(buckets) + _PADS * len(counts), buckets.shape[1]), np.int32)
        out[np.arange(len(buckets)) + _PADS * np.repeat(np.arange(len(counts)), counts)] = self.rows[buckets]
        return out, begins

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of texts given as buckets; every word counts, however long the text."""
        n = len(first) - 1
        if self.rows is None or n == 0:
            return np.full(n, self.base)
        words, begins = self.padded(buckets, first)
        pads = _pads(first)
        x = embed(self.embedding, words)
        pooled = []
        for width, own in self.filters.items():
            seen = convolve(x, own)
            seen[pads] = 0
            most = np.maximum.reduceat(seen, begins, axis=0)
            pooled.append(np.maximum(most + self.filter_bias[width], 0))
        logits = np.hstack(pooled) @ self.weights + self.bias + self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40).astype(np.float64)))


def _pads(first: np.ndarray) -> np.ndarray:
    """Places of the zeros behind the texts that begin at first."""
    return (first[1:] + _PADS * np.arange(len(first) - 1))[:, None] + np.arange(_PADS)


def embed(embedding: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = embedding[words[:, 0]]
    for column in range(1, words.shape[1]):
        x += embedding[words[:, column]]
    return x


def convolve(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    seen = x @ filters[0]
    for i in range(1, len(filters)):
        seen[:-i] += x[i:] @ filters[i]
    return seen


def sample(docs: DataFrame, labels: DataFrame, seed: int = 1) -> tuple[list, int, int]:
    """(text's buckets, label, language) of a bounded sample, and how many rows each class has.

    Only labelled rows outside the held-out fold; the rows of a class are taken in order of a hash
    of their id, each with its whole text, until they have SAMPLE_ROWS * SAMPLE_WORDS words; the
    text that reaches the bound is the last.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("hash"))

    def words_up_to(most: int | None):
        """The words of texts up to most words; of longer ones how many they have only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    buckets, first = buckets_of(*text_bytes(part.column("text")))
                    sizes = np.diff(first)
                    held = [
                        buckets[a:b].astype("<i4").tobytes() if most is None or b - a <= most else None
                        for a, b in zip(first[:-1], first[1:])
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in ("doc_id", "hash", "toxic", "lang")]
                        + [pa.array(sizes, pa.int64()), pa.array(held, pa.binary())],
                        ["doc_id", "hash", "toxic", "lang", "n", "words"],
                    )

        return run

    schema = "doc_id long, hash long, toxic int, lang string, n long, words binary"
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "hash", "toxic", "lang")
    rows = rows.mapInArrow(words_up_to(SAMPLE_WORDS), schema)
    got = rows.orderBy(order, "doc_id", "toxic", "words", "hash").limit(2 * SAMPLE_ROWS).collect()
    taken, room = [], {label: SAMPLE_ROWS * SAMPLE_WORDS for label in (0, 1)}
    for r in got:
        if room[r["toxic"]] > 0:
            taken.append(r)
            room[r["toxic"]] -= r["n"]
    long = {(r["doc_id"], r["hash"]) for r in taken if r["words"] is None}
    whole = {}
    if long:
        wanted = docs.sparkSession.createDataFrame(sorted(long), "doc_id long, hash long")
        rows = texts.join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
        rows = rows.select("doc_id", "text", "hash", F.lit(0).alias("toxic"), "lang")
        whole = {(r["doc_id"], r["hash"]): r["words"] for r in rows.mapInArrow(words_up_to(None), schema).toLocalIterator()}
    width = 1 + len(BEGINNINGS)
    data = []
    for r in taken:
        words = whole[r["doc_id"], r["hash"]] if r["words"] is None else r["words"]
        data.append((np.frombuffer(words, "<i4").reshape(-1, width), r["toxic"], r["lang"]))
    return data, sizes.get(1, 0), sizes.get(0, 0)


def steps(texts: list, most: int = STEP_TEXTS) -> Iterator[list]:
    """Parts of texts in order: at most so many texts and SAMPLE_WORDS words each on average; a longer one is alone."""
    part, n = [], 0
    for i, words in enumerate(texts):
        if part and (len(part) == most or n + len(words) > most * SAMPLE_WORDS):
            yield part
            part, n = [], 0
        part.append(i)
        n += len(words)
    if part:
        yield part


@dataclass
class Shard:
    """Training texts: the buckets of their different words, each text's words by their number there, and its label.

    copies: how many labelled rows a text stands for.
    """

    buckets: np.ndarray
    words: np.ndarray
    first: np.ndarray
    labels: np.ndarray
    copies: np.ndarray
    langs: list

    def __len__(self) -> int:
        return len(self.labels)

    def texts(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of some texts in a row, and where each begins (one more than texts)."""
        first = np.concatenate([[0], np.cumsum((self.first[1:] - self.first[:-1])[own])])
        return np.concatenate([np.zeros(0, np.int32), *[self.words[self.first[i] : self.first[i + 1]] for i in own]]), first

    def steps(self, order: np.ndarray) -> Iterator[np.ndarray]:
        sizes = np.diff(self.first)
        for part in steps([range(n) for n in sizes[order].tolist()]):
            yield order[part]

    def seen(self) -> np.ndarray:
        """For each label and bucket the rows that hold it."""
        out = np.zeros((2, NO_BUCKET + 1))
        for a in range(0, len(self), STEP_TEXTS):
            own = np.arange(a, min(a + STEP_TEXTS, len(self)))
            words, first = self.texts(own)
            held = np.zeros((len(own), NO_BUCKET + 1), bool)
            held[np.repeat(np.arange(len(own)), np.diff(first))[:, None], self.buckets[words]] = True
            for label in (0, 1):
                ours = self.labels[own] == label
                out[label] += self.copies[own][ours] @ held[ours]
        return out

    def scores(self, model: Model) -> np.ndarray:
        out = []
        for own in self.steps(np.arange(len(self))):
            words, first = self.texts(own)
            out.append(model.scores(self.buckets[words], first))
        return np.concatenate([np.zeros(0), *out])


def _distinct(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of buckets, and each row's number there."""
    if not len(buckets):
        return buckets, np.zeros(0, np.int32)
    rows = np.ascontiguousarray(buckets, np.int32)
    code = rows[:, 0].astype(np.uint64)
    for column in rows.T[1:]:
        code = mix(code) ^ column.astype(np.uint64)
    _, at, number = np.unique(code, return_index=True, return_inverse=True)
    return rows[at], number.astype(np.int32)


def shard_of(parts: Iterable[tuple[np.ndarray, np.ndarray]], labels, copies, langs) -> Shard:
    """A shard of texts whose buckets (and where each text begins) come in parts."""
    width = 1 + len(BEGINNINGS)
    different, numbers, sizes, n = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for buckets, first in parts:
        rows, number = _distinct(buckets)
        different.append(rows)
        numbers.append(number + np.int32(n))
        sizes.append(np.diff(first))
        n += len(rows)
    rows, number = _distinct(np.concatenate(different))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return Shard(rows, number[np.concatenate(numbers)], first, np.asarray(labels, np.int64), np.asarray(copies, np.float64), langs)


@dataclass
class State:
    """What an epoch hands on: parameters, second moments, and the number of steps."""

    p: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    step: float = 0.0

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.p, self.v) for x in d.values()] + [[self.step]])

    def filled(self, vector: np.ndarray) -> State:
        """A state of this shape with the numbers of a vector."""
        at, out = 0, []
        for d in (self.p, self.v):
            out.append({})
            for name, x in d.items():
                out[-1][name] = vector[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return State(*out, float(vector[at]))


def begin(model: Model, seen: np.ndarray, sizes: np.ndarray, seed: int) -> State:
    """Choose the buckets with an embedding, and where to start; sizes: training rows of class 0 and 1."""
    rng = np.random.default_rng(seed)
    seen = seen.copy()
    seen[:, NO_BUCKET] = 0
    both = seen.sum(0)
    least = max(2, LEAST_SHARE * sizes.sum())
    active = np.argsort(-both, kind="stable")[:VOCABULARY]
    active = active[both[active] >= least]
    model.rows = np.zeros(NO_BUCKET + 1, np.int32)
    model.rows[active] = 1 + np.arange(len(active))
    share = (seen[:, active] + 0.5) / (sizes[:, None] + 1)
    p = {"e": rng.normal(0, 0.1, (len(active) + 1, DIMENSIONS))}
    p["e"][1:, 0] = np.log(share[1] / share[0]) / 4  # where to start: which class holds the word
    p["e"][0] = 0
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["w"], p["c"] = rng.normal(0, 0.3, FILTERS * len(WIDTHS)), np.zeros(1)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return State(p, {k: np.zeros_like(v) for k, v in p.items()})


def train_epoch(state: State, rows: np.ndarray, shard: Shard, weights: np.ndarray, epoch: int, seed) -> State:
    """One pass over a shard, from a state that stays as it is; weights: of a row of class 0 and 1."""
    p, v = ({k: x.copy() for k, x in d.items()} for d in (state.p, state.v))
    m, step, own_step = {k: np.zeros_like(x) for k, x in p.items()}, state.step, 0  # first moments forget within ten steps
    rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
    table = np.concatenate([rows[shard.buckets], np.zeros((1, 1 + len(BEGINNINGS)), np.int32)])  # the last is a pad
    weight = weights[shard.labels] * shard.copies
    for own in shard.steps(np.random.default_rng(seed).permutation(len(shard))):
        words, first = shard.texts(own)
        begins = first[:-1] + _PADS * np.arange(len(own))
        padded = np.full(len(words) + _PADS * len(own), len(table) - 1, np.int32)
        padded[np.arange(len(words)) + _PADS * np.repeat(np.arange(len(own)), np.diff(first))] = words
        grads = _gradients(p, table, padded, begins, _pads(first), shard.labels[own], weight[own])
        step, own_step = step + 1, own_step + 1
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**own_step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        p["e"][0] = 0
    return State(p, v, step)


def finish(model: Model, state: State, positives: int, negatives: int) -> None:
    p = state.p
    model.embedding = p["e"]
    model.filters = {w: p[f"f{w}"] for w in WIDTHS}
    model.filter_bias = {w: p[f"b{w}"] for w in WIDTHS}
    model.weights, model.bias = p["w"], float(p["c"][0])
    # trained as if both classes were equally frequent
    model.shift = float(np.log(max(positives, 1) / max(negatives, 1)))


def train(data: list, positives: int, negatives: int, seed: int = 1) -> Model:
    """Fit the classifier on rows at hand (see sample); without both classes every score is the share of class 1."""
    total = positives + negatives
    model = Model(base=positives / total if total else 0.0)
    if len({label for _, label, _ in data}) < 2:
        return model
    rng = np.random.default_rng(seed)
    shuffled = [data[i] for i in rng.permutation(len(data))]
    cut = max(len(data) // CALIBRATE, 1)
    held, fit = shuffled[:cut], shuffled[cut:]
    if len({label for _, label, _ in fit}) < 2:
        held, fit = [], shuffled
    held, fit = (
        shard_of(((w, np.array([0, len(w)])) for w, _, _ in part), [c for _, c, _ in part], np.ones(len(part)), [x for *_, x in part])
        for part in (held, fit)
    )
    sizes = np.bincount(fit.labels, minlength=2)
    state = begin(model, fit.seen(), sizes, seed)
    for epoch in range(EPOCHS):
        state = train_epoch(state, model.rows, fit, len(fit) / (2 * sizes), epoch, [seed, epoch])
    finish(model, state, positives, negatives)
    sampled = [sum(label == c for _, label, _ in data) for c in (0, 1)]
    weights = np.array([negatives / sampled[0], positives / sampled[1]])
    calibrate(model, _binned(held.scores(model), held.labels, weights[held.labels], held.langs))
    return model


def _gradients(
    p: dict, table: np.ndarray, words: np.ndarray, begins: np.ndarray, pads: np.ndarray, labels: np.ndarray, weight: np.ndarray
) -> dict:
    """table: embedding rows of each word; words: numbers there, with pads. A word's embedding is made once a step."""
    n, counts = len(begins), np.diff([*begins, len(words)])
    text = np.repeat(np.arange(n), counts)
    used = np.zeros(len(table), bool)
    used[words] = True
    number = np.cumsum(used) - 1
    table, words = table[used], number[words]
    x = embed(p["e"], table)
    pooled, peaks = [], []
    for w in WIDTHS:
        own = p[f"f{w}"]
        seen = (x @ own[0])[words]
        for i in range(1, w):
            seen[:-i] += (x @ own[i])[words[i:]]
        seen[pads] = 0
        most = np.maximum.reduceat(seen, begins, axis=0)
        place, unit = np.nonzero(seen == np.repeat(most, counts, axis=0))
        _, keep = np.unique(text[place] * FILTERS + unit, return_index=True)  # the first of equals
        peaks.append((place[keep], unit[keep]))
        pooled.append(most + p[f"b{w}"])
    h = np.hstack(pooled)
    on = h > 0
    logits = (np.where(on, h, 0) @ p["w"] + p["c"]).astype(np.float64)
    error = ((1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels) * weight / n).astype(np.float32)
    grads = {"w": np.where(on, h, 0).T @ error + np.float32(1e-4) * p["w"], "c": np.array([error.sum()])}
    back = error[:, None] * p["w"] * on
    at, moved = [], []
    for k, w in enumerate(WIDTHS):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads[f"b{w}"] = own.sum(0)
        place, unit = peaks[k]
        g = own[text[place], unit]
        grads[f"f{w}"] = np.zeros_like(p[f"f{w}"])
        for i in range(w):
            inside = place + i < len(words)
            a, u, gi = words[place[inside] + i], unit[inside], g[inside]
            by_unit = np.zeros((len(u), FILTERS), np.float32)
            by_unit[np.arange(len(u)), u] = gi
            grads[f"f{w}"][i] = x[a].T @ by_unit
            at.append(a)
            moved.append(by_unit @ p[f"f{w}"][i].T)
    word, moved = _summed(np.concatenate(at), np.concatenate(moved))
    rows = table[word]
    row, moved = _summed(rows.T.ravel(), np.tile(moved, (rows.shape[1], 1)))
    grads["e"] = np.float32(1e-5) * p["e"]
    grads["e"][row] += moved
    return grads


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values[order], first, axis=0)


#: Thresholds that are tried.
GRID = np.arange(0.2, 0.81, 0.02)


def _binned(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list) -> dict[tuple[str, int], tuple]:
    """For each language and label its rows, and their weight by how many thresholds a score reaches."""
    out: dict[tuple[str, int], tuple] = {}
    names, number = np.unique(np.array([lang or "" for lang in langs], object).astype(str), return_inverse=True)
    reached = np.searchsorted(GRID, scores, "right")
    for i, name in enumerate(names):
        for label in (0, 1):
            own = (number == i) & (labels == label)
            if own.any():
                weight = np.bincount(reached[own], weights[own], minlength=len(GRID) + 1)
                out[str(name), label] = (int(own.sum()), weight)
    return out


def calibrate(model: Model, binned: dict[tuple[str, int], tuple], rest: tuple = ()) -> None:
    """Per language the threshold of the best F1 on rows unseen in training, of equals the nearest to 0.5.

    Rows of a weight, as the scores carry the prior of all labelled rows, not that of a sample. rest: rows and
    weights by label of languages that aren't in binned.
    """
    none = (0, np.zeros(len(GRID) + 1))
    if not binned and not rest:
        return
    both = [[x for (_, c), x in binned.items() if c == label] + [x for c, x in rest if c == label] + [none] for label in (0, 1)]
    everything = [sum(weight for _, weight in own) for own in both]
    model.threshold = _best(*everything) if sum(n for n, _ in both[1]) else 0.5
    for lang in {lang for lang, _ in binned}:
        clean, toxic = (binned.get((lang, label), none) for label in (0, 1))
        if min(clean[0], toxic[0]) >= LANGUAGE_ROWS:
            model.thresholds[lang] = _best(clean[1], toxic[1])


def _best(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The best threshold by the weights of both classes, by how many thresholds a score reaches."""
    caught, wrong = (np.cumsum(x[::-1])[::-1][1:] for x in (toxic, clean))
    f1 = 2 * caught / np.maximum(caught + wrong + toxic.sum(), 1e-12)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[best[np.argmin(np.abs(GRID[best] - 0.5))]])


def labelled(docs: DataFrame, labels: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """All labelled rows outside the held-out fold, as (doc_id, toxic, copies); and with text, lang and ``held``,
    which marks those that calibrate."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id", FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("copies"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(CALIBRATE)) == 0
    known = stage(known.withColumn("held", held))
    few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known  # of more Spark decides
    rows = docs.select("doc_id", "text", "lang", F.octet_length("text").alias("size")).join(few, "doc_id")
    return known, rows.select("doc_id", "text", "lang", "toxic", "copies", "held", "size")


_KEY = ["held", "shard", "doc_id", "toxic", "lang", "text"]
SHARDS = "held boolean, shard long, buckets binary, words binary, first binary, labels binary, copies binary, langs array<string>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch once, with their number."""
    for batch in batches:
        once = pa.Table.from_batches([batch]).group_by(_KEY).aggregate([("copies", "sum")])
        yield from once.rename_columns([*_KEY, "copies"]).combine_chunks().to_batches()


def _shard(table: pa.Table) -> pa.Table:
    """The rows of a shard as one row; equal rows once, in an order of their own."""
    table = table.group_by(_KEY).aggregate([("copies", "sum")]).sort_by([(c, "ascending") for c in _KEY]).combine_chunks()
    parts = (buckets_of(*text_bytes(p.column("text"))) for batch in table.to_batches() for p in slices(batch))
    langs = table.column("lang").to_pylist()
    own = shard_of(parts, table.column("toxic").to_numpy(), table.column("copies_sum").to_numpy(), langs)
    held = [x.tobytes() for x in (own.buckets, own.words, own.first, own.labels, own.copies)]
    columns = [table.column(c)[:1].combine_chunks() for c in ("held", "shard")]
    columns += [pa.array([x], pa.binary()) for x in held] + [pa.array([langs], pa.list_(pa.string()))]
    return pa.Table.from_arrays(columns, ["held", "shard", "buckets", "words", "first", "labels", "copies", "langs"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
            kinds = {"buckets": np.int32, "words": np.int32, "first": np.int64, "labels": np.int64, "copies": np.float64}
            own = {c: np.frombuffer(row.column(c)[0].as_buffer(), kind) for c, kind in kinds.items()}
            own["buckets"] = own["buckets"].reshape(-1, 1 + len(BEGINNINGS))
            yield row.column("shard")[0].as_py(), Shard(*own.values(), row.column("langs")[0].as_py())


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = sum((shard.seen() for _, shard in _shards(batches)), np.zeros((2, NO_BUCKET + 1)))
    label, bucket = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(bucket), pa.array(seen[label, bucket])], ["label", "bucket", "n"])


def _averaged(key: tuple, pages: pa.Table) -> pa.Table:
    """The mean of the tasks' pages, each by its weight."""
    weights, total = pages.column("weight").to_pylist(), 0
    for weight, numbers in zip(weights, pages.column("numbers")):
        total = total + np.frombuffer(numbers.as_buffer(), np.float32).astype(np.float64) * weight
    mean = total / sum(weights)
    return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "numbers": pa.array([mean.tobytes()], pa.binary())})


def epoch_of_all(shards: DataFrame, state: State, rows: np.ndarray, weights: np.ndarray, epoch: int, seed: int) -> State:
    """An epoch of every shard from one state, and the mean of what they come to, by their numbers of rows."""
    sent = shards.sparkSession.sparkContext.broadcast((state, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = sent.value
        total, weight = np.zeros(len(state.vector())), 0.0
        for number, shard in _shards(batches):
            total += train_epoch(state, rows, shard, weights, epoch, [seed, epoch, number]).vector() * len(shard)
            weight += len(shard)
        if weight:
            own = (total / weight).astype(np.float32)
            pages = [own[i : i + PAGE].tobytes() for i in range(0, len(own), PAGE)]
            columns = [pa.array(range(len(pages)), pa.int64()), pa.array([weight] * len(pages)), pa.array(pages, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page", "weight", "numbers"])

    trained = shards.mapInArrow(run, "page long, weight double, numbers binary")
    pages = trained.groupBy("page").applyInArrow(_averaged, "page long, numbers binary").collect()  # one state, cut up
    sent.unpersist()
    return state.filled(np.concatenate([np.frombuffer(r["numbers"], np.float64) for r in sorted(pages, key=lambda r: r["page"])]))


def calibrate_on(model: Model, shards: DataFrame) -> None:
    """Thresholds from all rows of shards; the driver gets sums by language, of languages with enough rows."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in _shards(batches):
            found = _binned(shard.scores(sent.value), shard.labels, shard.copies, shard.langs)
            rows = [(lang, c, i, float(x)) for (lang, c), (_, weight) in found.items() for i, x in enumerate(weight) if x]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, ["lang", "label", "reached", "weight"])

    sums = shards.mapInArrow(run, "lang string, label long, reached long, weight double")
    sums = stage(sums.groupBy("lang", "label", "reached").agg(F.sum("weight").alias("weight")))
    rows = lambda label: F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0))
    enough = sums.groupBy("lang").agg(F.least(rows(0), rows(1)).alias("n")).where(F.col("n") >= LANGUAGE_ROWS).select("lang")
    binned: dict[tuple[str, int], tuple] = {}
    for r in sums.join(enough, "lang").collect():
        n, weight = binned.setdefault((r["lang"], r["label"]), (0, np.zeros(len(GRID) + 1)))
        weight[r["reached"]] = r["weight"]
        binned[r["lang"], r["label"]] = (n + int(r["weight"]), weight)
    rest: dict[int, tuple] = {}
    for r in sums.join(enough, "lang", "left_anti").groupBy("label", "reached").agg(F.sum("weight").alias("weight")).collect():
        n, weight = rest.setdefault(r["label"], (0, np.zeros(len(GRID) + 1)))
        weight[r["reached"]] = r["weight"]
        rest[r["label"]] = (n + int(r["weight"]), weight)
    calibrate(model, binned, tuple(rest.items()))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 1) -> Model:
    """Fit the classifier on all labelled rows outside the held-out fold; without both classes every score is
    the share of class 1. The driver gets counts by bucket and averaged parameters, of one size whatever the input."""
    known, rows = labelled(docs, labels, seed)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.sum("copies").alias("n")).collect()}
    negatives, positives = counts.get(0, 0), counts.get(1, 0)
    total = positives + negatives
    model = Model(base=positives / total if total else 0.0)
    size = F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    found = rows.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("n"), size).collect()
    if len({r["toxic"] for r in found}) < 2:
        return model
    if len({r["toxic"] for r in found if not r["held"]}) < 2:
        rows = rows.withColumn("held", F.lit(False))
    sizes = np.zeros(2)
    for r in found:
        if not r["held"] or len({x["toxic"] for x in found if not x["held"]}) < 2:
            sizes[r["toxic"]] += r["n"]
    most = max(1, -(-sum(r["rows"] for r in found) // SHARD_ROWS), -(-sum(r["bytes"] for r in found) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(most)).alias("shard")
    dealt = rows.select("held", shard, "doc_id", "toxic", "lang", "text", "copies")
    dealt = dealt.mapInArrow(_merged, dealt.schema)
    shards = stage(dealt.groupBy("held", "shard").applyInArrow(_shard, SHARDS))
    own = shards.where("not held")
    seen = np.zeros((2, NO_BUCKET + 1))
    sums = own.mapInArrow(_seen, "label long, bucket long, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # a number for each label and bucket
        seen[r["label"], r["bucket"]] = r["n"]
    state = begin(model, seen, sizes, seed)
    for epoch in range(EPOCHS):
        state = epoch_of_all(own, state, model.rows, sizes.sum() / (2 * sizes), epoch, seed)
    finish(model, state, positives, negatives)
    calibrate_on(model, shards.where("held"))
    return model


def _judge(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch's texts, and the threshold of each row's language."""
    scores = model.scores(*buckets_of(*text_bytes(batch.column("text"))))
    langs = [lang or "" for lang in batch.column("lang").to_pylist()]
    return scores, np.array([model.thresholds.get(lang, model.threshold) for lang in langs])


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, threshold (of the row's language) and toxic (score >= threshold), a row each.

    A null text counts as empty and is scored like any other; a null or unseen language has the
    threshold of all; repeated rows and ids are kept; other columns are not looked at. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, thresholds = _judge(sent.value, batch)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores), pa.array(thresholds), pa.array(scores >= thresholds)],
            ["doc_id", "score", "threshold", "toxic"],
        )

    return map_batches(
        docs.select("doc_id", "text", "lang"), run, "doc_id long, score double, threshold double, toxic boolean"
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, thresholds = _judge(sent.value, batch)
        return batch.filter(pa.array(scores < thresholds))

    return map_batches(docs, run, docs.schema)
