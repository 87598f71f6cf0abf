"""Phrases of two to four words by score, per language, counted exactly.

First pass: Misra-Gries summaries find which n-grams may be frequent. The hashes of n-grams fall into
partitions, contiguous ranges of about equal mass (occurrences). A partition's summary has more counters than
its mass divided by the threshold, on the map side as after merging, so what it takes off a count stays below the
threshold and no frequent n-gram goes. An n-gram enters only if its parts passed before, by a filter
of a fixed size, which may let more through but never less. Second pass: what survived is counted
exactly, by its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.staging import stage

from .common import gram_hashes, mix, span_hashes, text_bytes, words_of

THRESHOLD, LONGEST, TOP = 30, 4, 2000
#: Bits of an n-gram's hash that name its bin; partitions are runs of bins.
BIN_BITS = 14
#: Counters of a partition, about, and those that a task holds before it gives them on.
COUNTERS, HELD = 1 << 19, 1 << 21
#: Counters in a row between tasks.
PAGE = 1024
#: Bits of a filter's place: it has 8 MB, whatever the input.
FILTER_BITS = 26
#: Text of a block.
BYTES = 1 << 21

_DELIMITER = np.zeros(256, bool)
_DELIMITER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PARTING = _DELIMITER.copy()
_PARTING[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Summary:
    """A mergeable Misra-Gries summary: counters by hash, sorted, and what has been taken off in each partition.

    edges: first hash of each partition but the first; capacity: counters of each.
    """

    def __init__(self, edges: np.ndarray, capacity: np.ndarray):
        self.edges, self.capacity = edges, capacity
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.error = np.zeros(len(capacity), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.buffered = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.buffered += len(hashes)
        if self.buffered > max(1 << 19, len(self.hashes) // 2):
            self.merge()

    def merge(self) -> None:
        hashes = np.concatenate([self.hashes, *[h for h, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.buffered = [], 0
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
        self.hashes = hashes[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self._fit()

    def _fit(self) -> None:
        """Take the same off all counters of a partition until it fits its capacity."""
        bounds = np.concatenate([[0], np.searchsorted(self.hashes, self.edges), [len(self.hashes)]])
        over = np.flatnonzero(np.diff(bounds) > self.capacity)
        if not len(over):
            return
        keep = np.ones(len(self.hashes), bool)
        for p in over:
            own = slice(bounds[p], bounds[p + 1])
            counts, k = self.counts[own], int(self.capacity[p])
            off = np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]  # the largest but k
            self.error[p] += off
            counts -= off
            keep[own] = counts > 0
        self.hashes, self.counts = self.hashes[keep], self.counts[keep]

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, hashes, "right")

    def taken(self) -> tuple[np.ndarray, ...]:
        """(partition, hash, count, error) rows of all counters and errors; the summary is empty afterwards."""
        if self.waiting:
            self.merge()
        wrong = np.flatnonzero(self.error)
        part = np.concatenate([self.part_of(self.hashes), wrong])
        none, zero = np.zeros(len(wrong), np.uint64), np.zeros(len(self.hashes), np.int64)
        counts = np.append(self.counts, np.zeros(len(wrong), np.int64))
        out = part, np.append(self.hashes, none), counts, np.append(zero, self.error[wrong])
        self.__init__(self.edges, self.capacity)
        return out


class Filter:
    """Which hashes may be in a set: two bits each in a bitmap of a fixed size."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.width) - 1)
        out = np.ones(len(hashes), bool)
        for shift in (0, self.width):
            place = (hashes >> np.uint64(shift)) & mask
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def filter_of(hashes: DataFrame) -> Filter:
    """A filter of the column hash. The driver gets the bitmap only, of one size whatever the input."""
    mask = (1 << FILTER_BITS) - 1
    place = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(mask)) for s in (0, FILTER_BITS)]))
    places = hashes.select(place.alias("place"))
    page = F.shiftright("place", 15).alias("page")
    pages = places.groupBy(page).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(max((1 << FILTER_BITS) // 8, 4096), np.uint8)
    for row in pages.toLocalIterator():
        bits[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, FILTER_BITS)


class Block:
    """Words of a block of texts: their bytes, hashes (with the language's) and which follow each other in a piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        self.data = _LOWER[data]
        self.starts, self.ends, first = words_of(self.data, offsets, _PARTING)
        self.document = np.repeat(np.arange(batch.num_rows), np.diff(first))
        language = batch.column("language").to_numpy(zero_copy_only=False).view(np.uint64)
        self.words = mix(span_hashes(self.data, self.starts, self.ends) ^ language[self.document])
        delimiters = np.concatenate([[0], np.cumsum(_DELIMITER[self.data])])
        same = (delimiters[self.starts[1:]] == delimiters[self.ends[:-1]]) & (self.document[1:] == self.document[:-1])
        self.follows = [np.ones(len(self.words), bool), same]

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one piece."""
        while len(self.follows) < n:
            k = len(self.follows)
            self.follows.append(self.follows[k - 1][:-1] & self.follows[1][k - 1 :] if len(self.words) > k else np.zeros(0, bool))
        return self.follows[n - 1]

    def grams(self, n: int) -> np.ndarray:
        return gram_hashes(self.words, n)

    def strings(self, n: int, places: np.ndarray) -> pa.Array:
        """The n words from each of places on, joined by spaces."""
        inside = ~_PARTING[self.data]
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        raw = pa.py_buffer(self.data[inside].tobytes())
        words = pa.LargeStringArray.from_buffers(len(self.words), pa.py_buffer(ends.astype(np.int64)), raw)
        parts = [words.take(pa.array(places + i)) for i in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        offsets = text_bytes(batch.column("text"))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            part = batch.slice(start, end - start)
            yield part, Block(part)
            start = end


def _phrases(part: pa.RecordBatch, block: Block, n: int, hashes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """(lang, phrase, hash, n) of the distinct ones of these n-grams."""
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    at = places[first]
    lang = part.column("lang").take(pa.array(block.document[at]))
    columns = [lang, block.strings(n, at).cast(pa.string()), pa.array(hashes[first].view(np.int64)), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "hash", "n"])


def _words_and_masses(docs: DataFrame, longest: int) -> tuple[DataFrame, np.ndarray]:
    """Every language's words with their counts, and the occurrences of n-grams by length and bin."""
    bins = 1 << BIN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = np.zeros((longest + 1, bins), np.int64)
        for part, block in _blocks(batches):
            yield _phrases(part, block, 1, block.words, np.arange(len(block.words)))
            for n in range(2, longest + 1):
                own = block.grams(n)[block.whole(n)]
                masses[n] += np.bincount((own >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=bins)
        length, at = np.nonzero(masses)
        # no word is null: these rows are masses, their place in hash
        columns = [pa.nulls(len(at), pa.string())] * 2 + [pa.array(length * bins + at), pa.array(masses[length, at])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "hash", "n"])

    counted = docs.mapInArrow(run, "lang string, phrase string, hash long, n long").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
    counted = stage(counted)
    masses = np.zeros((longest + 1, bins), np.int64)
    for row in counted.where("phrase is null").collect():  # at most a row for each length and bin
        masses[row["hash"] // bins, row["hash"] % bins] = row["n"]
    return counted.where("phrase is not null"), masses


def _partitions(mass: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bins of about COUNTERS counters: first hash of each but the first, and its capacity."""
    need = np.cumsum(mass) // (threshold * COUNTERS)
    first = np.flatnonzero(np.append(False, need[1:] != need[:-1]))
    edges = first.astype(np.uint64) << np.uint64(64 - BIN_BITS)
    sums = np.add.reduceat(mass, np.append(0, first))
    return edges, sums // threshold + 1


def survivors(docs: DataFrame, lengths: range, mass: np.ndarray, threshold: int, passes) -> DataFrame:
    """hash of every n-gram of these lengths that may occur threshold times; the others in it don't matter.

    passes(block, n) tells which of the block's n-grams enter.
    """
    edges, capacity = _partitions(mass, threshold)
    kind = "part int, hashes binary, counts binary, error long"

    def rows(taken: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """A partition's counters by PAGE in a row."""
        part, hashes, counts, error = taken
        bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        starts = [i for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(part)]) for i in range(a, b, PAGE)]
        pages = [(a, min(b, a + PAGE)) for a, b in zip(starts, [*starts[1:], len(part)])]
        for k in range(0, len(pages), 256):
            own = pages[k : k + 256]
            held = [pa.array([x[a:b].tobytes() for a, b in own], pa.binary()) for x in (hashes, counts)]
            wrong = pa.array([int(error[a:b].sum()) for a, b in own], pa.int64())
            columns = [pa.array([int(part[a]) for a, _ in own], pa.int32()), *held, wrong]
            yield pa.RecordBatch.from_arrays(columns, ["part", "hashes", "counts", "error"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(edges, capacity)
        for _, block in _blocks(batches):
            for n in lengths:
                own = np.sort(block.grams(n)[passes(block, n)])
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
                held.add(own[first], np.diff(np.append(first, len(own))))
            if len(held.hashes) > HELD:
                yield from rows(held.taken())
        yield from rows(held.taken())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(edges, capacity)
        error = np.zeros(len(capacity), np.int64)
        for batch in batches:
            np.add.at(error, batch.column("part").to_numpy(), batch.column("error").to_numpy())
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                hashes, counts = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                real = counts > 0
                held.add(hashes[real], counts[real])
        held.merge()
        error += held.error
        some = held.counts + error[held.part_of(held.hashes)] >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(held.hashes[some].view(np.int64))], ["hash"])

    dealt = docs.mapInArrow(summaries, kind).repartition(len(capacity), "part")
    return stage(dealt.mapInArrow(merged, "hash long"))


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all words, and of all phrases of two to longest words that occur threshold times."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").withColumn("language", F.xxhash64("lang"))
    words, masses = _words_and_masses(rows.where("text <> ''"), longest)
    rows, share = rows.where("text <> ''"), docs.sparkSession.sparkContext.broadcast
    common = share(filter_of(words.where(F.col("n") >= threshold).select("hash")))

    def both(block: Block, n: int) -> np.ndarray:
        known = common.value(block.words)
        return block.whole(2) & known[:-1] & known[1:]

    pairs = share(filter_of(survivors(rows, range(2, 3), masses[2], threshold, both)))

    def chained(block: Block, n: int) -> np.ndarray:
        """All pairs of neighbours within the n words passed."""
        known = pairs.value(block.grams(2)) & block.whole(2)
        out = block.whole(n).copy()
        for i in range(n - 1):
            out &= known[i : i + len(out)]
        return out

    chains = None
    if longest > 2:
        chains = share(filter_of(survivors(rows, range(3, longest + 1), masses[3:].sum(0), threshold, chained)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches):
            for n in range(2, longest + 1):
                places = np.flatnonzero(chained(block, n))
                hashes = block.grams(n)[places]
                if n > 2:
                    passed = chains.value(hashes)
                    places, hashes = places[passed], hashes[passed]
                yield _phrases(part, block, n, hashes, places)

    exact = rows.mapInArrow(run, "lang string, phrase string, hash long, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words.select("lang", "phrase", "n"), stage(exact.where(F.col("n") >= threshold))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are split at . , ; : ! ? and line ends into pieces, and those at spaces and tabs into words. a is how often a
    phrase occurs within pieces, l and r how often the first and the second part of its lowest-scoring cut do, n is the
    number of words of the language; the score is floor(2000000 a / (l + r)), of equal cuts the first counts. A phrase inside a longer
    one that has at least 80 of 100 of its occurrences is dropped. Order: score, a (descending), phrase by bytes.

    Null texts are empty, a null lang is `und` together with that language itself; repeated rows count each time;
    an empty table gives no rows; other columns aren't looked at.
    """
    words, phrases = frequent(docs.select("lang", "text"), threshold, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    counts = words.where(F.col("n") >= threshold).union(phrases).select("lang", F.col("phrase").alias("part"), "n")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("w")).alias("rest"))
    cut = cut.join(counts.withColumnsRenamed({"part": "head", "n": "l"}), ["lang", "head"])
    cut = cut.join(counts.withColumnsRenamed({"part": "rest", "n": "r"}), ["lang", "rest"])
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + r)").alias("score")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("low"))
    # phrases within longer candidates: a place and a length for each
    inner = F.expr(
        "flatten(transform(sequence(2, size(w) - 1), s -> transform(sequence(1, size(w) - s + 1), i -> array_join(slice(w, i, s), ' '))))"
    )
    within = candidates.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(
        F.expr("longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * 80")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "low.l", "low.r", "n", "low.score")
