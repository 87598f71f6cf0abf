"""Substring dedup: words covered by a window of words that also begins elsewhere.

A window's least gram hash (its minimizer) depends on its words only, so equal windows have the
same one. Neighbouring windows with one minimizer are a segment. A segment that is alone with its minimizer and
stands once holds no repeated window, so minimizers are counted first, and a filter lets through the segments of those that
stand twice. Equal ones are counted; different ones go to the shard of their minimizer, equal ones once, with their number. A shard builds a compressed FM-index of its segments and streams them through it by
backward search; matching statistics tell the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import stage

from .collocations import Filter, filter_of
from .common import gram_hashes, map_batches, mix, slices, span_hashes, text_bytes, words_of
from .fmindex import repeated_windows

WINDOW, GRAM = 35, 8
#: Words of a shard, about.
SHARD_WORDS = 1_000_000
#: A minimizer with more different segments has no shard: its windows are counted one by one.
SEGMENTS = 10_000
#: A segment with more copies than COPIES and than one in COMMON of all is marked where texts are read, not joined.
COPIES, COMMON = 100, 10_000

_BASE = np.uint64(0xA24BAED4963EE407)


def _minimizers(grams: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost least gram in every run of size grams."""
    place, span = np.arange(len(grams)), 1
    while span < size:
        step = min(span, size - span)
        left, right = place[:-step], place[step:]
        place = np.where(grams[left] <= grams[right], left, right)
        span += step
    return place


def segments_of(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word within it, windows, minimizer, digest) of the segments of a block of texts."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(words) < window:
        return none
    grams = gram_hashes(words, GRAM)
    place = _minimizers(grams, window - GRAM + 1)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)[: len(place)]
    inside = np.arange(len(place)) + window <= first[1:][text]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new & inside)
    if not len(begins):
        return none
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    n = ends - begins
    powers = np.full(len(words) + 1, _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1])])
    inverse = np.full(len(words) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    digest = mix((sums[ends + window - 1] - sums[begins]) * inverse[begins] + n.astype(np.uint64))
    return text[begins], begins - first[text[begins]], n, grams[place[begins]], digest


def keyed(docs: DataFrame) -> DataFrame:
    """The text with its key: rows of equal text have one key, and one result."""
    return docs.select(F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"), "text").where("text <> ''")


def _names(mini: np.ndarray, segment: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for a segment, to look it up in a list of a bounded size."""
    return mix(mini.view(np.uint64) ^ mix(segment.view(np.uint64) + n.astype(np.uint64)))


def _listed(names: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which names are in listed, which is sorted."""
    if not len(listed):
        return np.zeros(len(names), bool)
    return listed[np.minimum(np.searchsorted(listed, names), len(listed) - 1)] == names


def segment_table(
    docs: DataFrame,
    window: int,
    common: np.ndarray = np.zeros(0, np.uint64),
    asked: Broadcast[Filter] | None = None,
    minis: Broadcast[Filter] | None = None,
) -> DataFrame:
    """All segments but those named in common and those that, or whose minimizers, are surely not asked for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        starts, ends, first = words_of(data, offsets)
        text, start, n, mini, digest = segments_of(span_hashes(data, starts, ends), first, window)
        if minis is not None:
            held = minis.value(mini.view(np.uint64))
            text, start, n, mini, digest = (x[held] for x in (text, start, n, mini, digest))
        if asked is not None:
            rare = asked.value(mini.view(np.uint64) ^ digest.view(np.uint64)) & ~_listed(_names(mini, digest, n), common)
            text, start, n, mini, digest = (x[rare] for x in (text, start, n, mini, digest))
        at = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(at),
                batch.column("size").take(at),
                pa.array(start.astype(np.int32)),
                pa.array(n.astype(np.int8)),
                pa.array(mini.view(np.int64)),
                pa.array(digest.view(np.int64)),
            ],
            ["key", "size", "start", "n", "mini", "segment"],
        )

    schema = "key long, size int, start int, n byte, mini long, segment long"
    return map_batches(keyed(docs), run, schema)


def _with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (key, size, start, n, ...) with the segment's word hashes, read from the texts again, for each row
    of wanted; texts of one key are read once a task."""
    rest = [c for c in wanted.columns if c not in ("key", "size")]
    lists = wanted.groupBy("key", "size").agg(F.collect_list(F.struct(*rest)).alias("wanted"))
    texts = keyed(docs).join(lists, ["key", "size"]).select("text", "wanted", "key", "size")
    kinds = "key long, size int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in rest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        starts, ends, first = words_of(data, offsets)
        words = span_hashes(data, starts, ends)
        lists = batch.column("wanted")
        each = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        owner = first[:-1][each]
        flat = lists.flatten()
        start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
        held = [words[a : a + m + window - 1].astype("<u8").tobytes() for a, m in zip(owner + start, n)]
        arrays = [batch.column(c).take(pa.array(each)) for c in ("key", "size")]
        arrays += [flat.field(c) for c in rest] + [pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "size", *rest, "words"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("size").to_pylist()))
            first = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
            if first:
                yield from map(run, slices(batch.take(pa.array(first))))

    return texts.mapInArrow(once, kinds + ", words binary")


def _search(group: pd.DataFrame, window: int) -> pd.DataFrame:
    group = group.drop_duplicates(["mini", "segment", "n"]).sort_values(["mini", "segment"], ignore_index=True)
    rows = [np.frombuffer(w, "<u8") for w in group["words"]]
    group["mask"] = repeated_windows(rows, group["copies"].to_numpy(), window)
    return group.loc[(group["mask"] != 0) & (group["copies"] == 1), ["key", "size", "start", "mask"]]


def _counted(segments: DataFrame, window: int) -> DataFrame:
    """As _search, of segments whose minimizer has too many: equal windows are counted by their hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["key", "size", "start", "mini", "copies", "window", "i"]
        out: list[list] = [[] for _ in names]
        rows = (batch.column(c).to_pylist() for c in (*names[:5], "words"))
        for *own, words in zip(*rows):
            for i, h in enumerate(gram_hashes(np.frombuffer(words, "<u8"), window).view(np.int64).tolist()):
                for column, value in zip(out, (*own, h, i)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "key long, size int, start int, mini long, copies long, window long, i int"
    windows = segments.mapInArrow(lambda batches: map(run, batches), schema)
    twice = windows.groupBy("mini", "window").agg(F.sum("copies").alias("c")).where("c >= 2").drop("c")
    bit = F.expr("shiftleft(1L, i)")
    alone = windows.where("copies = 1").join(twice, ["mini", "window"])
    return alone.groupBy("key", "size", "start").agg(F.bit_or(bit).alias("mask"))


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, np.ndarray]:
    """(key, size, spans): of every text with repeated windows, their first words as (start, mask); and the
    names of the segments that are too common to be listed by place, which are repeated wherever they stand.
    """
    if not GRAM < window < GRAM + 62:
        raise ValueError("a segment's windows must fit a mask of 62 bits")
    per_mini = segment_table(docs, window).groupBy("mini").agg(F.count("*").alias("n")).where("n >= 2")
    minis = docs.sparkSession.sparkContext.broadcast(filter_of(per_mini.select(F.col("mini").alias("hash"))))  # as asked below
    # equal segments meet on the map side; nothing is joined before they have
    distinct = segment_table(docs, window, minis=minis).groupBy("mini", "segment", "n")
    distinct = distinct.agg(F.count("*").alias("copies"), F.min(F.struct("key", "size", "start")).alias("at"))
    distinct = stage(distinct.select("at.key", "at.size", "at.start", "n", "mini", "segment", "copies"))
    per_mini = distinct.groupBy("mini").agg(F.count("*").alias("segments"), F.sum(F.col("n") + window - 1).alias("words"))
    per_mini = stage(per_mini.where("segments >= 2"))
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    most = max(COPIES, total // COMMON)  # so that at most COMMON segments have more
    found = distinct.where(F.col("copies") > most).select("mini", "segment", "n").collect()
    column = lambda c, kind: np.array([r[c] for r in found], kind)
    common = np.sort(_names(column("mini", np.int64), column("segment", np.int64), column("n", np.int64)))
    words = per_mini.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    different = distinct.join(per_mini.select("mini", F.when(F.col("segments") > SEGMENTS, True).alias("many")), "mini")
    different = different.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards)))
    masks = (
        _with_words(docs, different.where("many is null").drop("many"), window)
        .select("shard", "key", "size", "start", "n", "mini", "segment", "copies", "words")
        .groupBy("shard")
        .applyInPandas(lambda g: _search(g, window), "key long, size int, start int, mask long")
    )
    if not per_mini.where(F.col("segments") > SEGMENTS).isEmpty():
        many = _with_words(docs, different.where("many").drop("many", "shard"), window)
        masks = masks.union(_counted(stage(many.dropDuplicates(["mini", "segment", "n"])), window))
    masks = stage(masks)
    # a segment that stands once has its place with its mask; one that stands twice is repeated as a whole
    twice = distinct.where(F.col("copies").between(2, most)).select("mini", "segment", "n")
    passes = filter_of(twice.select(F.col("mini").bitwiseXOR(F.col("segment")).alias("hash")))
    asked = docs.sparkSession.sparkContext.broadcast(passes)  # of a fixed size; the join decides
    others = segment_table(docs, window, common, asked).join(twice, ["mini", "segment", "n"])
    spans = others.select("key", "size", "start", F.expr("shiftleft(1L, n) - 1").alias("mask")).union(masks)
    spans = spans.groupBy("key", "size", "start").agg(F.max("mask").alias("mask"))
    return spans.groupBy("key", "size").agg(F.collect_list(F.struct("start", "mask")).alias("spans")), common


def covered(n: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edges = np.zeros(n + 1, np.int64)
    for bit in range(64 - GRAM):
        own = starts[(masks >> bit & 1) == 1] + bit
        np.add.at(edges, own, 1)
        np.add.at(edges, own + window, -1)
    return np.cumsum(edges)[:n] > 0


def _kept(batch: pa.RecordBatch, window: int, common: np.ndarray):
    """For each text of a batch: its words' bytes (begin, end), and which stay; None: no word goes."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = words_of(data, offsets)
    spans = batch.column("spans")
    text, place, whole = (np.zeros(0, np.int64),) * 3
    if len(common):
        text, place, n, mini, digest = segments_of(span_hashes(data, starts, ends), first, window)
        known = _listed(_names(mini, digest, n), common)
        text, place, whole = text[known], place[known], (1 << n[known]) - 1
    edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        own, marks = slice(first[i], first[i + 1]), slice(edges[i], edges[i + 1])
        start, mask = place[marks], whole[marks]
        if spans[i].is_valid:
            flat = spans[i].values
            listed = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "mask"))
            start, mask = (np.concatenate(x) for x in zip((start, mask), listed))
        stays = ~covered(first[i + 1] - first[i], start, mask, window) if len(start) else None
        yield data, starts[own], ends[own], stays


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stays: np.ndarray | None) -> bytes:
    """The words that stay, joined by one space."""
    if stays is not None:
        starts, ends = starts[stays], ends[stays]
    if not len(starts):
        return b""
    raw = data[starts[0] : ends[-1]].tobytes()
    base = starts[0]
    return b" ".join([raw[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist())])


def _joined_to_spans(docs: DataFrame, window: int) -> tuple[DataFrame, np.ndarray]:
    found, common = repeats(docs, window)
    found = found.select(F.col("key").alias("_key"), F.col("size").alias("_size"), "spans")
    rows = docs.withColumns({"_k": F.xxhash64("text"), "_s": F.octet_length("text")})
    return rows.join(found, (F.col("_k") == F.col("_key")) & (F.col("_s") == F.col("_size")), "left"), common


def digest_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), a row each.

    A null text has no words; texts shorter than a window lose nothing; repeated rows lose their
    windows in every copy; an empty table gives no rows; other columns are not looked at.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, removed, digests = [], [], []
        for data, starts, ends, stays in _kept(batch, window, common):
            words.append(len(starts))
            removed.append(0 if stays is None else int((~stays).sum()))
            digests.append(hashlib.sha256(_joined(data, starts, ends, stays)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    joined, common = _joined_to_spans(docs.select("doc_id", "text"), window)
    return map_batches(joined.select("doc_id", "text", "spans"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words gone from text (the rest joined by one space), all columns kept.

    A text that loses nothing stays as it is; one that loses all words becomes empty. n_chars, if
    there, is counted anew.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, (data, starts, ends, stays) in enumerate(_kept(batch, window, common)):
            if stays is not None and not stays.all():
                texts[i] = _joined(data, starts, ends, stays).decode()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    joined, common = _joined_to_spans(rows, window)
    out = map_batches(joined.select("row", "text", "spans"), run, rows.schema)
    columns = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.alias(c) for c, value in columns.items()])
