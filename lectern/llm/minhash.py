"""MinHash near-dedup with SetSketch registers.

A document's set is the distinct hashes of its word shingles. Of every register the least of
exponentially distributed hashes counts, on an exponential scale: K = floor(1 - log_b(min)), cut
off below and above. Registers of a union are the larger ones, so sketches merge. Equal sets are
one class from the start. Classes that agree in all registers of a band are candidates: each with
the first of its bucket, and then, among classes that buckets hold together, those of the smaller
components with all others. The Jaccard similarity of a candidate is first estimated jointly, by
maximum likelihood over greater, smaller and equal registers, and what may reach the threshold is
verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.staging import stage

from .common import gram_hashes, map_batches, mix, slices, span_hashes, text_bytes, words_of
from .components import components

#: Registers, those of a band, and the base of the scale; two bytes hold a register.
REGISTERS, BAND, BASE, LARGEST = 128, 4, 1.001, 65534
RATE = 20.0
SHINGLE, PERCENT = 5, 80
#: Candidates whose estimate lies so far below the threshold go: five deviations of the estimate.
MARGIN = 0.18
#: So many ids and digests at most go to every executor (about 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes of a block; a task compares two blocks.
BLOCK = 2000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sets_of(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words [^\\x20\\x09-\\x0D]+, A-Z lower-cased.

    Fewer words than a shingle are one shingle as a whole; a text without words has none.
    """
    data, offsets = text_bytes(texts)
    starts, ends, first = words_of(data, offsets)
    words = span_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _points(hashes: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps first to first + n of each element's Poisson process: waiting times, and registers hit."""
    k = (np.arange(first + 1, first + n + 1, dtype=np.uint64) * _GOLDEN)[None, :]
    bits = mix(hashes[:, None] ^ k)
    wait = -np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / (RATE * REGISTERS)
    return wait, (mix(bits + _GOLDEN) % np.uint64(REGISTERS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, a row each; an empty set has zeros.

    An element's hashes for all registers come as one process of rising values, each of which hits
    a register, so only values that can still be a minimum are made: below a limit that falls
    with the set's size. Sets with a register left open go on to a higher limit.
    """
    least = np.full((len(sets), REGISTERS), np.inf)
    sizes = np.array([len(s) for s in sets], np.int64)
    todo = np.flatnonzero(sizes)
    limit = np.zeros(len(sets))
    limit[todo] = (np.log(REGISTERS) + 8) / (RATE * sizes[todo])
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        hashes = np.concatenate([sets[i] for i in todo])
        time = np.zeros(len(hashes))
        done, n = 0, 1
        while len(hashes):
            wait, register = _points(hashes, done, n)
            times = time[:, None] + np.cumsum(wait, 1)
            element, step = np.nonzero(times < limit[owner][:, None])
            np.minimum.at(least, (owner[element], register[element, step]), times[element, step])
            go_on = times[:, -1] < limit[owner]
            hashes, owner, time = hashes[go_on], owner[go_on], times[go_on, -1]
            done += n
            n = min(2 * n, 256, max(1, (1 << 20) // max(len(hashes), 1)))
        todo = todo[np.isinf(least[todo]).any(1)]
        limit[todo] *= 2
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    filled = sizes > 0
    out[filled] = np.clip(np.floor(1 - np.log(least[filled]) / np.log(BASE)), 0, LARGEST + 1)
    return out


def likelihood_jaccard(u: np.ndarray, v: np.ndarray, greater: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimate of J from set sizes and how many registers of u are greater or smaller.

    For J, a register of u is greater with probability p(x - yJ) and smaller with p(y - xJ), where
    x and y are the shares of the sizes and p(z) = -log_b(1 - z (b - 1) / b).
    """
    x, y = u / (u + v), v / (u + v)
    equal = REGISTERS - greater - smaller
    p = lambda z: -np.log1p(-z * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(x - y * j), 1e-12), np.maximum(p(y - x * j), 1e-12)
        return greater * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(x)), np.minimum(x / y, y / x)
    golden = (5**0.5 - 1) / 2
    for _ in range(20):
        left, right = high - golden * (high - low), low + golden * (high - low)
        up = value(left) < value(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def may_link(n1: np.ndarray, n2: np.ndarray, greater: np.ndarray, smaller: np.ndarray, percent: int) -> np.ndarray:
    """Not ruled out by the sizes, nor by the joint estimate with its margin."""
    sizes = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    estimate = likelihood_jaccard(n1.astype(float), n2.astype(float), greater, smaller)
    return sizes & (estimate >= percent / 100 - MARGIN)


def sketch_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128-bit digest of the set; null if empty) and sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(batch.column("text"), shingle)
        registers = sketches(sets)
        digests = [
            None
            if not len(s)
            else mix(s).sum(dtype=np.uint64).tobytes() + mix(s ^ _GOLDEN).sum(dtype=np.uint64).tobytes()
            for s in sets
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([r.astype("<u2").tobytes() for r in registers], pa.binary()),
            ],
            ["doc_id", "text_hash", "n_shingles", "set_id", "sketch"],
        )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(
        rows, run, "doc_id long, text_hash long, n_shingles long, set_id binary, sketch binary"
    )


def bands_of(classes: DataFrame) -> DataFrame:
    """(band, set_id): a hash of each band's registers and its number, a row per band and class."""
    width = 2 * BAND
    keys = [
        F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(REGISTERS // BAND)
    ]
    return classes.select(F.explode(F.array(*keys)).alias("band"), "set_id")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that may link, by sizes and sketches."""
    side = lambda c: classes.select(
        F.col("set_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.array(batch.column(c).to_pylist()) for c in ("na", "nb"))
            s, t = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
                for c in ("sa", "sb")
            )
            keep = may_link(a, b, (s > t).sum(1), (s < t).sum(1), percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(set_id, items): the full sets of the classes in nodes; one document of each is read again."""
    wanted = stage(
        nodes.select("set_id")
        .distinct()
        .join(classes, "set_id")
        .select("set_id", F.col("first.doc_id").alias("of"), F.col("first.text_hash").alias("hash"))
    )
    if wanted.count() <= BROADCAST_ROWS:  # then the texts stay where they are
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = rows.join(wanted, rows.text_hash.eqNullSafe(wanted.hash) & rows.doc_id.eqNullSafe(wanted.of))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [s.astype("<u8").tobytes() for s in sets_of(batch.column("text"), shingle)]
        return pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(held, pa.binary())], ["set_id", "items"])

    sets = map_batches(found.select("set_id", "text"), run, "set_id binary, items binary")
    return stage(sets.dropDuplicates(["set_id"]))


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other full sets are similar enough to one."""
    sizes = np.array([len(o) for o in others], np.int64)
    items = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, items), len(one) - 1)
    shared = np.add.reduceat((one[at] == items).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= percent * (len(one) + sizes - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ia, ib = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in ("ia", "ib"))
            keep = [bool(_similar(a, [b], percent)[0]) for a, b in zip(ia, ib)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("items").alias(f"i{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib")
    return both.mapInArrow(compare, "a binary, b binary")


def _join_rest(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the minor classes of a group with the classes of other components beside them.

    Candidates share a band and aren't ruled out by the estimate; all of them are verified, but
    those that links of this call have joined already.
    """
    group = group.sort_values(["minor", "set_id"], ascending=[False, True], ignore_index=True)
    s = np.frombuffer(b"".join(group["sketch"]), "<u2").reshape(-1, REGISTERS)
    n, root = group["n_shingles"].to_numpy(), pd.factorize(group["root"])[0]
    sets = [np.frombuffer(x, "<u8") for x in group["items"]]
    minors = int(group["minor"].sum())
    found: list[tuple[int, int]] = []
    for k in range(minors):
        other = np.flatnonzero(root != root[k])
        other = other[100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k])]
        same = s[other] == s[k]
        other = other[same.reshape(len(other), REGISTERS // BAND, BAND).all(2).any(1)]
        if not len(other):
            continue
        t = s[other]
        keep = may_link(np.full(len(other), n[k]), n[other], (s[k] > t).sum(1), (s[k] < t).sum(1), percent)
        other = other[keep]
        if not len(other):
            continue
        for c in other[_similar(sets[k], [sets[o] for o in other], percent)]:
            if root[c] != root[k]:
                found.append((k, c))
                root[root == root[c]] = root[k]
    ids = group["set_id"].to_numpy()
    return pd.DataFrame({"a": [ids[a] for a, _ in found], "b": [ids[b] for _, b in found]}, dtype=object)


def _rest(placed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What the first members of buckets didn't connect.

    placed: set_id, group (classes that buckets hold together, directly or through others), root
    (the component so far). In a group of several components the largest is the major one; every
    class of the others, the minor ones, meets every class of the group in blocks, so a task holds
    two blocks at most, and the large component isn't compared within itself.
    """
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("group").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("major"), F.count("*").alias("roots")
    )
    shape = stage(
        shape.where("roots > 1").select(
            "group",
            F.col("major.root").alias("major"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
            F.ceil((F.col("n") - F.col("major.n")) / BLOCK).cast("int").alias("minor_blocks"),
        )
    )
    open_ = stage(placed.join(shape, "group"))
    minor, code = F.col("root") != F.col("major"), F.xxhash64("set_id")
    every = open_.withColumn("minor", F.lit(False)).withColumn("j", F.pmod(code, "all_blocks").cast("int"))
    every = every.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)))
    some = open_.where(minor).withColumn("minor", F.lit(True))
    some = some.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    some = some.withColumn("i", F.pmod(code, "minor_blocks").cast("int"))
    columns = ["group", "i", "j", "set_id", "root", "minor"]
    dealt = every.select(*columns).union(some.select(*columns)).groupBy("group", "i", "j", "set_id", "root")
    dealt = dealt.agg(F.max("minor").alias("minor")).join(
        classes.select("set_id", "n_shingles", "sketch"), "set_id"
    ).join(sets, "set_id")
    return dealt.groupBy("group", "i", "j").applyInPandas(
        lambda g: _join_rest(g, percent), "a binary, b binary"
    )


def _rooted(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and root (one for each component; null without words), a row per document."""
    seen = stage(sketch_table(docs, shingle))
    classes = stage(
        seen.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.max("n_shingles").alias("n_shingles"),
            F.max("sketch").alias("sketch"),
        )
    )
    bands = bands_of(classes)
    buckets = stage(
        bands.groupBy("band").agg(F.min("set_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    )
    stars = bands.join(buckets, "band").where("a <> set_id").select("a", F.col("set_id").alias("b"))
    stars = stage(stars.distinct())
    pairs = stage(_estimated(stars, classes, percent))
    sets = _sets(stars.select(F.explode(F.array("a", "b")).alias("set_id")), classes, docs, shingle)
    links = stage(_verified(pairs, sets, percent))
    roots = components(links)
    held = components(stars).select(F.col("node").alias("set_id"), F.col("root").alias("group"))
    placed = held.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = stage(placed.withColumn("root", F.coalesce("root", "set_id")))
    more = stage(_rest(placed, classes, sets, percent))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    named = seen.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    return named.select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "set_id").alias("root"))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id, a row per document.

    Documents link if 100 * intersection >= percent * union of their shingle sets; component_id is
    the least doc_id reachable. Documents without words (or a null text) link with nothing and are
    their own component. A null doc_id takes part; it is named by the least other id of its
    component, or null. Rows of equal doc_id are told apart by their text only. An empty table
    gives no rows; other columns are not looked at.
    """
    named = _rooted(docs, shingle, percent)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns; documents without words all stay.

    It is a row of the least doc_id, of equal ids the least text_hash; a null doc_id comes last. Of
    rows that repeat both any one stays.
    """
    found = _rooted(docs, shingle, percent).where("root is not null")
    found = stage(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marks = found.join(first, "root").select(
        F.col("doc_id").alias("_of"), F.col("text_hash").alias("_of_hash"), stays.alias("_stays"), "n"
    )
    marks = stage(marks.where("not _stays or n > 1").drop("n"))
    gone, again = marks.where("not _stays"), marks.where("_stays")
    own = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_of_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.xxhash64("text").alias("_hash"))
    kept = rows.join(gone, own, "left_anti")
    if not again.isEmpty():  # repeats meet after each task has kept one of its own
        one = rows.join(again, own, "left_semi").dropDuplicates(["doc_id", "_hash"])
        kept = kept.join(again, own, "left_anti").union(one)
    return kept.select("_row.*")
