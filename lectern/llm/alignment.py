"""Alignment of a byte-level BPE (A) and a sentencepiece BPE (B) over whole texts.

Short texts are one range of bytes each; a longer one is cut into ranges at multiples of CHUNK bytes, spread over
tasks, and its fragments are composed by a tree. How many documents hold an id pair linked is counted
over all documents, then looked up for the pairs of each block of documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.staging import stage

from .common import text_bytes
from .fragments import B_IDS, Fragment, Whole, compose, finish, of_tokens, unit_starts

#: Bytes of a range; a text above it is composed of several.
CHUNK = 1 << 16
#: Children of a node of the reduction tree.
FAN = 8
#: Documents and bytes of a block.
ROWS, BYTES = 4096, 1 << 20
#: Bytes that a worker remembers of units, about; a block's own come on top.
REMEMBERED = 1 << 25
#: Units tokenised at once: the objects of their tokens are far larger than the ids. Blocks read or written at once.
TOKENISED, BLOCKS_HELD = 2048, 16

_BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "sha array<string>, codes array<long>, docs array<int>, at array<int>, times array<int>, first array<int>"
)
_PART = (
    "row long, doc_id long, part long, sound boolean, cut boolean, n_a long, n_b long, n_groups long, closed string, "
    "prefix array<array<long>>, suffix array<array<long>>, codes array<long>, times array<long>"
)


def _bytes_of_a(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; printable bytes stand for themselves there, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {chr(b): b for b in plain}
    value |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
    return out


def _bytes_of_b(model) -> list[bytes]:
    out = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] numbers, then those of begin[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Table:
    """Rows of bytes, laid out one after the other."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.data[_ragged(self.begin[rows], self.size[rows])]


class Store:
    """Arrays of units, growing at their end: numbers of tokens and groups, codes of links, groups as text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.numbers = np.zeros((0, 3), np.int64)
        self.sound = np.zeros(0, bool)
        self.codes, self.code_at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text, self.text_at = bytearray(), np.zeros(1, np.int64)

    def bytes(self) -> int:
        return 200 * len(self.known) + 8 * len(self.codes) + len(self.text)

    def add(self, units: list[bytes], numbers, sound, codes, n_codes, text, n_text) -> None:
        first = len(self.sound)
        self.known.update(zip(units, range(first, first + len(units))))
        self.numbers, self.sound = np.concatenate([self.numbers, numbers]), np.concatenate([self.sound, sound])
        self.codes = np.concatenate([self.codes, codes])
        self.code_at = np.concatenate([self.code_at, self.code_at[-1] + np.cumsum(n_codes)])
        self.text += text
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(n_text)])


class Pair:
    """Both tokenizers, and the units they have met. A unit begins with a space, as texts do for both."""

    _held: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.table_a, self.table_b = Table(_bytes_of_a(self.a)), Table(_bytes_of_b(self.b))
        if len(self.table_b.size) > B_IDS:
            raise ValueError("too many pieces for the code of a pair")
        most = max(len(self.table_a.size), len(self.table_b.size))
        #: Ids in decimals, each with room for what parts it from the next.
        self.decimals = Table([b"%d;" % i for i in range(most)])
        pieces = map(self.b.id_to_piece, range(len(self.table_b.size)))
        #: Where a piece goes over a word's end a text is one unit.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.store = Store()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Pair:
        if paths not in cls._held:
            cls._held[paths] = cls(*paths)
        return cls._held[paths]

    def tokens(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """(sound, ids of A, tokens of A in each unit, the same of B) of units; an unsound one, whose
        tokens' bytes aren't the unit's, has none."""
        texts = [u.decode() for u in units]
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        of_a = lambda part: [x.ids for x in encode(part, add_special_tokens=False)]
        of_b = lambda part: self.b.encode([t[1:] for t in part], num_threads=1)
        sizes = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        begin = np.cumsum(sizes) - sizes
        sound = np.ones(len(units), bool)
        flat, counts = [], []
        for of, table in ((of_a, self.table_a), (of_b, self.table_b)):
            n, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(texts), TOKENISED):
                part = of(texts[at : at + TOKENISED])
                n.append(np.array([len(x) for x in part], np.int64))
                ids.append(np.fromiter((i for x in part for i in x), np.int64, int(n[-1].sum())))
            n, ids = np.concatenate(n), np.concatenate(ids)
            held = np.diff(np.concatenate([[0], np.cumsum(table.size[ids])])[np.concatenate([[0], np.cumsum(n)])])
            same = held == sizes
            some = np.repeat(same, n)
            differs = table.take(ids[some]) != data[_ragged(begin[same], sizes[same])]
            wrong = np.add.reduceat(np.append(differs, False), np.cumsum(sizes[same]) - sizes[same]) > 0 if same.any() else np.zeros(0, bool)
            same[np.flatnonzero(same)[wrong]] = False
            sound &= same
            flat.append(ids)
            counts.append(n)
        for k in (0, 1):
            flat[k] = flat[k][np.repeat(sound, counts[k])]
            counts[k] = counts[k] * sound
        return sound, flat[0], counts[0], flat[1], counts[1]

    def ends(self, sound, a, b, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the tokens of A and of B in the bytes of the sound units, and where those units end."""
        return np.cumsum(self.table_a.size[a]), np.cumsum(self.table_b.size[b]), np.cumsum(sizes * sound)

    def learn(self, units: list[bytes]) -> None:
        """Add units to the store: all their groups and links at once."""
        sound, a, n_a, b, n_b = self.tokens(units)
        ends_a, ends_b, unit_ends = self.ends(sound, a, b, np.array([len(u) for u in units], np.int64))
        n = int(unit_ends[-1]) + 1 if len(unit_ends) else 1
        at_a, at_b = np.zeros(n, bool), np.zeros(n, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        before_a, before_b, before = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(at_a & at_b)
        links = np.flatnonzero(at_a | at_b)
        codes = a[before_a[links - 1]] * B_IDS + b[before_b[links - 1]]
        n_codes = np.diff(np.searchsorted(links, np.concatenate([[0], unit_ends]), "right"))
        n_groups = np.diff(np.concatenate([[0], before[unit_ends]]))
        # tokens in the order of the groups' text: a group's of A, then its of B
        group_a, group_b = before[ends_a - 1], before[ends_b - 1]
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        ids, parted = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        same = lambda g: np.append(g[1:] == g[:-1], False)[: len(g)]
        parted[place_a] = np.where(same(group_a), ord(","), ord("|"))
        parted[place_b] = np.where(same(group_b), ord(","), ord(";"))
        text = self.decimals.take(ids)
        text_ends = np.cumsum(self.decimals.size[ids])
        text[text_ends - 1] = parted
        tokens = np.cumsum(n_a + n_b)
        n_text = np.diff(np.concatenate([[0], text_ends])[np.concatenate([[0], tokens])])
        self.store.add(units, np.column_stack([n_a, n_b, n_groups]), sound, codes, n_codes, text.tobytes(), n_text)

    def slots(self, units: list[bytes]) -> np.ndarray:
        """Places of units in the store."""
        if self.store.bytes() > REMEMBERED:
            self.store = Store()
        new = [u for u in units if u not in self.store.known]
        if new:
            self.learn(new)
        known = self.store.known
        return np.array([known[u] for u in units], np.int64)


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a space and each text, and where each begins; a null or empty text has none."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    full = sizes > 0
    new = np.concatenate([[0], np.cumsum(sizes + full)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new[:-1][full]] = False
    out[inside] = data
    return out, new


def _units(data: np.ndarray, offsets: np.ndarray, pair: Pair) -> tuple[np.ndarray, pa.Array]:
    """Start of each unit, and the units as dictionary-encoded bytes."""
    starts = unit_starts(data, offsets) if pair.apart else np.unique(offsets[offsets < len(data)])
    ends = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    return starts, units.dictionary_encode()


def _block(ids: pa.Array, wholes: list, codes: np.ndarray, at: np.ndarray, times: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """A block's row: its documents' numbers, and for each (from first on) the places of its pairs in codes and their links."""
    columns = [pa.array([uuid.uuid4().int >> 65], pa.int64())]
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())))
    columns += [one([w[k] for w in wholes], pa.int64()) for k in range(4)]
    columns.append(one([w[4] for w in wholes], pa.string()))
    held = np.bincount(at, minlength=len(codes))
    columns += [one(codes, pa.int64()), *[one(x.astype(np.int32), pa.int32()) for x in (held, at, times, first)]]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])


def _short(batch: pa.RecordBatch, pair: Pair) -> pa.RecordBatch:
    """The block of texts of one range each: their units are closed on both sides, so they only follow each other."""
    data, offsets = _spaced(batch.column("text"))
    starts, units = _units(data, offsets, pair)
    slots = pair.slots(units.dictionary.to_pylist())
    store, rows = pair.store, batch.num_rows
    index = units.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(rows), np.diff(np.searchsorted(starts, offsets)))
    unsound = np.zeros(rows, bool)
    unsound[text[~store.sound[slots[index]]]] = True
    keep = ~unsound[text]
    index, text = index[keep], text[keep]
    edges = np.searchsorted(text, np.arange(rows + 1))
    summed = lambda x: np.diff(np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])[edges], axis=0)
    sizes = store.code_at[slots + 1] - store.code_at[slots]
    numbers = summed(np.column_stack([store.numbers[slots], sizes])[index])
    codes, at = np.unique(store.codes[_ragged(store.code_at[slots], sizes)], return_inverse=True)
    n = sizes[index]
    own = at[_ragged((np.cumsum(sizes) - sizes)[index], n)]
    key = np.sort(np.repeat(text, n) * len(codes) + own)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times, key = np.diff(np.append(new, len(key))), key[new]
    doc, at = np.divmod(key, max(len(codes), 1))
    used = np.flatnonzero(np.bincount(at, minlength=len(codes)))  # not those of unsound texts alone
    at, codes = np.searchsorted(used, at), codes[used]
    a, b = store.text_at[slots].tolist(), store.text_at[slots + 1].tolist()
    groups = [bytes(store.text[x:y]) for x, y in zip(a, b)]
    held, edges = index.tolist(), edges.tolist()
    wholes = []
    for i, row in enumerate(numbers.tolist()):
        shown_ = b"".join([groups[u] for u in held[edges[i] : edges[i + 1]]])
        wholes.append((*row, hashlib.sha256(shown_[:-1]).hexdigest() if shown_ else ""))
    return _block(batch.column("doc_id"), wholes, codes, at, times, np.searchsorted(doc, np.arange(rows + 1)))


def _borders(data: np.ndarray, starts: np.ndarray, chunk: int) -> list[int]:
    """Multiples of chunk that part the text; one within a unit longer than a quarter of that is passed over."""
    ends = np.append(starts[1:], len(data))
    out = [0]
    for border in range(chunk, len(data), chunk):
        unit = int(np.searchsorted(starts, border, "right")) - 1
        if ends[unit] - starts[unit] <= max(chunk // 4, 1) or starts[unit] == border:
            out.append(border)
    return [*out, len(data)]


def ranges_of(text: bytes, pair: Pair, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first byte, low, high, units) of each range (low, high] of a space and the text, with the whole units
    that reach into it; a range's tokens are those that end in it."""
    data = np.frombuffer(b" " + text, np.uint8)
    starts = unit_starts(data, np.array([0, len(data)])) if pair.apart else np.array([0])
    ends = np.append(starts[1:], len(data))
    borders = _borders(data, starts, chunk)
    for low, high in zip(borders[:-1], borders[1:]):
        a = int(starts[np.searchsorted(starts, low, "right") - 1])
        b = int(ends[np.searchsorted(ends, high, "left")])
        yield a, low, high, data[a:b].tobytes()


def fragment(first: int, low: int, high: int, piece: bytes, pair: Pair) -> Fragment:
    data = np.frombuffer(piece, np.uint8)
    starts, _ = _units(data, np.array([0, len(data)]), pair)
    bounds = [*starts.tolist(), len(piece)]
    units = [piece[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
    sound, a, _, b, _ = pair.tokens(units)
    if not sound.all():
        return Fragment(sound=False)
    ends_a, ends_b, _ = pair.ends(sound, a, b, np.diff(bounds))
    inside = [(low < e + first) & (e + first <= high) for e in (ends_a, ends_b)]
    parts = [x[i] for x, i in ((a, inside[0]), (ends_a + first, inside[0]), (b, inside[1]), (ends_b + first, inside[1]))]
    return of_tokens(*[x.tolist() for x in parts])


def _part_row(row, doc_id, part: int, f: Fragment) -> tuple:
    return (
        row, doc_id, part, f.sound, f.cut, f.n_a, f.n_b, f.n_groups, f.closed,
        [list(x) for x in f.prefix], [list(x) for x in f.suffix], list(f.links), list(f.links.values()),
    )


def _part_of(r) -> Fragment:
    opened = lambda x: tuple([int(v) for v in y] for y in x)
    links = dict(zip((int(c) for c in r.codes), (int(n) for n in r.times)))
    return Fragment(bool(r.sound), bool(r.cut), opened(r.prefix), opened(r.suffix), int(r.n_a), int(r.n_b), int(r.n_groups), r.closed, links)


_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _composed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    whole = None
    for r in group.itertuples():
        whole = _part_of(r) if whole is None else compose(whole, _part_of(r))
    doc_id = group["doc_id"].iloc[0]
    row = _part_row(key[0], None if pd.isna(doc_id) else int(doc_id), key[1], whole)
    return pd.DataFrame([row], columns=_PART_NAMES).astype({"doc_id": "Int64"})


def _fragments(long: DataFrame, paths: tuple[str, str], chunk: int) -> DataFrame:
    """One row of _PART for each long text, composed by a tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = Pair.of(paths), TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "part", "start", "low", "high", "piece"]
        kinds = [*[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n += 1
                for part, held in enumerate(ranges_of(text.as_py().encode(), pair, chunk)):
                    row = (n, doc_id, part, *held)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(paths)
        for batch in batches:
            for r in batch.to_pylist():
                row = _part_row(r["row"], r["doc_id"], r["part"], fragment(r["start"], r["low"], r["high"], r["piece"], pair))
                out = pa.Table.from_pylist([dict(zip(_PART_NAMES, row))], schema)
                yield from out.to_batches()

    listed = pa.list_(pa.int64())
    kinds = [*[pa.int64()] * 3, pa.bool_(), pa.bool_(), *[pa.int64()] * 3, pa.string(), *[pa.list_(listed)] * 2, listed, listed]
    schema = pa.schema(list(zip(_PART_NAMES, kinds)))
    ranges = stage(long.mapInArrow(cut, "row long, doc_id long, part long, start long, low long, high long, piece binary"))
    parts = stage(ranges.repartition("row", "part").mapInArrow(fragments, _PART))
    most = parts.agg(F.max("part")).first()[0] or 0
    while most:
        parts = stage(
            parts.groupBy("row", F.floor(F.col("part") / FAN).alias("next")).applyInPandas(_composed, _PART)
        )
        most //= FAN
    return parts


def _long_blocks(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pandas().itertuples():
                w: Whole = finish(_part_of(r))
                sha = hashlib.sha256(w.groups.encode()).hexdigest() if w.groups else ""
                codes, times = np.array(list(w.links), np.int64), np.array(list(w.links.values()), np.int64)
                at, first = np.arange(len(codes)), np.array([0, len(codes)])
                numbers = (w.n_a, w.n_b, w.n_groups, int(times.sum()), sha)
                ids = pa.array([None if pd.isna(r.doc_id) else int(r.doc_id)], pa.int64())
                yield _block(ids, [numbers], codes, at, times, first)

    return parts.mapInArrow(run, _BLOCK)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    offsets = text_bytes(batch.column("text"))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1
        end = min(max(end, start + 1), start + ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def blocks_of(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Blocks of documents with their numbers and linked id pairs, written out."""
    paths = (path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(paths)
        for batch in batches:
            for part in _slices(batch):
                yield _short(part, pair)
            del batch
        pa.default_memory_pool().release_unused()

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.where(size < chunk).mapInArrow(run, _BLOCK)
    return stage(short.union(_long_blocks(_fragments(docs.where(size >= chunk), paths, chunk))), rows_held=BLOCKS_HELD)


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A null or empty text, or one whose tokens' bytes aren't a space and the text, has no tokens: zeros and ''.
    A repeated row is a document each time, also where doc_id is null. An empty table gives no
    rows; other columns aren't looked at.
    """
    blocks = blocks_of(docs, path_a, path_b, chunk)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("pos", "pair"))
    asked = asked.select("block", "pos", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs"))
    counts = stage(asked.groupBy("code").agg(F.sum("docs").alias("count")))
    # at most as many rows as A has ids
    highest = counts.groupBy(F.shiftright("code", 24).alias("a")).agg(F.max("count").alias("highest"))
    known = counts.join(highest, F.shiftright("code", 24) == F.col("a"))
    known = known.select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = asked.select("block", "pos", "code").join(known, "code")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("pos", "count", "best")).alias("answers"))
    joined = blocks.drop("codes", "docs").join(answers, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i].values for c in batch.schema.names if c not in ("block", "answers")}
                n = len(own["doc_id"])
                at, times, first = (own[c].to_numpy().astype(np.int64) for c in ("at", "times", "first"))
                count, best = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64), np.zeros(int(at.max()) + 1 if len(at) else 0, bool)
                if batch.column("answers")[i].is_valid:
                    flat = batch.column("answers")[i].values
                    pos = flat.field("pos").to_numpy()
                    count[pos], best[pos] = flat.field("count").to_numpy(), flat.field("best").to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0], np.cumsum(count[at] * times)])
                bests = np.concatenate([[0], np.cumsum(best[at] * times)])
                more = [pa.array(x[first[1:]] - x[first[:-1]], pa.int64()) for x in (bests, sums)]
                columns = [own["doc_id"], *[own[c] for c in ("n_a", "n_b", "n_groups", "n_links")], *more, own["sha"]]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = StructType.fromDDL(schema).names
    return joined.mapInArrow(run, schema)
