"""Helpers of the operators in this package: tables, Arrow text blocks, words and hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.staging import ship

#: Text is worked through in blocks of whole documents of about so many bytes.
BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 1024

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, divisor: int):
    """crc32 of an id's decimal text modulo divisor; a null id counts as an empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """fn over every Arrow batch, in slices of whole rows of about BLOCK_BYTES of text.

    Workers stay for later tasks, so the memory that Arrow has kept for reuse is given back at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, slices(batch))
            del batch
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of at most BLOCK_ROWS rows and about BLOCK_BYTES; a longer text stays whole."""
    if batch.num_rows == 0:
        return
    if column not in batch.schema.names:
        yield batch
        return
    offsets = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, start + 1), start + BLOCK_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins (one more than texts); null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word ([^\\x20\\x09-\\x0D]+), and each document's first word index.

    separator tells for each byte value whether it parts words.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += 32
    return mix(code * _ODD + np.uint64(1))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; lower: A-Z count as a-z."""
    values = _VALUES[lower][data] * _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(spans ^ ((ends - starts).astype(np.uint64) * _ODD))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; documents are not told apart here."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = mix((out + words[i : i + size]) * _ODD + np.uint64(i + 1))
    return out
