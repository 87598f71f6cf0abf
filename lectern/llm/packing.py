"""Packing by powers of two: pieces of binary length, equal lengths side by side."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import packed_encoder
from .common import map_batches

#: Tokens of a full sequence; a power of two.
LENGTH = 2048
#: Closes every document.
END_ID = 1


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of a document of n tokens: full ones, then the binary digits of the rest."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    Each piece is a sequence of its own, from offset 0: its length is a power of two, so it needs
    no padding, and no sequence holds two documents. bucket is the exponent; a batch is made of
    equal lengths by reading one bucket (see write_buckets). A null text counts as empty and gives
    its end id only; rows of equal doc_id are packed each by itself; other columns are not looked
    at; an empty table gives no rows. sequence_id numbers the rows within their task, above the
    task's number, so nothing is counted or shuffled for it. with_ids=False leaves ids out.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = packed_encoder(path)
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = memoryview(bpe.encode(text or "") + bpe.keep([END_ID]))
            start, tokens = 0, len(raw) // 4
            for n in cuts(tokens, length):
                piece = raw[4 * start : 4 * (start + n)]
                for column, value in zip(out, (doc, start, n, zlib.crc32(piece), tokens)):
                    column.append(value)
                if with_ids:
                    out[5].append(np.frombuffer(piece, "<u4").astype(np.int32))
                start += n
        arrays = [pa.array(c, pa.int64()) for c in out[:5]]
        if with_ids:
            arrays.append(pa.array(out[5], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    pieces = map_batches(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)
    placed = (
        pieces.withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.log2("length").cast("int"))
    )
    columns = [*names, "sequence_id", "offset", "bucket"]
    return placed.select(*columns, *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with equal lengths side by side, a folder per bucket."""
    packed.write.partitionBy("bucket").parquet(path)
