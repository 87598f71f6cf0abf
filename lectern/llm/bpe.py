"""BPE encoding and decoding by a contiguous array of ranks per word.

Follows the pipeline of a word-level BPE file: special tokens are cut out of the raw text, the
rest is put into NFC, lower-cased and cut into words, and the bytes of a word are merged. No
match of the word pattern crosses white space, so pieces between white space are encoded once
and remembered (bounded).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Pieces remembered by one Python worker; beyond that it starts anew.
REMEMBERED = 600_000
#: Words of more symbols are merged through a heap, as scanning them is quadratic.
SHORT = 128

# Fixed values of the tokenizer: the word pattern, and the white space it leaves out.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() also cuts at these, the tokenizer doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")

_NEVER = 1 << 62


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder(dict):
    """Maps a piece of normalised text without white space to its ids; fills itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        symbols = _byte_symbols()
        self.inner = [vocab[c] for c in symbols]
        self.last = [vocab[c + suffix] for c in symbols]
        self.bits = max(vocab.values()).bit_length()
        self.mask = (1 << self.bits) - 1
        #: (left id, right id) in one number, to rank and merged id in one number.
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            key = vocab[a] << self.bits | vocab[b]
            self.merges.setdefault(key, rank << self.bits | vocab[a + b])
        self.tokens = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]

    keep = tuple

    @staticmethod
    def join(kept) -> list[int]:
        return list(chain.from_iterable(kept))

    def __missing__(self, piece: str):
        if piece[-1] in ".,!?" and piece[-2:-1].isalpha():
            found = self[piece[:-1]] + self[piece[-1]]  # a word ends where a letter meets a mark
        else:
            ids: list[int] = []
            for word in _WORD.findall(piece):
                ids += self.word(word)
            found = self.keep(ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found
        return found

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > SHORT:
            return self._long(ids)
        get, bits, mask = self.merges.get, self.bits, self.mask
        ranks = [get(a << bits | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            ids[i] = least & mask
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << bits | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << bits | ids[i + 1], _NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges, in order of rank and place, from a heap over linked parts."""
        get, bits, mask, n = self.merges.get, self.bits, self.mask, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << bits | ids[i + 1], _NEVER)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << bits | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank & mask, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    r = get(ids[left] << bits | ids[after[left]], _NEVER)
                    if r != _NEVER:
                        heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def encode(self, text: str):
        if "<|" not in text:
            return self.join(self._plain(text))
        kept: list = []
        for part in self.cut.split(text):
            kept += [self.keep([self.special[part]])] if part in self.special else self._plain(part)
        return self.join(kept)

    def _plain(self, text: str) -> list:
        if not text.isascii():
            # lower-casing goes letter by letter: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        pieces = text.split() if not _NOT_SPACE.search(text) else filter(None, _SPACE.split(text))
        return list(map(self.__getitem__, pieces))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by one space, special ones too."""
        return " ".join(map(self.tokens.__getitem__, ids))


class PackedEncoder(Encoder):
    """Encodes to little-endian unsigned 32-bit ids."""

    @staticmethod
    def keep(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    join = staticmethod(b"".join)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def packed_encoder(path: str) -> PackedEncoder:
    return PackedEncoder(path)


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string of each document's whole text, a row each.

    A null text counts as empty and gives no ids and an empty string; repeated rows and ids are
    kept as they come; other columns are not looked at. No shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
        decoded = [bpe.decode(i) for i in ids]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
            ["doc_id", "ids", "decoded"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """As encode_table, but digests take the place of ids and decoded text before they leave the task.

    Columns doc_id, n_tokens long, ids_sha256 and decoded_sha256.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        counts, of_ids, of_text = [], [], []
        for text in batch.column("text").to_pylist():
            ids = bpe.encode(text or "")
            counts.append(len(ids))
            decimals = " ".join(map(bpe.decimals.__getitem__, ids))
            of_ids.append(hashlib.sha256(decimals.encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(
        docs.select("doc_id", "text"),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
