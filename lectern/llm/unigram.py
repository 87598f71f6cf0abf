"""Token counts: Aho-Corasick finds the pieces of a unigram vocabulary, dynamic programming counts.

The vocabulary is a piece table with scores. Of all ways to cut a text into pieces the one with the
highest sum of scores counts; of equal sums, at each place the one whose last piece is longest, as
it is found first. A character that is no piece costs ten below the lowest score and counts
a token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Chunks remembered by one Python worker, beyond that it starts anew, and characters of such a chunk at most.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Places whose best cuts are held, at least; further back none is looked up.
HELD = 65_536
#: Stands for a blank, and is put before every text.
BLANK = "▁"
#: What a character that is no piece costs below the lowest score.
UNKNOWN_PENALTY = 10.0


class Counter(dict):
    """Maps a chunk of text to its number of tokens; fills itself.

    A chunk begins at a run of blanks or is a line end. Where no piece holds a blank behind
    another character or a line end, no piece crosses chunks, so the best cuts of the chunks
    make up the best cut of the text, ties included; sums of whole scores are exact. With other pieces
    or scores each text is cut whole, as sums of fractions depend on what is added up before them.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        crossing = any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in pieces)
        self.whole = crossing or any(score != int(score) for _, score in pieces)
        self.longest = max(len(p) for p, _ in pieces)
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > REMEMBERED_CHARS:
            return self.best(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[chunk] = self.best(chunk)
        return found

    def best(self, text: str) -> int:
        """The number of tokens of the best cut of text."""
        score, count, base = [0.0], [0], 0
        matches = self.matches.iter(text)
        end, found = next(matches, (len(text), None))
        for i, char in enumerate(text):
            if i - base >= HELD + self.longest:
                score, count, base = score[HELD:], count[HELD:], base + HELD
            most, pieces, single = None, 0, False
            while end == i:
                length, own = found
                start = i + 1 - length - base
                total = score[start] + own
                if most is None or total > most:
                    most, pieces = total, count[start] + 1
                single = single or length == 1
                end, found = next(matches, (len(text), None))
            if not single:
                total = score[-1] + self.unknown
                if most is None or total > most:
                    most, pieces = total, count[-1] + len(char.encode())
            score.append(most)
            count.append(pieces)
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        if self.whole:
            return self.best(marked)
        return sum(map(self.__getitem__, self.chunks.findall(marked)))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens long of each document's whole text, a row each.

    A null or empty text has 0 tokens; repeated rows and ids are kept as they come; other columns
    are not looked at; an empty table gives no rows. No shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = counter(path)
        counts = [tokens.count(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long")
