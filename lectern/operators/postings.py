"""Token and bigram postings, the vocabulary, and its character-gram index."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grams import ngrams, tokens, word_places
from ..functions.text import present
from ..staging import stage
from .skew import ROWS_PER_SALT, heavy_threshold, salted_join

# Longest gram the vocabulary is indexed by; shorter query tokens use their own length.
GRAM = 3
# Words up to this length have their grams cut out position by position.
USUAL_WORD = 64
# Number of query tokens up to which the gram index is not shuffled for them.
FEW_TOKENS = 100_000
# Hash parts of a stored index; a search reads the parts its terms fall into.
INDEX_PARTS = 64


# Rows of a range of row numbers, about, and the most ranges there are.
ROWS_PER_PART = 65_536
ROW_PARTS = 4_096


def part_of(term: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def with_row_part(
    passages: DataFrame, rows_per_part: int = ROWS_PER_PART, key: str = "row_idx"
) -> DataFrame:
    """Add ``row_part``: the range of row numbers a row falls into, 0 to ROW_PARTS at most.

    Ranges widen with the numbers there are, so sparse ones (hashes) don't make more ranges.
    """
    low, high = passages.agg(F.min(key), F.max(key)).first()
    width = F.lit(max(rows_per_part, -(-((high or 0) - (low or 0) + 1) // (ROW_PARTS - 1))))
    div = lambda x: F.call_function("div", x, width)
    part = div(F.col(key)) - div(F.lit(low or 0))
    return passages.withColumn("row_part", part.cast("int"))


def by_row_part(rows: DataFrame, key: str = "row_idx") -> DataFrame:
    """Write rows in folders of row ranges, sorted; a large range is cut over several files."""
    order = ["row_part", key]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order), "row_part")


def parts_asked(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """The row ranges of a store that pairs fall into; the others are not read.

    The driver gets range numbers only, ROW_PARTS at most.
    """
    parts = {r.row_part for r in pairs.select("row_part").distinct().collect()}
    held = F.col("row_part").isin(sorted(parts - {None}))
    return store.where(held | F.col("row_part").isNull() if None in parts else held)


def token_postings(
    passages: DataFrame, text: str = "text_en", key: str = "row_idx", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct ``(tok, key)`` pairs: [a-z0-9]+ tokens of the lower-cased text."""
    toks = F.array_distinct(tokens(present(text)))
    return passages.select(key, *keep, F.explode(toks).alias("tok")).select("tok", key, *keep)


def token_places(
    passages: DataFrame, text: str = "text_en", key: str = "row_idx", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every row's tokens at their places, ``(key, places)``; rows without text have none."""
    return passages.where(present(text).isNotNull()).select(key, *keep, word_places(F.col(text)).alias("places"))


def bigram_postings(
    passages: DataFrame, text: str = "text_cn", key: str = "row_idx", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct ``(tok, key)`` pairs of code-point bigrams, case kept."""
    grams = ngrams(present(text), 2)
    return passages.select(key, *keep, F.explode(grams).alias("tok")).select("tok", key, *keep)


def character_postings(
    passages: DataFrame, text: str = "text_cn", key: str = "row_idx", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct ``(tok, key)`` pairs of single code points: one pass over the text."""
    chars = F.explode(ngrams(present(text), 1)).alias("tok")
    return passages.select(key, *keep, chars).select("tok", key, *keep)


def vocabulary(postings: DataFrame) -> DataFrame:
    """Terms with their document frequency: ``(tok, df)``."""
    return postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def vocabulary_grams(vocab: DataFrame, parts: int = INDEX_PARTS) -> DataFrame:
    """Every 1- to 3-gram of each vocabulary word: ``gram, gram_part``, the word's columns.

    Words of usual length stay in compiled code: every position gives its grams, and a gram
    is kept at its first place in the word only. That is quadratic in the length, so the few
    very long words go through array functions instead.
    """
    tok = F.col("tok")
    usual = (
        vocab.where(F.length(tok) <= USUAL_WORD)
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(tok))))
        .withColumn("_n", F.explode(F.array(*[F.lit(n) for n in range(1, GRAM + 1)])))
        .where(F.col("_at") + F.col("_n") - 1 <= F.length(tok))
        .withColumn("gram", F.substring(tok, F.col("_at"), F.col("_n")))
        .where(F.instr(tok, F.col("gram")) == F.col("_at"))
        .select("gram", *vocab.columns)
    )
    arrays = F.concat(*[ngrams(tok, n) for n in range(1, GRAM + 1)])
    long = vocab.where(F.length(tok) > USUAL_WORD).select(
        F.explode(arrays).alias("gram"), *vocab.columns
    )
    return usual.unionByName(long).withColumn("gram_part", part_of("gram", parts))


def gram_counts(grams: DataFrame) -> DataFrame:
    """Words and postings per gram: ``(gram, gram_part, n_words, n_rows)``.

    Grams are up to three of 36 characters, so this has at most 47,988 rows.
    """
    return grams.groupBy("gram", "gram_part").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("df").alias("n_rows")
    )


def rarest_grams(query_tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """``(qtok, gram, gram_part, cost)``: the gram to look a token up by.

    Up to three characters the token is its own gram, otherwise it is the trigram with the
    fewest postings. ``cost`` bounds the postings of the words holding the token, and is
    exact for short tokens; 0 means that no word holds it.
    """
    q = F.col("qtok")
    own = F.when(F.length(q) <= GRAM, F.array(q)).otherwise(ngrams(q, GRAM))
    found = query_tokens.select("qtok", F.explode(own).alias("gram")).join(counts, "gram", "left")
    cost = F.coalesce("n_rows", F.lit(0)).alias("cost")
    best = F.min(F.struct(cost, "gram", "gram_part")).alias("m")
    return found.groupBy("qtok").agg(best).select("qtok", "m.gram", "m.gram_part", "m.cost")


def words_holding(asked: DataFrame, grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Words that contain each token of ``(qtok, gram, gram_part)``, found by the gram.

    Few tokens are broadcast against the index: written out, their size is known, and of a
    stored index only the parts they fall into are read (the filter, true for every row,
    makes Spark consider that pruning). For many tokens the index is shuffled by gram, and
    the grams that most words have are salted.
    """
    asked = stage(asked)
    key = ["gram_part", "gram"]
    if asked.count() <= FEW_TOKENS:
        found = grams.join(asked.where("gram_part >= 0"), key)
    else:
        n = counts.select(*key, F.col("n_words").alias("n"))
        found = salted_join(grams, asked, key, ["tok"], counts=n)
    return found.where(F.contains("tok", "qtok")).select(
        "qtok", *[c for c in grams.columns if c not in key]
    )


def expand_vocab(query_tokens: DataFrame, grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Vocabulary words that contain each query token: ``qtok`` and the word's columns.

    Instead of comparing every token with every word, a token is looked up by its rarest
    gram. ``query_tokens`` has the distinct tokens in ``qtok``.
    """
    asked = rarest_grams(query_tokens, counts).where("cost > 0").drop("cost")
    return words_holding(asked, grams, counts)


def place_terms(
    vocab: DataFrame, total: int, rows_per_salt: int = ROWS_PER_SALT, parts: int = INDEX_PARTS
) -> DataFrame:
    """Vocabulary with ``part`` and ``n_salt``: where each term's postings are found.

    ``total`` is the number of postings.
    """
    limit = heavy_threshold(total, rows_per_salt)
    n_salt = F.when(F.col("df") > limit, F.ceil(F.col("df") / limit)).otherwise(1).cast("int")
    return vocab.withColumns({"n_salt": n_salt, "part": part_of("tok", parts)})


def place_postings(
    postings: DataFrame, vocab: DataFrame, parts: int = INDEX_PARTS, key: str = "row_idx"
) -> DataFrame:
    """Add ``part`` and ``salt``: terms with very many rows are spread over several salts.

    ``vocab`` comes from place_terms, so readers of the postings know each term's place from
    it. At most MAX_HEAVY terms have more than one salt, which bounds the broadcast.
    """
    heavy = vocab.where("n_salt > 1").select("tok", "n_salt")
    salt = F.coalesce(F.pmod(F.xxhash64(key), F.col("n_salt")), F.lit(0)).cast("int")
    return (
        postings.join(F.broadcast(heavy), "tok", "left")
        .withColumns({"salt": salt, "part": part_of("tok", parts)})
        .select("part", "tok", "salt", key, "row_part")
    )


class _Index:
    """Named tables; one given as a function is made, once, when it is first read."""

    names: tuple[str, ...] = ()

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(self.names):
            raise TypeError(f"an index has the tables {self.names}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise AttributeError(name)
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name]


class TokenIndex(_Index):
    """What an English search reads.

    postings: part, tok, salt, row_idx, row_part; vocab: tok, df, n_salt, part; grams: gram_part, gram,
    tok, df, n_salt, part; counts: gram_part, gram, n_words, n_rows; places: row_idx, places, row_part.
    """

    names = ("postings", "vocab", "grams", "counts", "places")


class BigramIndex(_Index):
    """What a Chinese search reads.

    postings: part, tok, salt, row_idx, row_part; vocab: tok, df, n_salt, part; texts: row_idx, text, row_part.
    """

    names = ("postings", "vocab", "texts")


def build_token_index(
    passages: DataFrame,
    text: str = "text_en",
    rows_per_salt: int = ROWS_PER_SALT,
    parts: int = INDEX_PARTS,
    rows_per_part: int = ROWS_PER_PART,
) -> TokenIndex:
    """Places are written at once, the rest when a search first reads it; vocabulary and grams come from written postings."""
    rows = with_row_part(passages, rows_per_part)
    written = cache(lambda: stage(token_postings(rows, text, keep=("row_part",))))
    index = TokenIndex(
        postings=lambda: place_postings(written(), index.vocab, parts),
        vocab=lambda: stage(place_terms(vocabulary(written()), written().count(), rows_per_salt, parts)),
        grams=lambda: stage(vocabulary_grams(index.vocab, parts)),
        counts=lambda: stage(gram_counts(index.grams)),
        places=by_row_part(token_places(rows, text, keep=("row_part",))),
    )
    return index


def build_bigram_index(
    passages: DataFrame,
    text: str = "text_cn",
    rows_per_salt: int = ROWS_PER_SALT,
    parts: int = INDEX_PARTS,
    rows_per_part: int = ROWS_PER_PART,
) -> BigramIndex:
    """Texts are written at once, postings and vocabulary when a search first reads them."""
    rows = with_row_part(passages, rows_per_part)
    texts = rows.select("row_idx", "row_part", present(text).alias("text")).where("text is not null")
    written = cache(lambda: stage(bigram_postings(rows, text, keep=("row_part",))))
    index = BigramIndex(
        postings=lambda: place_postings(written(), index.vocab, parts),
        vocab=lambda: stage(place_terms(vocabulary(written()), written().count(), rows_per_salt, parts)),
        texts=by_row_part(texts),
    )
    return index


# The columns each stored index table is clustered by; the first one partitions it if it is
# a part number.
_CLUSTER = {
    "postings": ["part", "tok", "row_idx"],
    "vocab": ["tok"],
    "grams": ["gram_part", "gram", "tok"],
    "counts": ["gram"],
    "places": ["row_part", "row_idx"],
    "texts": ["row_part", "row_idx"],
}


def save_index(
    index: TokenIndex | BigramIndex, path: str, mode: str = "errorifexists"
) -> None:
    """Write the index tables, partitioned by part and range-clustered by term.

    A search for a few terms reads their parts only. Ranges over (part, tok, row_idx) cut a
    frequent word over many files, where one bucket per hash would make it one file.
    """
    for name in index.names:
        key = _CLUSTER[name]
        df = getattr(index, name)
        writer = df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode(mode)
        if key[0].endswith("part"):
            writer = writer.partitionBy(key[0])
        writer.parquet(f"{path}/{name}")


def load_token_index(spark: SparkSession, path: str) -> TokenIndex:
    return TokenIndex(**{name: spark.read.parquet(f"{path}/{name}") for name in TokenIndex.names})


def load_bigram_index(spark: SparkSession, path: str) -> BigramIndex:
    return BigramIndex(**{name: spark.read.parquet(f"{path}/{name}") for name in BigramIndex.names})
