"""Batch word search: AND of substrings, exact phrase first.

A query is reduced to its *term*: language and parts in one string. Equal terms are searched
once, and the hits are spread over their queries at the end. Terms meet blocks of rows: words at
their places (English) or texts (Chinese), where hits are found by bitmaps of rows and leave as lists
(see blocks). Of few terms the postings of each term's rarest part tell which ranges of rows are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.grams import ngrams, tokens
from ..functions.text import split_ws
from ..sources.corpus import address_dim
from ..staging import stage
from .blocks import BLOCK_ROWS, COUNTS, LISTS, find
from .postings import (
    INDEX_PARTS,
    ROWS_PER_PART,
    BigramIndex,
    TokenIndex,
    build_bigram_index,
    build_token_index,
    character_postings,
    parts_asked as ranges_asked,
    rarest_grams,
    words_holding,
)
from .skew import (
    RANK_BLOCK,
    ROWS_PER_SALT,
    WINDOW_LIMIT,
    key_counts,
    rank_in_group,
    salted_join,
)

# Fixed values of the search box.
DEFAULT_LIMIT = 300
PAGE_SIZE = 20
# Number of terms up to which a search looks first which row ranges hold their rarest parts.
FEW_TERMS = 1_000


def term_of(term: Column | str, lang: Column | str) -> Column:
    """Search term key: ``en:`` or ``cn:`` and the parts joined by blanks; null without parts.

    English parts are the [a-z0-9]+ runs, Chinese ones the whitespace-separated segments.
    No part holds a blank, so the parts can be split out again.
    """
    text = F.col(term) if isinstance(term, str) else term
    code = F.col(lang) if isinstance(lang, str) else lang
    parts = F.when(code == "cn", split_ws(text)).otherwise(tokens(text))
    return F.when(F.size(parts) > 0, F.concat(code, F.lit(":"), F.array_join(parts, " ")))


def _phrase(term: str = "term") -> Column:
    return F.substring(F.col(term), F.lit(4), F.length(term))


def _parts(term: str = "term") -> Column:
    return F.split(_phrase(term), " ")


def _single(term: str = "term") -> Column:
    return ~_phrase(term).contains(" ")


def english_drivers(terms: DataFrame, index: TokenIndex) -> DataFrame:
    """``(term, part, tok, n_salt)``: the words to read postings of, for English terms.

    Of a term's tokens the one with the fewest postings, as bounded by the gram counts,
    drives; the vocabulary is searched for the driving tokens only.
    """
    parts = terms.select("term", F.posexplode(_parts()).alias("pos", "qtok"))
    cost = rarest_grams(parts.select("qtok").distinct(), index.counts)
    order = F.struct("cost", "pos")
    # A token no word contains costs 0: it drives its term, which then has no hits.
    driver = stage(
        parts.join(cost, "qtok")
        .groupBy("term")
        .agg(F.min_by(F.struct("qtok", "gram", "gram_part", "cost"), order).alias("d"))
        .where("d.cost > 0")
        .select("term", "d.qtok", "d.gram", "d.gram_part")
    )
    words = words_holding(driver.drop("term").distinct(), index.grams, index.counts)
    return driver.join(words, "qtok").select("term", "part", "tok", "n_salt")


def segment_drivers(terms: DataFrame, index: BigramIndex) -> DataFrame:
    """``(term, part, tok, n_salt)``: the rarest bigram of each Chinese term that has one."""
    segments = terms.select("term", F.explode(_parts()).alias("segment"))
    grams = stage(
        segments.select("term", F.explode(ngrams(F.col("segment"), 2)).alias("tok")).distinct()
    )
    # The vocabulary is cut to the asked bigrams by an inner join, which may broadcast them;
    # an outer join from the terms would have to shuffle the vocabulary.
    known = index.vocab.join(grams.select("tok").distinct(), "tok")
    order = F.struct(F.coalesce("df", F.lit(0)), F.col("tok"))
    driver = (
        grams.join(known, "tok", "left")
        .groupBy("term")
        .agg(F.min_by(F.struct("part", "tok", "n_salt"), order).alias("d"))
    )
    # A bigram no text has drives its term, which then has no hits.
    return driver.where("d.n_salt is not null").select("term", "d.part", "d.tok", "d.n_salt")


def driven_parts(drivers: DataFrame, postings: DataFrame) -> DataFrame:
    """``row_part`` of the row ranges that the drivers' postings fall into.

    Drivers are repeated once per salt of their word, so a frequent word's postings are read
    by many tasks. They are written out, as they meet a corpus-sized table next. Of a stored
    index only the drivers' parts are read (see words_holding for the filter).
    """
    salts = F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1)).alias("salt")
    asked = stage(drivers.select("part", "tok", salts).distinct()).where("part >= 0")
    return postings.join(asked, ["part", "tok", "salt"]).select("row_part").distinct()


def character_candidates(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``(term, row_idx, row_part)`` of the texts that hold the character ``tok`` of a term.

    Characters nobody asks for are dropped where the text is read. Those asked for are code
    points, 1,114,112 at most, which bounds their broadcast.
    """
    wanted = F.broadcast(asked.select("tok").distinct())
    chars = character_postings(texts, "text", keep=("row_part",)).join(wanted, "tok", "left_semi")
    return chars.join(asked, "tok").select("term", "row_idx", "row_part")


def _found(store: DataFrame, terms: DataFrame, parts, limit: int | None, lists: bool, rows: int) -> DataFrame:
    """Hits in a store; few terms read the row ranges only that ``parts`` gives for them."""
    terms = stage(terms.select("term"))
    if terms.count() <= FEW_TERMS:
        store = ranges_asked(store, parts(terms))
    return find(store, terms, limit, lists, rows)


def english_lists(
    terms: DataFrame, index: TokenIndex, limit: int | None = None, lists: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hits of English terms by block (see blocks.find); no text is read.

    A token cannot cross the bounds of a word, and a phrase is a run of neighbouring places:
    its first part ends a word, its last one begins one.
    """
    store = index.places.select("row_part", "row_idx", F.col("places").alias("text"))
    parts = lambda few: driven_parts(english_drivers(few, index), index.postings)
    return _found(store, terms, parts, limit, lists, rows)


def segment_lists(
    terms: DataFrame, index: BigramIndex, limit: int | None = None, lists: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hits of Chinese terms by block, case kept; a segment holds no white space, so it lies in one piece.

    Terms of single characters have no bigram: the ranges of one of their characters are found
    in one pass over the text.
    """

    def parts(few: DataFrame) -> DataFrame:
        lone = F.forall(_parts(), lambda p: F.length(p) < 2)
        driven = driven_parts(segment_drivers(few.where(~lone), index), index.postings)
        asked = few.where(lone).select("term", F.get(_parts(), F.lit(0)).alias("tok"))
        return driven.union(character_candidates(asked, index.texts).select("row_part").distinct())

    pieces = F.array_join(split_ws("text"), " ").alias("text")
    store = index.texts.select("row_part", "row_idx", pieces, F.octet_length("text").alias("bytes"))
    return _found(store, terms, parts, limit, lists, rows)


def _row_type(index: TokenIndex | BigramIndex | None):
    store = index.places if isinstance(index, TokenIndex) else index.texts if index else None
    return store.schema["row_idx"].dataType if store is not None else "long"


def _rows_of(lists: DataFrame, index: TokenIndex | BigramIndex | None) -> DataFrame:
    """Hits ``(term, row_idx, is_exact)`` one by one."""
    kind = _row_type(index)
    row = F.explode(
        F.concat(
            F.transform("exact", lambda r: F.struct(r.alias("row_idx"), F.lit(True).alias("is_exact"))),
            F.transform("rest", lambda r: F.struct(r.alias("row_idx"), F.lit(False).alias("is_exact"))),
        )
    ).alias("hit")
    return lists.select("term", row).select("term", F.col("hit.row_idx").cast(kind).alias("row_idx"), "hit.is_exact")


def search_english(terms: DataFrame, index: TokenIndex) -> DataFrame:
    """Hits ``(term, row_idx, is_exact)`` of English terms."""
    return _rows_of(english_lists(terms, index), index)


def search_segments(terms: DataFrame, index: BigramIndex) -> DataFrame:
    """Hits ``(term, row_idx, is_exact)`` of Chinese terms."""
    return _rows_of(segment_lists(terms, index), index)


@dataclass(frozen=True)
class Corpus:
    """Passages with their address table and the indexes that searches need.

    An index is needed only for the languages that are searched, the addresses only for
    citations.
    """

    passages: DataFrame
    addresses: DataFrame | None = None
    tokens: TokenIndex | None = None
    bigrams: BigramIndex | None = None
    text_en: str = "text_en"
    text_cn: str = "text_cn"


def index_corpus(
    passages: DataFrame,
    langs: tuple[str, ...] = ("en", "cn"),
    addresses: bool = False,
    text_en: str = "text_en",
    text_cn: str = "text_cn",
    rows_per_salt: int = ROWS_PER_SALT,
    parts: int = INDEX_PARTS,
    rows_per_part: int = ROWS_PER_PART,
) -> Corpus:
    """Build the address table and the indexes of the languages that will be searched."""
    return Corpus(
        passages,
        stage(address_dim(passages)) if addresses else None,
        build_token_index(passages, text_en, rows_per_salt, parts, rows_per_part) if "en" in langs else None,
        build_bigram_index(passages, text_cn, rows_per_salt, parts, rows_per_part) if "cn" in langs else None,
        text_en,
        text_cn,
    )


def hit_lists(
    corpus: Corpus, terms: DataFrame, limit: int | None = None, lists: bool = True, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hits of distinct terms by block; a term whose language has no index is an error."""
    found = []
    for lang, index, of_lang in (("en", corpus.tokens, english_lists), ("cn", corpus.bigrams, segment_lists)):
        own = terms.where(F.col("term").startswith(f"{lang}:"))
        if index:
            found.append(of_lang(own, index, limit, lists, rows))
        elif not own.isEmpty():
            raise ValueError(f"there are terms in {lang!r}, but no index of that language")
    none = terms.sparkSession.createDataFrame([], LISTS if lists else COUNTS)
    return reduce(DataFrame.unionByName, found) if found else none


def search_terms(corpus: Corpus, terms: DataFrame) -> DataFrame:
    """All hits ``(term, row_idx, is_exact)`` of distinct terms."""
    return _rows_of(hit_lists(corpus, terms), corpus.tokens or corpus.bigrams)


def ranked_runs(lists: DataFrame) -> DataFrame:
    """Runs ``(term, is_exact, first, rank, rows)``: rows of a term at the ranks ``first`` to ``rank``.

    Phrase hits come first, then the rest, each by row number. ``lists`` is a written table of
    hit lists; only their lengths are summed up over the blocks of a term.
    """
    up_to = W.partitionBy("term").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = lambda n: F.coalesce(F.sum(n).over(up_to), F.lit(0))
    exact = F.sum("n_exact").over(W.partitionBy("term"))
    starts = stage(
        lists.select("term", "block", before("n_exact").alias("_exact"), (exact + before("n_rest")).alias("_rest"))
    )
    runs = F.array(
        F.struct(F.lit(True).alias("is_exact"), F.col("_exact").alias("before"), F.col("exact").alias("rows")),
        F.struct(F.lit(False).alias("is_exact"), F.col("_rest").alias("before"), F.col("rest").alias("rows")),
    )
    return (
        lists.join(starts, ["term", "block"])
        .select("term", F.inline(runs))
        .where(F.size("rows") > 0)
        .select("term", "is_exact", (F.col("before") + 1).alias("first"), (F.col("before") + F.size("rows")).alias("rank"), "rows")
    )


def rows_of_runs(runs: DataFrame, keep: Sequence[str], kind: DataType | str) -> DataFrame:
    """The rows of runs one by one: ``*keep, rank, row_idx, is_exact``; kind: the type of row_idx."""
    rows = runs.select(*keep, "first", "is_exact", F.posexplode("rows").alias("_at", "row_idx"))
    return rows.select(
        *keep, (F.col("first") + F.col("_at")).alias("rank"), F.col("row_idx").cast(kind).alias("row_idx"), "is_exact"
    )


def search_runs(corpus: Corpus, terms: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """All hits of distinct terms as ranked runs (see ranked_runs): once a term, however many queries ask it."""
    return ranked_runs(stage(hit_lists(corpus, terms, rows=min(block, BLOCK_ROWS))))


def page_runs(runs: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """The ranks of runs that a page shows; runs without any are left out, of stored ones they aren't read."""
    begin, end = (page - 1) * size + 1, page * size
    held = runs.where((F.col("rank") >= begin) & (F.col("first") <= end))
    first = F.greatest("first", F.lit(begin))
    shown = F.slice("rows", (first - F.col("first") + 1).cast("int"), (F.least("rank", F.lit(end)) - first + 1).cast("int"))
    return held.withColumns({"rows": shown, "first": first, "rank": F.least("rank", F.lit(end))})


def term_totals(runs: DataFrame) -> DataFrame:
    """Hits ``(_term, total)`` of every term with any, from its runs: the last rank."""
    return runs.groupBy("_term").agg(F.max("rank").alias("total"))


def rank_phrase_first(
    hits: DataFrame,
    group: list[str],
    limit: int | None = None,
    block: int = RANK_BLOCK,
) -> DataFrame:
    """Rank hits of each group: phrase hits first, then the rest, each by ``row_idx``."""
    return rank_in_group(hits, group, "row_idx", "is_exact", limit, block)


def asked_terms(queries: DataFrame, query_id: str, keep: Sequence[str] = ()) -> tuple:
    """Queries with their term key, and the distinct terms with their number of queries."""
    asked = queries.select(query_id, *keep, term_of("term", "lang").alias("_term"))
    counts = key_counts(asked.where("_term is not null"), ["_term"])
    return asked, stage(counts)


def search(
    corpus: Corpus,
    queries: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    query_id: str = "query_id",
    keep: Sequence[str] = (),
    block: int = RANK_BLOCK,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Ranked hits ``(query_id, rank, row_idx, is_exact)`` of ``(query_id, term, lang)`` queries.

    ``limit`` cuts each query's rows; None keeps all. ``keep`` names query columns to carry
    along. Totals come from search_totals.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must be None or >= 0")
    asked, counts = asked_terms(queries, query_id, keep)
    terms = counts.select(F.col("_term").alias("term"))
    lists = hit_lists(corpus, terms, limit, rows=min(block, BLOCK_ROWS))
    known = asked.where("_term is not null")
    if limit is not None and limit <= WINDOW_LIMIT:
        hits = _rows_of(lists, corpus.tokens or corpus.bigrams).withColumnRenamed("term", "_term")
        ranked = rank_phrase_first(hits, ["_term"], limit, block)
        found = salted_join(known, ranked, ["_term"], [query_id], counts=counts, rows_per_salt=rows_per_salt)
        return found.select(query_id, *keep, "rank", "row_idx", "is_exact")
    # A term may hold a large part of the corpus: its hits stay lists until they meet the queries.
    lists = stage(lists)
    n = lists.groupBy(F.col("term").alias("_term")).agg(F.sum(F.col("n_exact") + F.col("n_rest")).alias("n"))
    found = salted_join(
        known,
        ranked_runs(lists).withColumnRenamed("term", "_term"),
        ["_term"],
        [query_id],
        counts=counts,
        right_counts=stage(n),
        right_spread_by=["first"],
        rows_per_salt=rows_per_salt,
    )
    ranked = rows_of_runs(found, [query_id, *keep], _row_type(corpus.tokens or corpus.bigrams))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def search_totals(
    corpus: Corpus,
    queries: DataFrame,
    query_id: str = "query_id",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Full match count ``(query_id, total)`` of every query, 0 included.

    Hits are counted per term before they meet the queries, so this stays small.
    """
    asked, counts = asked_terms(queries, query_id)
    hits = hit_lists(corpus, counts.select(F.col("_term").alias("term")), lists=False)
    totals = hits.groupBy(F.col("term").alias("_term")).agg(F.sum("n").alias("total"))
    found = salted_join(
        asked.where("_term is not null"), totals, ["_term"], [query_id], "left", counts,
        rows_per_salt=rows_per_salt,
    ).select(query_id, F.coalesce("total", F.lit(0)).alias("total"))
    empty = asked.where("_term is null").select(query_id, F.lit(0).cast("long").alias("total"))
    return found.unionByName(empty)


def count_hits(hits: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Totals ``(query_id, total)`` from hits that were not limited, 0 included.

    Where the hits are there already, this saves the second search of search_totals.
    """
    counts = hits.groupBy(query_id).agg(F.count(F.lit(1)).alias("total"))
    return queries.select(query_id).join(counts, query_id, "left").fillna(0, ["total"])


def page_hits(
    hits: DataFrame,
    totals: DataFrame,
    page: int,
    size: int = PAGE_SIZE,
    query_id: str = "query_id",
) -> DataFrame:
    """Page ``page`` of ranked hits with the rows shown so far and the rows remaining."""
    end = page * size
    on_page = hits.where(F.col("rank").between(end - size + 1, end))
    return on_page.join(totals, query_id).select(
        *hits.columns,
        F.lit(page).alias("page"),
        F.least(F.col("total"), F.lit(end)).alias("shown"),
        F.greatest(F.col("total") - end, F.lit(0)).alias("remaining"),
        "total",
    )


def search_page(
    corpus: Corpus,
    queries: DataFrame,
    page: int,
    size: int = PAGE_SIZE,
    query_id: str = "query_id",
    block: int = RANK_BLOCK,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Page ``page`` of every query, as page_hits gives it for the rows of search without a limit.

    All hits are found, ranked and counted once a term, and stay runs; a query meets the ranks of its page only.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    asked, counts = asked_terms(queries, query_id)
    known = stage(asked.where("_term is not null"))
    runs = stage(search_runs(corpus, counts.select(F.col("_term").alias("term")), block).withColumnRenamed("term", "_term"))
    join = {"on": ["_term"], "spread_by": [query_id], "counts": counts, "rows_per_salt": rows_per_salt}
    found = salted_join(known, page_runs(runs, page, size), **join)
    hits = rows_of_runs(found, [query_id], _row_type(corpus.tokens or corpus.bigrams))
    total = salted_join(known, term_totals(runs), **join).groupBy(query_id).agg(F.sum("total").alias("total"))
    totals = queries.select(query_id).join(total, query_id, "left").fillna(0, ["total"])
    return page_hits(hits, totals, page, size, query_id)


def page_of(rank: Column | str, size: int = PAGE_SIZE) -> Column:
    return F.ceil((F.col(rank) if isinstance(rank, str) else rank) / size).cast("int")
