"""Registered queries: every operator over whole tables of the driver's data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import percent_decode
from lectern.operators import citations, lookup, postings, present
from lectern.operators import search as words
from lectern.plans import omni
from lectern.plans.omni import omni_search, omni_totals
from lectern.sources import corpus, links
from lectern.staging import stage

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Postings and vocabulary


@query
def token_postings(spark, sf_dir):
    return postings.token_postings(inputs.documents(spark, sf_dir))


@query
def vocabulary(spark, sf_dir):
    return postings.vocabulary(token_postings(spark, sf_dir))


@query
def bigram_postings(spark, sf_dir):
    return postings.bigram_postings(inputs.documents(spark, sf_dir))


@query
def expand_vocab(spark, sf_dir):
    """Words of the documents that contain a word of the benchmark."""
    vocab = stage(vocabulary(spark, sf_dir))
    items = inputs.table(spark, sf_dir, "benchmark").selectExpr("item_id as row_idx", "text")
    asked = postings.token_postings(items, "text").select(F.col("tok").alias("qtok")).distinct()
    grams = stage(postings.vocabulary_grams(vocab))
    return postings.expand_vocab(asked, grams, postings.gram_counts(grams)).select(
        "qtok", "tok", "df"
    )


# Word search


def _documents(spark, sf_dir, lang):
    return words.index_corpus(inputs.documents(spark, sf_dir), (lang,))


@query
def search_single(spark, sf_dir):
    return words.search(_documents(spark, sf_dir, "en"), inputs.one_word(spark, sf_dir), None)


@query
def search_and(spark, sf_dir):
    return words.search(_documents(spark, sf_dir, "en"), inputs.two_words(spark, sf_dir), None)


@query
def search_segments(spark, sf_dir):
    asked = inputs.two_words(spark, sf_dir, "cn")
    return words.search(_documents(spark, sf_dir, "cn"), asked, None)


@query
def search_one_char(spark, sf_dir):
    return words.search(_documents(spark, sf_dir, "cn"), inputs.one_character(spark, sf_dir), None)


@query
def search_totals(spark, sf_dir):
    return words.search_totals(_documents(spark, sf_dir, "en"), inputs.two_words(spark, sf_dir))


@query
def search_topn(spark, sf_dir):
    return words.search(_documents(spark, sf_dir, "en"), inputs.two_words(spark, sf_dir), 5)


@query
def search_page(spark, sf_dir):
    return words.search_page(_documents(spark, sf_dir, "en"), inputs.two_words(spark, sf_dir), page=2)


# Citations


@query
def detect_language(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents", "doc_id")
    return citations.detect_language(docs.select("doc_id", "text"), "text", "code").select(
        "doc_id", "code"
    )


@query
def alias_dim(spark, sf_dir):
    """Parts as books: names, brands and types collide often, the last part wins."""
    books = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("idx"),
        F.col("p_partkey").alias("book_pos"),
        F.col("p_name").alias("en"),
        F.upper("p_name").alias("cn"),
        F.array("p_brand", "p_type").alias("enAlias"),
        F.array(F.concat("p_type", F.lit(" "), "p_size")).alias("cnAlias"),
    )
    return citations.alias_dim(books)


@query
def match_alias_exact(spark, sf_dir):
    aliases = citations.alias_dim(inputs.region_books(spark, sf_dir)).where("kind = 'en'")
    asked = inputs.citations(spark, sf_dir).select("query_id", F.col("raw").alias("q"))
    return citations.match_alias_exact(asked, aliases).select("query_id", "book_idx", "num")


@query
def match_alias_prefix(spark, sf_dir):
    """Nation names, of which NATION_1 starts NATION_10, before each customer's key."""
    nations = inputs.table(spark, sf_dir, "nation")
    aliases = nations.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("book_idx"))
    customers = inputs.table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    asked = customers.select(
        F.col("c_custkey").alias("query_id"),
        F.concat("n_name", F.lit(" 3:"), "c_custkey").alias("q"),
    )
    return citations.match_alias_prefix(asked, aliases).select("query_id", "q", "book_idx", "num")


@query
def parse_address(spark, sf_dir):
    asked = citations.split_name(inputs.citations(spark, sf_dir), "raw")
    return citations.parse_address(asked).select(
        "query_id", "name", "num", "chapter", "verse", "verse_end", "has_verse"
    )


@query
def validate_address(spark, sf_dir):
    books = inputs.region_books(spark, sf_dir)
    aliases = citations.alias_dim(books).where("kind = 'en'")
    matched = citations.match_alias_exact(inputs.citations(spark, sf_dir), aliases, "raw")
    return citations.validate_address(citations.parse_address(matched), books).select(
        "query_id", "book_idx", "chapter", "verse", "verse_end"
    )


@query
def expand_fuzzy(spark, sf_dir):
    return citations.expand_fuzzy(
        inputs.digit_strings(spark, sf_dir), inputs.region_books(spark, sf_dir)
    )


@query
def resolve_citations(spark, sf_dir):
    return citations.resolve_citations(
        inputs.citations(spark, sf_dir), inputs.region_books(spark, sf_dir)
    )


@query
def classify_queries(spark, sf_dir):
    return citations.classify_queries(
        inputs.raw_queries(spark, sf_dir), _books(spark, sf_dir)
    )


@query
def candidate_counts(spark, sf_dir):
    return citations.candidate_counts(classify_queries(spark, sf_dir))


# Lookups


@query
def address_dim(spark, sf_dir):
    """Line items as addressed rows; most addresses are duplicated."""
    rows = inputs.table(spark, sf_dir, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("book_idx"),
        F.col("l_linenumber").alias("chapter"),
        F.lit(1).alias("verse"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_idx"),
    )
    return corpus.address_dim(rows)


def _addresses(spark, sf_dir):
    return stage(corpus.address_dim(inputs.conversations(spark, sf_dir)))


def _books(spark, sf_dir):
    """The book dimension as a written table, which is what it is in use."""
    return stage(inputs.conversation_books(spark, sf_dir))


@query
def corpus_shape(spark, sf_dir):
    return corpus.corpus_shape(
        _books(spark, sf_dir), _addresses(spark, sf_dir)
    )


@query
def lookup_point(spark, sf_dir):
    asked = inputs.requests(spark, sf_dir).drop("verse_end")
    return lookup.lookup_point(asked, _addresses(spark, sf_dir)).select(
        "query_id", "book_idx", "chapter", "verse", "row_idx"
    )


@query
def lookup_range(spark, sf_dir):
    return lookup.lookup_range(inputs.requests(spark, sf_dir), _addresses(spark, sf_dir))


@query
def lookup_chapter(spark, sf_dir):
    return lookup.lookup_chapter(
        inputs.requests(spark, sf_dir),
        _addresses(spark, sf_dir),
        _books(spark, sf_dir),
    )


@query
def resolve_candidates(spark, sf_dir):
    resolved = stage(classify_queries(spark, sf_dir)).where("kind = 'fuzzy'")
    found = lookup.resolve_candidates(resolved, _addresses(spark, sf_dir))
    return found.select("query_id", "cand_rank", "cand_kind", "row_idx")


@query
def chapter_context(spark, sf_dir):
    """Every event hits a turn; the turn's whole conversation is its context."""
    hits = inputs.table(spark, sf_dir, "events", "event_id").select(
        F.col("event_id").alias("query_id"),
        (inputs.asked_conversation(spark, sf_dir) * 100 + F.col("event_id") % 9).alias("row_idx"),
    )
    return lookup.chapter_context(
        hits, inputs.conversations(spark, sf_dir), _books(spark, sf_dir)
    )


@query
def sibling_chapter(spark, sf_dir):
    """Previous and next conversation of every turn."""
    rows = inputs.conversations(spark, sf_dir)
    addresses = _addresses(spark, sf_dir)
    books = _books(spark, sf_dir)
    out = rows.select("row_idx", "book_idx", "chapter")
    for direction, name in ((-1, "prev_row"), (1, "next_row")):
        out = lookup.sibling_chapter(out, addresses, books, direction).withColumnRenamed(
            "sibling_row", name
        )
    return out.select("row_idx", "prev_row", "next_row")


@query
def label_rows(spark, sf_dir):
    rows = inputs.conversations(spark, sf_dir).select("row_idx", "book_idx", "chapter", "verse")
    books = _books(spark, sf_dir)
    en = lookup.label_rows(rows, books, "en").withColumnRenamed("label", "label_en")
    cn = lookup.label_rows(en, books, "cn").withColumnRenamed("label", "label_cn")
    return cn.select("row_idx", "label_en", "label_cn")


@query
def chapter_title(spark, sf_dir):
    rows = inputs.conversations(spark, sf_dir).select("book_idx", "chapter").distinct()
    return lookup.chapter_title(rows, _books(spark, sf_dir), "cn")


# Output


@query
def pick_text(spark, sf_dir):
    rows = inputs.conversations(spark, sf_dir)
    return present.pick_text(rows, "cn").select("row_idx", "text")


@query
def missing_translation(spark, sf_dir):
    rows = inputs.conversations(spark, sf_dir)
    return present.missing_translation(rows).select("row_idx", "cn_missing")


@query
def highlight(spark, sf_dir):
    """Every turn once for each of its words, that word and the next one marked."""
    rows = inputs.conversations(spark, sf_dir).select(
        "row_idx", "text_en", F.posexplode(inputs.neighbours("text_en")).alias("pos", "term")
    )
    return present.highlight(rows, "text_en", "term").select("row_idx", "pos", "term", "html")


@query
def interlinear(spark, sf_dir):
    return present.interlinear(inputs.conversations(spark, sf_dir)).select(
        "row_idx", "line_no", "line_lang", "line"
    )


@query
def export_lines(spark, sf_dir):
    rows = inputs.conversations(spark, sf_dir)
    books = _books(spark, sf_dir)
    single = present.export_lines(rows, books, "cn").withColumnRenamed("line", "line_cn")
    return present.export_lines(single, books, both=True).select("row_idx", "line_cn", "line")


@query
def select_rows(spark, sf_dir):
    keys = inputs.requests(spark, sf_dir).select(
        ((F.col("book_idx") * 20 + F.col("chapter") - 21) * 100 + F.col("verse")).alias("row_idx")
    )
    return present.select_rows(inputs.conversations(spark, sf_dir), keys).select(
        "row_idx", "text_en"
    )


def _conversations(spark, sf_dir, langs=()):
    return words.index_corpus(inputs.conversations(spark, sf_dir), langs, addresses=True)


@query
def chapter_view(spark, sf_dir):
    asked = stage(inputs.requests(spark, sf_dir).select("query_id", "book_idx", "chapter"))
    return present.chapter_view(
        asked, _conversations(spark, sf_dir), _books(spark, sf_dir), "cn"
    ).select("query_id", "title", "verse", "row_idx", "text", "prev_row", "next_row")


@query
def fuzzy_view(spark, sf_dir):
    return present.fuzzy_view(
        stage(classify_queries(spark, sf_dir)),
        _conversations(spark, sf_dir),
        _books(spark, sf_dir),
    )


@query
def hit_view(spark, sf_dir):
    """The first three hits of every benchmark item among the conversations, as shown."""
    rows = inputs.conversations(spark, sf_dir)
    found = words.search(
        words.index_corpus(rows, ("en",)), inputs.two_words(spark, sf_dir), 3, keep=["term"]
    )
    books = _books(spark, sf_dir)
    return present.hit_view(found, rows, books, "en", F.col("term"))


@query
def queries_from_links(spark, sf_dir):
    return links.queries_from_links(inputs.links(spark, sf_dir))


@query
def query_links(spark, sf_dir):
    """Link and back, over every item text."""
    items = inputs.table(spark, sf_dir, "benchmark")
    return items.select("item_id", links.link_of("text").alias("link")).withColumn(
        "back", percent_decode(F.substring(F.col("link"), F.lit(3), F.length("link")))
    )


# The combined plan


@query
def omni_search_rows(spark, sf_dir):
    return omni_search(
        inputs.raw_queries(spark, sf_dir),
        _conversations(spark, sf_dir, ("en",)),
        _books(spark, sf_dir),
    )


@query
def omni_search_totals(spark, sf_dir):
    return omni_totals(
        inputs.raw_queries(spark, sf_dir),
        _conversations(spark, sf_dir, ("en",)),
        _books(spark, sf_dir),
    )


def _stored(spark, sf_dir):
    return omni.store_answers(
        inputs.raw_queries(spark, sf_dir),
        _conversations(spark, sf_dir, ("en",)),
        _books(spark, sf_dir),
    )


@query
def answer_pages(spark, sf_dir):
    """Second page of every word query, from answers stored once."""
    return omni.answer_page(_stored(spark, sf_dir), page=2)


@query
def answer_status(spark, sf_dir):
    """Status of every query, counted from the stored answers."""
    return _stored(spark, sf_dir).status.drop("part")


@query
def answer_links(spark, sf_dir):
    """Every row that answers the query of a shared link."""
    return omni.answer_links(
        inputs.asked_links(spark, sf_dir),
        _conversations(spark, sf_dir, ("en",)),
        _books(spark, sf_dir),
    )


# Chinese


def _conversations_cjk(spark, sf_dir):
    rows = inputs.conversations_cjk(spark, sf_dir)
    return words.index_corpus(rows, ("en", "cn"), addresses=True)


def _books_cjk(spark, sf_dir):
    return stage(inputs.conversation_books_cjk(spark, sf_dir))


@query
def detect_language_cjk(spark, sf_dir):
    """Both texts of every turn, so both languages."""
    rows = inputs.conversations_cjk(spark, sf_dir)
    en = citations.detect_language(rows, "text_en", "lang_en")
    return citations.detect_language(en, "text_cn", "lang_cn").where("text_cn is not null").select(
        "row_idx", "lang_en", "lang_cn"
    )


@query
def classify_queries_cjk(spark, sf_dir):
    return citations.classify_queries(
        inputs.raw_queries_cjk(spark, sf_dir), _books_cjk(spark, sf_dir)
    )


@query
def omni_search_rows_cjk(spark, sf_dir):
    return omni_search(
        inputs.raw_queries_cjk(spark, sf_dir),
        _conversations_cjk(spark, sf_dir),
        _books_cjk(spark, sf_dir),
    )


@query
def omni_search_totals_cjk(spark, sf_dir):
    return omni_totals(
        inputs.raw_queries_cjk(spark, sf_dir),
        _conversations_cjk(spark, sf_dir),
        _books_cjk(spark, sf_dir),
    )
