"""Inputs of the registered queries, derived from the given tables.

None of the tables is a bilingual corpus, so each operator runs on a table of the same
shape. Every derivation here has its SQL twin in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.links import link_of
from lectern.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Read a table; one of fewer files than cores is spread by key so all cores get work.

    The driver's tables have one row group, so one task, each. A real corpus has more files
    than cores and is left as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread_by and len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
        return df.repartition(spark.sparkContext.defaultParallelism, spread_by)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages whose both texts are the document's."""
    return table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("row_idx"),
        F.col("text").alias("text_en"),
        F.col("text").alias("text_cn"),
    )


#: A query's id is its item's id times this, plus its place in the item's text.
PLACES = 1_000_000


def _places(spark: SparkSession, sf_dir: str, terms, lang: str) -> DataFrame:
    """A query for every element of terms, an array made of a benchmark item's whole text."""
    return (
        table(spark, sf_dir, "benchmark")
        .select("item_id", F.posexplode(terms).alias("pos", "term"))
        .select(
            (F.col("item_id") * PLACES + F.col("pos")).alias("query_id"),
            "term",
            F.lit(lang).alias("lang"),
        )
    )


def neighbours(text: str):
    """Every word of a text with the next one; the last stands alone.

    The words are no part of the lambda, which would cut the text again for each of them.
    """
    words = F.split(text, " ")
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda w, after: F.concat_ws(" ", w, after))


def two_words(spark: SparkSession, sf_dir: str, lang: str = "en") -> DataFrame:
    return _places(spark, sf_dir, neighbours("text"), lang)


def one_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of letters or digits of every benchmark item."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return _places(spark, sf_dir, runs, "en")


def one_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character that a benchmark item holds, in the order of their first places."""
    chars = F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))
    return _places(spark, sf_dir, chars, "cn")


def region_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as books of twelve chapters with made-up verse counts."""
    idx = (F.col("r_regionkey") + 1).cast("int")
    chapters = F.transform(
        F.sequence(F.lit(1), F.lit(12)), lambda i: (F.lit(10) + (i * 7 + idx) % 30).cast("int")
    )
    return _books(table(spark, sf_dir, "region"), idx, chapters)


def _books(regions: DataFrame, idx, chapters) -> DataFrame:
    return regions.select(
        idx.alias("idx"),
        idx.alias("book_pos"),
        F.col("r_name").alias("en"),
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("cn"),
        chapters.alias("chapters"),
        F.array(F.lower(F.substring("r_name", 1, 3))).alias("enAlias"),
        F.array().cast("array<string>").alias("cnAlias"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct citation strings from line items; chapters above 12 do not exist."""
    names = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    qty = F.col("l_quantity").cast("int")
    raw = F.concat(
        "r_name",
        F.lit(" "),
        F.col("l_linenumber") * 3,
        F.lit(":"),
        qty,
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-"), qty + 2)).otherwise(""),
    )
    items = table(spark, sf_dir, "lineitem", "l_orderkey").withColumn(
        "r_regionkey", (F.col("l_orderkey") % 5).cast("int")
    )
    # Written out, as else Spark takes the later filters, which parse the string, down to every line item.
    distinct = stage(items.join(names, "r_regionkey").select(raw.alias("raw")).distinct())
    return distinct.select(F.col("raw").alias("query_id"), "raw")


def digit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as the bare digits after a region's name."""
    return table(spark, sf_dir, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("query_id"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("book_idx"),
        F.col("o_orderkey").cast("string").alias("num"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as passages: twenty conversations make a book, turns are the verses.

    Every third turn has no second text.
    """
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations", "conv_id").select(
        (conv * 100 + F.col("turn")).alias("row_idx"),
        *_place(conv),
        F.col("turn").cast("int").alias("verse"),
        F.col("text").alias("text_en"),
        F.when(F.col("turn") % 3 != 2, F.upper("role")).alias("text_cn"),
    )


def _place(conv) -> list:
    """Book and chapter of a conversation."""
    return [
        (F.floor(conv / 20) + 1).cast("int").alias("book_idx"),
        (conv % 20 + 1).cast("int").alias("chapter"),
    ]


def conversation_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of ``conversations``, named after regions: "AFRICA-1x", alias "afr1x".

    The verse count is the number of turns less two, so each last turn is beyond it. A book
    has twenty chapters at most, which bounds the collected list.
    """
    turns = (
        conversations(spark, sf_dir)
        .groupBy("book_idx", "chapter")
        .agg((F.count(F.lit(1)) - 2).cast("int").alias("n"))
    )
    books = turns.groupBy("book_idx").agg(
        F.sort_array(F.collect_list(F.struct("chapter", "n"))).alias("c")
    )
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    idx = F.col("book_idx")
    return books.join(regions, (idx - 1) % 5 == F.col("r_regionkey")).select(
        idx.alias("idx"),
        idx.alias("book_pos"),
        F.concat("r_name", F.lit("-"), idx, F.lit("x")).alias("en"),
        F.when(idx % 2 == 0, F.concat(F.lit("R"), idx)).alias("cn"),
        F.transform("c", lambda x: x.n).alias("chapters"),
        F.array(F.concat(F.lower(F.substring("r_name", 1, 3)), idx, F.lit("x"))).alias("enAlias"),
        F.array().cast("array<string>").alias("cnAlias"),
    )


def asked_conversation(spark: SparkSession, sf_dir: str):
    """Conversation that an event asks for: each of them in turn, and 20 that don't exist."""
    last = table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0]
    return F.col("user_id") % ((last or 0) + 21)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address requests from events; some conversations and turns do not exist."""
    return table(spark, sf_dir, "events", "event_id").select(
        F.col("event_id").alias("query_id"),
        *_place(asked_conversation(spark, sf_dir)),
        (F.col("event_id") % 9).cast("int").alias("verse"),
        (F.col("event_id") % 9 + 2).cast("int").alias("verse_end"),
    )


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query string per event, in six shapes: citation, chapter, digits, unknown book, a word, one letter;
    and one for every word of every turn with the next one, whose ids are negative."""
    names = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    user, event = F.col("user_id"), F.col("event_id")
    e = (
        table(spark, sf_dir, "events", "event_id")
        .withColumn("book", user % 6 + 1)
        .withColumn("r_regionkey", ((F.col("book") - 1) % 5).cast("int"))
        .join(names, "r_regionkey")
    )
    name = F.concat("r_name", F.lit("-"), "book", F.lit("x "))
    alias = F.concat(F.lower(F.substring("r_name", 1, 3)), "book", F.lit("X"))
    shape = event % 6
    letter = (F.floor(event / 6) % F.length("event_type") + 1).cast("int")
    raw = (
        F.when(shape == 0, F.concat(name, user % 23 + 1, F.lit(":"), event % 7))
        .when(shape == 1, F.concat(alias, F.lit(" "), user % 9 + 1))
        .when(shape == 2, F.concat(alias, user))
        .when(shape == 3, F.concat(F.lit("Zed "), user, F.lit(":1")))
        .when(shape == 4, F.col("event_type"))
        .otherwise(F.substring(F.col("event_type"), letter, F.lit(1)))
    )
    turns = table(spark, sf_dir, "conversations", "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row"), F.posexplode(neighbours("text")).alias("pos", "raw")
    )
    place = (-(F.col("row") * PLACES + F.col("pos") + 1)).alias("query_id")
    return e.select(event.alias("query_id"), raw.alias("raw")).unionByName(turns.select(place, "raw"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as shared links; every fourth has no query, the fragment may hold more."""
    page = F.col("page_id")
    bare = F.split(F.col("url"), "#").getItem(0)
    query = F.concat(
        F.lit("q="), F.regexp_extract("url", "/([a-z]+)/", 1), F.lit("%20"), page % 50,
        F.lit("%3A1+2"),
    )
    fragment = (
        F.when(page % 4 == 0, "top").when(page % 4 == 1, F.concat(F.lit("v=1&"), query))
        .otherwise(query)
    )
    return table(spark, sf_dir, "pages").select(F.concat(bare, F.lit("#"), fragment).alias("url"))


def asked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links, and one for the query string of every event."""
    asked = raw_queries(spark, sf_dir).where("query_id >= 0")
    url = F.concat(F.lit("https://shared.example/"), F.col("query_id"), F.lit("#v=2&"), link_of("raw"))
    return links(spark, sf_dir).unionByName(asked.select(url.alias("url")))


# Chinese: every letter stands for a character.

LETTERS = "abcdefghijklmnopqrstuvwxyz"
CHARACTERS = "".join(chr(0x4E00 + 7 * i) for i in range(len(LETTERS)))


def in_characters(text):
    return F.translate(F.lower(text), LETTERS, CHARACTERS)


def conversations_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose second text is the first one in characters; every third turn has none."""
    return conversations(spark, sf_dir).withColumn(
        "text_cn", F.when(F.col("verse") % 3 != 2, in_characters("text_en"))
    )


def conversation_books_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_books(spark, sf_dir).withColumns(
        {"cn": in_characters("en"), "cnAlias": F.transform("enAlias", in_characters)}
    )


def raw_queries_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query strings in characters; those without letters stay as they are."""
    return raw_queries(spark, sf_dir).withColumn("raw", in_characters("raw"))
