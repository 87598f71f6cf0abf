"""From free-text queries to classified, resolved citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    MAX_NUMBER,
    NO_NUMBER,
    WS,
    drop_ws,
    has_cjk,
    language_of,
    normalise_name,
    number_of,
    present,
    trim_ws,
    utf16_length,
)

# The citation grammar. A name, then the longest trailing C, C:V or C:V-V2.
ADDRESS = f"([0-9]+)(?::([0-9]+)(?:{WS}*-{WS}*([0-9]+))?)?"
NAME_AND_NUMBER = (
    f"^([^\\n\\r\\u2028\\u2029]*?)([0-9]+(?::[0-9]+(?:{WS}*-{WS}*[0-9]+)?)?)\\z"
)
# Words shorter than this are not searched in English.
MIN_ENGLISH = 2

_CANDIDATE = "array<struct<chapter:int,verse:int,verse_end:int,has_verse:boolean>>"


def detect_language(df: DataFrame, column: str, out: str = "lang") -> DataFrame:
    return df.withColumn(out, language_of(column))


def alias_dim(books: DataFrame, order: str = "book_pos") -> DataFrame:
    """Aliases ``(alias, kind, book_idx)``; of colliding aliases the last one listed wins.

    English aliases and names are normalised, Chinese ones kept as they are. Within a book
    the display name comes after its aliases.
    """

    def listed(kind: str, names: str, display: str, key) -> DataFrame:
        every = F.concat(
            F.coalesce(F.col(names), F.array().cast("array<string>")),
            F.array(F.col(display)),
        )
        return books.select(
            F.col("idx").alias("book_idx"),
            F.col(order).alias("order"),
            F.posexplode(every).alias("pos", "name"),
        ).select("book_idx", "order", "pos", F.lit(kind).alias("kind"), key("name").alias("alias"))

    both = listed("en", "enAlias", "en", normalise_name).unionByName(
        listed("cn", "cnAlias", "cn", F.col)
    )
    return (
        both.where("alias != ''")
        .groupBy("alias", "kind")
        .agg(F.max_by("book_idx", F.struct("order", "pos")).alias("book_idx"))
    )


def split_name(queries: DataFrame, q: str = "q") -> DataFrame:
    """Add ``name`` (normalised) and ``num``, both empty when the query has no such form.

    Such a form ends with a digit; other queries aren't parsed.
    """
    may = F.col(q).isNull() | F.substring(q, -1, 1).between("0", "9")
    return queries.withColumns(
        {
            "name": F.when(may, normalise_name(F.regexp_extract(q, NAME_AND_NUMBER, 1))).otherwise(""),
            "num": F.when(may, F.regexp_extract(q, NAME_AND_NUMBER, 2)).otherwise(""),
        }
    )


def match_alias_exact(queries: DataFrame, aliases: DataFrame, q: str = "q") -> DataFrame:
    """Look up the name before the trailing number; ``book_idx`` is null without a match.

    ``aliases`` is the English part of alias_dim. Broadcasting it is left to Spark, which
    does so only below its size threshold.
    """
    names = aliases.select(F.col("alias").alias("name"), "book_idx")
    return split_name(queries, q).join(names, "name", "left").drop("name")


def match_alias_prefix(
    queries: DataFrame, aliases: DataFrame, query_id: str = "query_id", q: str = "q"
) -> DataFrame:
    """Find the longest alias that starts the query; the remainder becomes ``num``.

    Only prefixes as long as some alias are tried, so this is an equi-join: the distinct
    alias lengths come in as one scalar. Other columns of ``queries`` are kept.
    """
    lengths = aliases.agg(F.collect_set(F.length("alias"))).scalar()
    tried = F.filter("_lengths", lambda n: n <= F.length(q))
    kept = [c for c in queries.columns if c != query_id]
    heads = (
        queries.withColumn("_lengths", lengths)
        .withColumn("_n", F.explode_outer(tried))
        .withColumn("_alias", F.substring(F.col(q), F.lit(1), F.col("_n")))
        .drop("_lengths")
    )
    found = heads.join(
        aliases.select(F.col("alias").alias("_alias"), "book_idx"), "_alias", "left"
    )
    # The prefixes of one query are at most as many as there are alias lengths, and they
    # start in one task, so the map-side combine leaves one row per query to shuffle.
    length = F.when(F.col("book_idx").isNotNull(), F.col("_n"))
    best = found.groupBy(query_id).agg(
        F.max(F.struct(length.alias("n"), F.col("book_idx"), *kept)).alias("m")
    )
    rest = F.when(
        F.col("m.n").isNotNull(),
        trim_ws(F.substring(F.col(f"m.{q}"), F.col("m.n") + 1, F.length(f"m.{q}"))),
    )
    return best.select(
        query_id, *[F.col(f"m.{c}").alias(c) for c in kept], "m.book_idx", rest.alias("num")
    )


def _address(num: Column | str) -> dict[str, Column]:
    whole = f"^{ADDRESS}\\z"

    def part(i: int, beyond: int = NO_NUMBER) -> Column:
        return number_of(present(F.regexp_extract(num, whole, i)), beyond)

    return {
        "chapter": part(1),
        "verse": part(2),
        "verse_end": part(3, MAX_NUMBER),
        "has_verse": part(2).isNotNull(),
    }


def parse_address(df: DataFrame, num: str = "num") -> DataFrame:
    """Add chapter, verse, verse_end and has_verse; chapter is null when ``num`` is no address.

    Blanks may stand around '-' only. A chapter or verse too large for INT becomes NO_NUMBER,
    which no row has (a null verse means the whole chapter); such a range end bounds nothing.
    """
    return df.withColumns(_address(num))


def _chapter_ok(chapter: Column, chapters: Column) -> Column:
    n = F.size(F.coalesce(chapters, F.array().cast("array<int>")))
    return chapter.isNotNull() & ((n == 0) | chapter.between(1, n))


def validate_address(df: DataFrame, books: DataFrame) -> DataFrame:
    """Keep addresses whose book exists and whose chapter the book has.

    Verses are not checked here: an unknown verse is a citation without rows. A book without
    chapter data accepts any chapter.
    """
    dims = books.select(F.col("idx").alias("book_idx"), "chapters")
    return (
        df.where("book_idx != 0")
        .join(dims, "book_idx")
        .where(_chapter_ok(F.col("chapter"), F.col("chapters")))
        .drop("chapters")
    )


def _readings(digits: Column, chapters: Column) -> Column:
    """Ordered chapter and chapter/verse readings of a bare digit string.

    A verse has no leading zero and at most ten digits, so only the last ten split points
    can give one, however long the string is.
    """
    size = F.length(digits)
    n = F.size(F.coalesce(chapters, F.array().cast("array<int>")))

    def reading(chapter: Column, verse: Column) -> Column:
        return F.struct(
            verse.isNotNull().alias("is_verse"),
            chapter.alias("chapter"),
            verse.cast("int").alias("verse"),
        )

    whole = F.array(reading(number_of(digits), F.lit(None)))
    cuts = F.when(
        size > 1, F.sequence(F.greatest(size - 10, F.lit(1)), size - 1)
    ).otherwise(F.array().cast("array<int>"))
    splits = F.transform(
        cuts,
        lambda i: reading(
            number_of(F.substring(digits, F.lit(1), i)),
            F.when(
                (F.substring(digits, i + 1, F.lit(1)) != "0") | (i == size - 1),
                number_of(F.substring(digits, i + 1, size)),
            ),
        ),
    )
    plausible = F.filter(
        F.concat(
            F.filter(whole, lambda r: r.chapter.between(1, n)),
            F.filter(
                splits,
                lambda r: r.is_verse
                & r.chapter.between(1, n)
                & r.verse.between(1, F.coalesce(F.get(chapters, r.chapter - 1), F.lit(0))),
            ),
        ),
        lambda r: r.chapter.isNotNull(),
    )
    return F.array_sort(F.array_distinct(plausible))


def expand_fuzzy(df: DataFrame, books: DataFrame, digits: str = "num") -> DataFrame:
    """One row per reading of the digits: ``chapter, verse, cand_rank, n_cand``.

    The whole number as a chapter comes first, then splits by chapter and verse. There are
    at most eleven readings, built per row without a shuffle.
    """
    dims = books.select(F.col("idx").alias("book_idx"), "chapters")
    return (
        df.where(F.col(digits).rlike("^[0-9]+\\z"))
        .join(dims, "book_idx")
        .withColumn("_r", _readings(F.col(digits), F.col("chapters")))
        .withColumn("n_cand", F.size("_r"))
        .select(
            *df.columns, "n_cand", F.posexplode("_r").alias("_pos", "_c")
        )
        .select(
            *df.columns,
            F.col("_c.chapter").alias("chapter"),
            F.col("_c.verse").alias("verse"),
            (F.col("_pos") + 1).alias("cand_rank"),
            "n_cand",
        )
    )


def classify_queries(
    queries: DataFrame,
    books: DataFrame,
    query_id: str = "query_id",
    raw: str = "raw",
    order: str = "book_pos",
) -> DataFrame:
    """Tag every query ref, fuzzy, word, too_short or empty and resolve the citations.

    One row per query, or per candidate for fuzzy ones: ``query_id, kind, book_idx, chapter,
    verse, verse_end, has_verse, cand_rank, term, lang``. Matching keeps unmatched queries
    (outer joins), so the result needs no join back to ``queries``.
    """
    aliases = alias_dim(books, order)
    base = queries.select(
        F.col(query_id), F.coalesce(trim_ws(raw), F.lit("")).alias("term")
    )
    english = match_alias_exact(
        base.where(~has_cjk("term")), aliases.where("kind = 'en'"), "term"
    )
    chinese = match_alias_prefix(
        base.where(has_cjk("term")), aliases.where("kind = 'cn'"), query_id, "term"
    )
    matched = english.unionByName(chinese).withColumn(
        "book_idx", F.when(F.col("book_idx") != 0, F.col("book_idx"))
    )
    dims = books.select(F.col("idx").alias("book_idx"), "chapters")
    known = matched.join(dims.withColumn("known", F.lit(True)), "book_idx", "left")

    none = F.array().cast(_CANDIDATE)
    exact = _address("num")
    chapters = F.col("chapters")
    explicit = F.when(
        _chapter_ok(exact["chapter"], chapters),
        F.array(F.struct(*[c.alias(k) for k, c in exact.items()])),
    )
    digits = F.transform(
        _readings(F.col("num"), chapters),
        lambda r: F.struct(
            r.chapter.alias("chapter"),
            r.verse.alias("verse"),
            F.lit(None).cast("int").alias("verse_end"),
            r.is_verse.alias("has_verse"),
        ),
    )
    readings = F.when(
        F.col("known") & F.col("num").contains(":"), explicit.cast(_CANDIDATE)
    ).when(F.col("known") & F.col("num").rlike("^[0-9]+\\z"), digits.cast(_CANDIDATE))
    kind = (
        F.when(F.size("_r") > 1, "fuzzy")
        .when(F.size("_r") == 1, "ref")
        .when(F.col("term") == "", "empty")
        .when(
            (F.col("lang") == "en") & (utf16_length(drop_ws("term")) < MIN_ENGLISH), "too_short"
        )
        .otherwise("word")
    )
    return (
        known.withColumn("_r", F.coalesce(readings, none))
        .withColumn("lang", language_of("term"))
        .withColumn("kind", kind)
        .select(
            query_id, "kind", "book_idx", "term", "lang", F.posexplode_outer("_r").alias("p", "c")
        )
        .select(
            query_id,
            "kind",
            F.when(F.col("p").isNotNull(), F.col("book_idx")).alias("book_idx"),
            "c.chapter",
            "c.verse",
            "c.verse_end",
            "c.has_verse",
            (F.col("p") + 1).alias("cand_rank"),
            "term",
            "lang",
        )
    )


def resolve_citations(
    queries: DataFrame, books: DataFrame, query_id: str = "query_id", raw: str = "raw",
    order: str = "book_pos",
) -> DataFrame:
    """The citations among the queries: one row per query and candidate."""
    return classify_queries(queries, books, query_id, raw, order).where(
        "kind in ('ref', 'fuzzy')"
    )


def candidate_counts(resolved: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Number of readings per fuzzy query."""
    return (
        resolved.where("kind = 'fuzzy'")
        .groupBy(query_id)
        .agg(F.count(F.lit(1)).alias("n_cand"))
    )
