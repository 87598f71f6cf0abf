"""From citations and rows to corpus rows: points, ranges, chapters, neighbours, labels.

Columns follow the data model: passages and addresses have ``book_idx, chapter, verse,
row_idx``; requests have ``book_idx, chapter`` and their own further columns, which are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage
from .skew import ROWS_PER_SALT, salted_join

ADDRESS = ["book_idx", "chapter", "verse"]
# Verses per block of the range join.
VERSE_BLOCK = 32
# Books per block when neighbours are sought.
BOOK_BLOCK = 4096


def _verse_count(chapter: Column, chapters: Column) -> Column:
    return F.coalesce(F.get(chapters, chapter - 1), F.lit(0))


def lookup_point(
    refs: DataFrame, addresses: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Row of each (book, chapter, verse); an address many refs ask for is salted."""
    rows = addresses.select(*ADDRESS, "row_idx")
    kept = [c for c in refs.columns if c not in ADDRESS]
    return salted_join(
        refs.where("verse is not null"), rows, ADDRESS, kept or ADDRESS,
        rows_per_salt=rows_per_salt,
    )


def rows_between(
    refs: DataFrame,
    addresses: DataFrame,
    lo: str,
    hi: str,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Rows with ``lo <= verse <= hi`` of each ref's chapter, as an equi-join on verse blocks.

    Both sides are cut into blocks of VERSE_BLOCK verses, so the join key is (book, chapter,
    block): a huge chapter is spread over many keys, and an address holding one row, no block
    has more than VERSE_BLOCK rows. Blocks that many refs ask for are salted. The end is
    first cut to the largest verse of the ref's own chapter, so an open range costs no more than that
    chapter. A start below zero stands for no verse.
    """
    tops = addresses.groupBy("book_idx", "chapter").agg(F.max("verse").alias("_top"))
    end = F.least(F.col(hi), F.col("_top"))
    blocks = F.sequence(
        F.floor(F.col(lo) / VERSE_BLOCK).cast("int"), F.floor(end / VERSE_BLOCK).cast("int")
    )
    asked = (
        refs.join(tops, ["book_idx", "chapter"])
        .select(*refs.columns, "_top")
        .where((F.col(lo) >= 0) & (F.col(lo) <= end))
        .withColumn("_block", F.explode(blocks))
        .drop("_top")
    )
    rows = addresses.select(
        "book_idx",
        "chapter",
        F.col("verse").alias("_verse"),
        "row_idx",
        F.floor(F.col("verse") / VERSE_BLOCK).cast("int").alias("_block"),
    )
    key = ["book_idx", "chapter", "_block"]
    joined = salted_join(
        asked, rows, key, [c for c in refs.columns], rows_per_salt=rows_per_salt
    )
    return joined.where(F.col("_verse").between(F.col(lo), F.col(hi)))


def lookup_range(
    refs: DataFrame, addresses: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Rows of verse..verse_end; missing verses are skipped, a reversed range has no rows.

    Keeps the refs' columns, with ``verse`` now the found verse.
    """
    kept = [c for c in refs.columns if c not in ("verse", "verse_end")]
    asked = refs.where("verse is not null").select(
        *kept,
        F.col("verse").alias("_lo"),
        F.coalesce("verse_end", "verse").alias("_hi"),
    )
    found = rows_between(asked, addresses, "_lo", "_hi", rows_per_salt)
    return found.select(*kept, F.col("_verse").alias("verse"), "row_idx")


def with_chapter_end(refs: DataFrame, books: DataFrame, out: str = "_hi") -> DataFrame:
    """Attach the dimension's verse count of each ref's chapter; unknown books drop out."""
    dims = books.select(F.col("idx").alias("book_idx"), "chapters")
    return (
        refs.join(dims, "book_idx")
        .withColumn(out, _verse_count(F.col("chapter"), F.col("chapters")))
        .drop("chapters")
    )


def lookup_chapter(
    refs: DataFrame,
    addresses: DataFrame,
    books: DataFrame,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """All rows of each ref's chapter, from verse 0 to the dimension's verse count.

    Verse order is the output order: an existing verse 0 comes first. Verses above the
    dimension's count are left out.
    """
    kept = [c for c in refs.columns if c not in ("verse", "verse_end")]
    asked = with_chapter_end(refs.select(*kept), books).withColumn("_lo", F.lit(0))
    found = rows_between(asked, addresses, "_lo", "_hi", rows_per_salt)
    return found.select(*kept, F.col("_verse").alias("verse"), "row_idx")


def resolve_candidates(
    resolved: DataFrame, addresses: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Rows of fuzzy candidates; a whole chapter is anchored at verse 1, misses drop out.

    ``cand_kind`` tells chapter from verse candidates; ``cand_rank`` is kept.
    """
    asked = resolved.withColumns(
        {
            "cand_kind": F.when(F.col("verse").isNull(), "chapter").otherwise("verse"),
            "verse": F.coalesce("verse", F.lit(1)),
        }
    )
    return lookup_point(asked, addresses, rows_per_salt)


def attach_rows(
    hits: DataFrame,
    passages: DataFrame,
    columns: list[str],
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join passage columns to hits by ``row_idx``; rows hit very often are salted."""
    kept = [c for c in hits.columns if c != "row_idx"]
    return salted_join(
        hits,
        passages.select("row_idx", *columns),
        ["row_idx"],
        kept or ["row_idx"],
        rows_per_salt=rows_per_salt,
    )


def chapter_context(
    hits: DataFrame, passages: DataFrame, books: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """All rows of the chapter each hit belongs to; the hit's row becomes ``hit_row``."""
    from ..sources.corpus import address_dim

    kept = [c for c in hits.columns if c != "row_idx"]
    placed = attach_rows(hits, passages, ["book_idx", "chapter"], rows_per_salt)
    asked = placed.select(*kept, F.col("row_idx").alias("hit_row"), "book_idx", "chapter")
    return lookup_chapter(asked, stage(address_dim(passages)), books, rows_per_salt)


def first_rows(addresses: DataFrame, books: DataFrame) -> DataFrame:
    """First existing row of every chapter, among verses 0 to the dimension's count."""
    first = (
        addresses.where("verse >= 0")
        .groupBy("book_idx", "chapter")
        .agg(F.min_by("row_idx", "verse").alias("sibling_row"), F.min("verse").alias("_first"))
    )
    # Joined to the dimension by chapter, after the rows are combined, so a huge book is small.
    return with_chapter_end(first, books).where("_first <= _hi").drop("_first", "_hi")


def adjacent_books(books: DataFrame, direction: int, block: int = BOOK_BLOCK) -> DataFrame:
    """For each book the nearest following (or preceding) one that has chapters.

    Books without chapters are stepped over; a gap in ``idx`` ends the walk. Positions and
    nearest neighbours are first found inside blocks of ``idx``; only one summary row per
    block takes part in the window over the whole dimension.
    """
    step = F.col("idx") * direction
    n_chapters = F.size(F.coalesce("chapters", F.array().cast("array<int>")))
    b = books.select(
        step.alias("at"), n_chapters.alias("n"), F.floor(step / block).alias("block")
    )
    inside = W.partitionBy("block").orderBy("at")
    later = inside.rowsBetween(1, W.unboundedFollowing)
    full = F.when(F.col("n") > 0, F.struct("at", "pos", "n"))
    numbered = b.withColumn("pos", F.row_number().over(inside)).withColumn(
        "next", F.first(full, ignorenulls=True).over(later)
    )
    order = W.orderBy("block")
    summary = (
        numbered.groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min_by(full, F.when(F.col("n") > 0, F.col("at"))).alias("first"),
        )
        .withColumn(
            "start",
            F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    shifted = F.when(
        F.col("first").isNotNull(),
        F.struct(
            F.col("first.at").alias("at"),
            (F.col("first.pos") + F.col("start")).alias("pos"),
            F.col("first.n").alias("n"),
        ),
    )
    summary = summary.withColumn(
        "beyond",
        F.first(shifted, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)),
    ).select("block", "start", "beyond")
    target_at = F.coalesce("next.at", "beyond.at")
    target_pos = F.coalesce(F.col("next.pos") + F.col("start"), F.col("beyond.pos"))
    unbroken = target_pos - (F.col("pos") + F.col("start")) == target_at - F.col("at")
    return (
        numbered.join(summary, "block")
        .where(unbroken)
        .select(
            (F.col("at") * direction).alias("book_idx"),
            (target_at * direction).alias("to_book"),
            F.coalesce("next.n", "beyond.n").alias("to_chapters"),
        )
    )


def sibling_chapter(
    chapters: DataFrame,
    addresses: DataFrame,
    books: DataFrame,
    direction: int,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Add ``sibling_row``: the first row of the next (+1) or previous (-1) chapter.

    ``chapters`` has ``book_idx, chapter`` and columns of its own. The step crosses books; at
    the ends of the canon, or when the chapter stepped to has no row, it is null.
    """
    if direction not in (1, -1):
        raise ValueError("direction must be 1 or -1")
    n = F.size(F.coalesce("chapters", F.array().cast("array<int>")))
    dims = books.select(F.col("idx").alias("book_idx"), n.alias("_n")).join(
        adjacent_books(books, direction), "book_idx", "left"
    )
    step = F.col("chapter") + direction
    stays = step.between(1, F.col("_n"))
    edge = F.lit(1) if direction > 0 else F.col("to_chapters")
    target = first_rows(addresses, books).select(
        F.col("book_idx").alias("_b"), F.col("chapter").alias("_c"), "sibling_row"
    )
    # Chapters, not the rows asking, go through the joins; the answers are spread at the end.
    chapters = stage(chapters)
    counts = chapters.groupBy("book_idx", "chapter").agg(F.count(F.lit(1)).alias("n"))
    steps = (
        counts.select("book_idx", "chapter")
        .join(dims, "book_idx", "left")
        .withColumn("_b", F.when(stays, F.col("book_idx")).otherwise(F.col("to_book")))
        .withColumn("_c", F.when(stays, step).otherwise(F.when(F.col("_b").isNotNull(), edge)))
        .join(target, ["_b", "_c"], "left")
        .select("book_idx", "chapter", "sibling_row")
    )
    return salted_join(
        chapters, steps, ["book_idx", "chapter"], chapters.columns, "left", counts,
        rows_per_salt=rows_per_salt,
    )


def book_name(lang: str | Column) -> Column:
    """Display name from the dimension; Chinese falls back to English.

    ``lang`` is a language code or a column of codes.
    """
    code = F.lit(lang) if isinstance(lang, str) else lang
    cn = F.when(code == "cn", F.nullif(F.col("cn"), F.lit("")))
    return F.coalesce(cn, F.col("en"))


def _name_of(rows: DataFrame, books: DataFrame, lang: str | Column) -> DataFrame:
    names = books.select(F.col("idx").alias("book_idx"), "en", "cn")
    return rows.join(names, "book_idx").withColumn("_name", book_name(lang)).drop("en", "cn")


def label_rows(rows: DataFrame, books: DataFrame, lang: str | Column = "en") -> DataFrame:
    """Add ``label``: "Book chapter:verse"."""
    label = F.concat("_name", F.lit(" "), "chapter", F.lit(":"), "verse")
    return _name_of(rows, books, lang).withColumn("label", label).drop("_name")


def chapter_title(rows: DataFrame, books: DataFrame, lang: str | Column = "en") -> DataFrame:
    """Add ``title``: "Book chapter"."""
    title = F.concat("_name", F.lit(" "), "chapter")
    return _name_of(rows, books, lang).withColumn("title", title).drop("_name")
