"""Shaping results for output: display text, highlighting, views and export lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    MARK_CLOSE,
    MARK_OPEN,
    escape_html,
    present,
    caseless_regex,
    split_ws,
    trim_ws,
)
from .lookup import (
    attach_rows,
    chapter_title,
    label_rows,
    lookup_chapter,
    resolve_candidates,
    sibling_chapter,
)
from .search import Corpus

# Fixed values of the output formats.
MARK = ("<mark>", "</mark>")
ENGLISH_NOTE = " (EN)"
LABEL_GAP = "  "


def _code(lang: str | Column) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang


def display_text(lang: str | Column, en: str = "text_en", cn: str = "text_cn") -> Column:
    """Text in the display language; Chinese falls back to English, not the reverse."""
    return F.coalesce(F.when(_code(lang) == "cn", present(cn)), F.col(en))


def pick_text(rows: DataFrame, lang: str | Column, en: str = "text_en", cn: str = "text_cn",
              out: str = "text") -> DataFrame:
    return rows.withColumn(out, display_text(lang, en, cn))


def translation_missing(lang: str | Column = "cn", cn: str = "text_cn") -> Column:
    return (_code(lang) == "cn") & present(cn).isNull()


def missing_translation(rows: DataFrame, lang: str | Column = "cn", cn: str = "text_cn",
                        out: str = "cn_missing") -> DataFrame:
    """Flag rows shown in Chinese that have no Chinese text."""
    return rows.withColumn(out, translation_missing(lang, cn))


def marked(text: Column | str, term: Column | str) -> Column:
    """HTML of a text with every part of the term, and the whole term, in <mark>.

    Parts are the whitespace-separated pieces of the term, matched without regard to case,
    longest first. Matches are bracketed in the plain text and the text escaped after that,
    so a part can never match inside an entity.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # noncharacters that no text should hold; translate looks at every character, so others pass it by
    held = t.contains(MARK_OPEN) | t.contains(MARK_CLOSE)
    t = F.when(held, F.translate(t, MARK_OPEN + MARK_CLOSE, "\ufffd\ufffd")).otherwise(t)
    q = trim_ws(term)
    pieces = split_ws(q)
    every = F.array_distinct(F.when(F.size(pieces) > 1, F.concat(F.array(q), pieces)).otherwise(pieces))
    longest_first = F.array_sort(every, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(
        F.lit("(?iu)"), F.array_join(F.transform(longest_first, caseless_regex), "|")
    )
    bracketed = F.regexp_replace(t, pattern, F.lit(f"{MARK_OPEN}$0{MARK_CLOSE}"))
    html = escape_html(bracketed)
    html = F.replace(html, F.lit(MARK_OPEN), F.lit(MARK[0]))
    html = F.replace(html, F.lit(MARK_CLOSE), F.lit(MARK[1]))
    return F.when(F.coalesce(q, F.lit("")) == "", escape_html(t)).otherwise(html)


def highlight(rows: DataFrame, text: str, term: str | Column, out: str = "html") -> DataFrame:
    return rows.withColumn(out, marked(text, term))


def interlinear(rows: DataFrame, en: str = "text_en", cn: str = "text_cn") -> DataFrame:
    """Two lines per row, English then Chinese; a Chinese gap shows English marked so.

    Keeps the rows' other columns and adds ``line_no, line_lang, line``.
    """
    chinese = F.coalesce(present(cn), F.concat(F.col(en), F.lit(ENGLISH_NOTE)))
    lines = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("en").alias("lang"), F.col(en).alias("line")),
        F.struct(F.lit(2).alias("n"), F.lit("cn").alias("lang"), chinese.alias("line")),
    )
    kept = [c for c in rows.columns if c not in (en, cn)]
    return rows.select(*kept, F.explode(lines).alias("l")).select(
        *kept,
        F.col("l.n").alias("line_no"),
        F.col("l.lang").alias("line_lang"),
        F.col("l.line").alias("line"),
    )


def hit_view(
    hits: DataFrame, passages: DataFrame, books: DataFrame, lang: str | Column, term: str | Column
) -> DataFrame:
    """Hits with ``label``, ``html`` (text with the term marked) and ``cn_missing``.

    ``lang`` and ``term`` may be columns, so every hit can follow its query's language.
    """
    columns = ["book_idx", "chapter", "verse", "text_en", "text_cn"]
    rows = label_rows(attach_rows(hits, passages, columns), books, lang)
    return rows.select(
        *hits.columns,
        "label",
        marked(display_text(lang), term if isinstance(term, Column) else F.lit(term)).alias("html"),
        translation_missing(lang).alias("cn_missing"),
    )


def chapter_view(
    refs: DataFrame, corpus: Corpus, books: DataFrame, lang: str | Column = "en"
) -> DataFrame:
    """Each ref's whole chapter with title, verses and the rows to step to.

    Adds ``title, verse, row_idx, text_en, text_cn, text, prev_row, next_row``; verse order
    is the display order.
    """
    asked = refs
    for direction, out in ((-1, "prev_row"), (1, "next_row")):
        asked = sibling_chapter(asked, corpus.addresses, books, direction).withColumnRenamed(
            "sibling_row", out
        )
    rows = lookup_chapter(asked, corpus.addresses, books)
    texts = attach_rows(rows, corpus.passages, ["text_en", "text_cn"])
    return pick_text(chapter_title(texts, books, lang), lang)


def fuzzy_view(
    resolved: DataFrame, corpus: Corpus, books: DataFrame, lang: str | Column = "en"
) -> DataFrame:
    """Found candidates of fuzzy citations: a title for chapters, label and text for verses."""
    found = resolve_candidates(resolved.where("kind = 'fuzzy'"), corpus.addresses)
    texts = attach_rows(found, corpus.passages, ["text_en", "text_cn"])
    named = chapter_title(label_rows(texts, books, lang), books, lang)
    chapter = F.col("cand_kind") == "chapter"
    return named.select(
        "query_id",
        "cand_rank",
        "cand_kind",
        "row_idx",
        F.when(chapter, F.col("title")).otherwise(F.col("label")).alias("label"),
        F.when(~chapter, display_text(lang)).alias("text"),
    )


def export_lines(
    rows: DataFrame, books: DataFrame, lang: str | Column = "en", both: bool = False
) -> DataFrame:
    """Add ``line``: label, two blanks, text; with ``both``, an English and a Chinese line.

    A missing text is empty: label and blanks stay.

    ``rows`` are passages. Write the lines in canonical order with sources.export.
    """
    gap = F.lit(LABEL_GAP)
    if not both:
        line = F.concat("label", gap, F.coalesce(display_text(lang), F.lit("")))
        return label_rows(rows, books, lang).withColumn("line", line).drop("label")
    en = label_rows(rows, books, "en").withColumnRenamed("label", "_en")
    named = label_rows(en, books, "cn")
    en_text, cn_text = (F.coalesce(c, F.lit("")) for c in (F.col("text_en"), display_text("cn")))
    line = F.concat("_en", gap, en_text, F.lit("\n"), "label", gap, cn_text)
    return named.withColumn("line", line).drop("_en", "label")


def select_rows(rows: DataFrame, keys: DataFrame, key: str = "row_idx") -> DataFrame:
    """Only the rows whose key was selected."""
    return rows.join(keys.select(key), key, "left_semi")
