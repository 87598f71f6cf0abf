import re

import pytest
from pyspark.sql import functions as F

from lectern.operators.citations import resolve_citations
from lectern.operators.present import (
    chapter_view,
    export_lines,
    fuzzy_view,
    highlight,
    hit_view,
    interlinear,
    missing_translation,
    pick_text,
    select_rows,
)
from lectern.operators.search import search

MARKS = [
    ("One spirit, one Spirit", "one spirit", "<mark>One spirit</mark>, <mark>one Spirit</mark>"),
    ("spirit one", "one spirit", "<mark>spirit</mark> <mark>one</mark>"),
    ("onespirit", "one  spirit", "<mark>one</mark><mark>spirit</mark>"),
    ("a<b & c", "<b", "a<mark>&lt;b</mark> &amp; c"),
    ("R&D", "amp", "R&amp;D"),
    ("R&D", "&", "R<mark>&amp;</mark>D"),
    ("a.b*c", ".", "a<mark>.</mark>b*c"),
    ("x(1)[2]\\E", "(1) \\E [2]", "x<mark>(1)</mark><mark>[2]</mark><mark>\\E</mark>"),
    ("cost $1", "$1", "cost <mark>$1</mark>"),
    ("ÉTÉ", "é", "<mark>É</mark>T<mark>É</mark>"),
    ("神爱世人", "爱 世人", "神<mark>爱</mark><mark>世人</mark>"),
    ("plain <b>", "", "plain &lt;b&gt;"),
    ("plain", " 　 ", "plain"),
    ("ab abc", "ab abc", "<mark>ab abc</mark>"),
    ("abc ab", "ab abc", "<mark>abc</mark> <mark>ab</mark>"),
]


def test_highlight(spark):
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(MARKS)], "i int, t string, q string")
    got = [r.html for r in highlight(df, "t", "q").orderBy("i").collect()]
    assert got == [m for _, _, m in MARKS]


def test_highlight_keeps_the_text(spark):
    df = spark.createDataFrame([(t, q) for t, q, _ in MARKS], "t string, q string")
    for r in highlight(df, "t", "q").collect():
        bare = re.sub("</?mark>", "", r.html)
        assert bare.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") == r.t


def test_display_text_and_gaps(verses):
    cn = {r.row_idx: r.text for r in pick_text(verses, "cn").collect()}
    assert cn[0] == "诗歌" and cn[2] == "One spiritual word & <another> one"
    en = {r.row_idx: r.text for r in pick_text(verses, "en").collect()}
    assert en[11] is None
    gaps = {r.row_idx for r in missing_translation(verses).where("cn_missing").collect()}
    assert gaps == {2, 4}
    assert missing_translation(verses, "en").where("cn_missing").count() == 0


def test_interlinear(verses):
    rows = interlinear(verses.where("row_idx in (0, 2)")).orderBy("row_idx", "line_no").collect()
    assert [(r.row_idx, r.line_lang, r.line) for r in rows] == [
        (0, "en", "A psalm of one spirit"),
        (0, "cn", "诗歌"),
        (2, "en", "One spiritual word & <another> one"),
        (2, "cn", "One spiritual word & <another> one (EN)"),
    ]


def test_export(spark, verses, canon):
    keys = spark.createDataFrame([(2,), (8,), (2,), (99,)], "row_idx long")
    rows = select_rows(verses, keys)
    one = {r.row_idx: r.line for r in export_lines(rows, canon, "cn").collect()}
    assert one == {
        2: "一书 1:3  One spiritual word & <another> one",
        8: "Four 1:1  督基",
    }
    two = {r.row_idx: r.line for r in export_lines(rows, canon, both=True).collect()}
    assert two[8] == "Four 1:1  R&D amp lamp\nFour 1:1  督基"
    assert two[2].split("\n")[1] == "一书 1:3  One spiritual word & <another> one"


def test_hit_view(spark, corpus, verses, canon):
    rows = [(1, "one spirit", "en"), (2, "爱 神", "cn")]
    asked = spark.createDataFrame(rows, "query_id int, term string, lang string")
    hits = search(corpus, asked, 2, keep=["term", "lang"])
    got = hit_view(hits, verses, canon, F.col("lang"), F.col("term")).orderBy("query_id", "rank")
    assert [(r.label, r.html, r.cn_missing) for r in got.collect()] == [
        ("One 1:0", "A psalm of <mark>one spirit</mark>", False),
        ("One 1:1", "They were joined to the Lord in <mark>one spirit</mark>", False),
        ("一书 1:9", "<mark>爱</mark><mark>神</mark>", False),
        ("三书 1:2", "世人<mark>爱</mark><mark>神</mark> <mark>神</mark><mark>爱</mark>", False),
    ]


def test_chapter_view(spark, corpus, canon):
    asked = spark.createDataFrame([(1, 1, 1), (2, 3, 1), (3, 4, 1)], "query_id int, book_idx int, chapter int")
    rows = chapter_view(asked, corpus, canon, "cn").orderBy("query_id", "verse").collect()
    got = [(r.query_id, r.title, r.verse, r.text, r.prev_row, r.next_row) for r in rows]
    assert got == [
        (1, "一书 1", 0, "诗歌", None, 4),
        (1, "一书 1", 1, "神爱世人", None, 4),
        (1, "一书 1", 3, "One spiritual word & <another> one", None, 4),
        # The chapter before, the third of book One, has no verses: no step back.
        (2, "三书 1", 1, "基督的爱", None, 8),
        (2, "三书 1", 2, "世人爱神 神爱", None, 8),
        (3, "Four 1", 1, "督基", 10, 9),
    ]


def test_fuzzy_view(spark, corpus, canon):
    queries = spark.createDataFrame([(1, "one 22"), (2, "one 2"), (3, "one 12"), (4, "one 11")], "query_id int, raw string")
    resolved = resolve_citations(queries, canon)
    assert fuzzy_view(resolved, corpus, canon).count() == 0
    books = canon.withColumn("chapters", F.when(F.col("idx") == 1, F.array(*[F.lit(9)] * 12).cast("array<int>")).otherwise(F.col("chapters")))
    got = fuzzy_view(resolve_citations(queries, books), corpus, books).collect()
    # "12" is chapter 12, which has no rows, or 1:2, which is missing; "11" is 1:1 as well.
    assert [(r.query_id, r.cand_rank, r.cand_kind, r.label, r.text) for r in got] == [
        (4, 2, "verse", "One 1:1", "They were joined to the Lord in one spirit"),
    ]


@pytest.mark.parametrize("lang", ["en", "cn"])
def test_no_view_loses_rows(corpus, verses, canon, lang):
    hits = verses.select("row_idx", F.lit("x").alias("term"))
    assert hit_view(hits, verses, canon, lang, "term").count() == verses.count()
