"""Silent loss, wrong hits and over-wide marks that must not come back."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import present
from lectern.operators.citations import parse_address
from lectern.operators.lookup import rows_between
from lectern.operators.search import index_corpus, search_terms
from lectern.sources.corpus import read_books, read_passages


def test_a_number_too_large_is_no_other_number(spark):
    nums = ["1:9999999999", "1:2147483647", "1:5-99999999999", "9999999999:1", "1:" + "9" * 40]
    rows = parse_address(spark.createDataFrame([(n,) for n in nums], "num string")).collect()
    assert [(r["chapter"], r["verse"], r["verse_end"]) for r in rows] == [
        (1, -1, None), (1, 2147483647, None), (1, 5, 2147483647), (-1, 1, None), (1, -1, None),
    ]
    assert all(r["has_verse"] for r in rows)


def test_an_open_range_costs_its_own_chapter(spark):
    cells = [(1, 1, v, v) for v in range(5)] + [(2, 1, 2_000_000_000, 9)]
    addresses = spark.createDataFrame(cells, "book_idx int, chapter int, verse int, row_idx long")
    refs = spark.createDataFrame(
        [(1, 1, 1, 2, 2147483647), (2, 1, 1, -1, 2147483647), (3, 9, 9, 0, 5)],
        "query_id int, book_idx int, chapter int, lo int, hi int",
    )
    found = rows_between(refs, addresses, "lo", "hi").select("query_id", "row_idx").collect()
    assert sorted(map(tuple, found)) == [(1, 2), (1, 3), (1, 4)]


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('[[1, 1, 1, "x", null]]')
    (tmp_path / "b.json").write_text('[[1, 1, 2, "y", nul')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_passages(spark, str(tmp_path / "*.json")).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_books(spark, str(tmp_path / "b.json")).collect()


def test_a_language_without_index_is_an_error(spark, verses):
    terms = spark.createDataFrame([("cn:\u795e", 1)], "term string, n long")
    with pytest.raises(ValueError, match="cn"):
        search_terms(index_corpus(verses, ("en",)), terms)
    assert search_terms(index_corpus(verses, ()), terms.limit(0)).collect() == []


def test_lines_keep_their_label(canon, verses):
    lines = {r["row_idx"]: r["line"] for r in present.export_lines(verses, canon, "cn", both=True).collect()}
    assert all(lines.values()) and lines[11].split("\n")[0].endswith("  ") and lines[11].endswith("\u7231\u4eba\u795e\u7231")


def test_marks_fold_as_asked(spark):
    rows = [("i", "I\u0131\u0130i"), ("s", "S\u017f"), ("k", "\u212aK"), ("\u00e9.", "\u00c9. \u00e9x"), ("\u017f", "s\u017f")]
    rows += [("a", "\ufdd0a\ufdd1"), ("a\\E*b", "xA\\e*By"), ("a", None)]
    df = spark.createDataFrame(rows, "q string, t string")
    got = [r["h"] for r in df.select(present.marked("t", F.col("q")).alias("h")).collect()]
    open_, close = present.MARK
    assert [h.replace(open_, "<").replace(close, ">") for h in got] == [
        "<I>\u0131\u0130<i>", "<S>\u017f", "\u212a<K>", "<\u00c9.> \u00e9x", "s<\u017f>",
        "\ufffd<a>\ufffd", "x<A\\e*B>y", "",
    ]
