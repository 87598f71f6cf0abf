from pyspark.sql import functions as F

from lectern.functions.grams import ngrams, tokens
from lectern.functions.text import (
    drop_ws,
    escape_html,
    language_of,
    normalise_name,
    number_of,
    percent_decode,
    percent_encode,
    quote_regex,
    split_ws,
    trim_ws,
    utf16_length,
)


def over(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_white_space_is_the_wide_set(spark):
    got = over(
        spark,
        ["  a　b ﻿", " x\n", "   "],
        trim_ws("s"), drop_ws("s"), split_ws("s"),
    )
    assert got == [("a　b", "ab", ["a", "b"]), ("x", "x", ["x"]), ("", "", [])]


def test_language(spark):
    values = ["abc", "約", "豈", "𠀀", "é 1", ""]
    got = [r[0] for r in over(spark, values, language_of("s"))]
    assert got == ["en", "cn", "cn", "en", "en", "en"]


def test_names_and_numbers(spark):
    got = over(spark, ["1 John", "S. S.", "MIDDLE　East"], normalise_name("s"))
    assert [r[0] for r in got] == ["1john", "ss", "middleeast"]
    digits = ["007", "0", "000", "999999999", "12345678901", "9" * 60, "", None]
    got = [r[0] for r in over(spark, digits, number_of("s"))]
    assert got == [7, 0, 0, 999999999, -1, -1, None, None]


def test_percent_coding(spark):
    values = ["a b+c", "!'()~*", "约 1:1", "R&D/é", ""]
    coded = ["a%20b%2Bc", "!'()~*", "%E7%BA%A6%201%3A1", "R%26D%2F%C3%A9", ""]
    assert [r[0] for r in over(spark, values, percent_encode("s"))] == coded
    assert [r[0] for r in over(spark, coded, percent_decode("s"))] == values
    odd = ["a+b", "%ZZ", "%E4x", "%EF%BF%BD", "%"]
    assert [r[0] for r in over(spark, odd, percent_decode("s"))] == [
        "a+b", None, None, "�", None,
    ]


def test_escaping(spark):
    assert over(spark, ["<a & b>&amp;"], escape_html("s")) == [
        ("&lt;a &amp; b&gt;&amp;amp;",)
    ]
    quoted = F.regexp_replace(F.col("s"), quote_regex("s"), F.lit("-"))
    values = ["a.*", "\\E", "a\\Eb[", "$0", "("]
    assert {r[0] for r in over(spark, values, quoted)} == {"-"}


def test_grams(spark):
    got = over(
        spark,
        ["abcab", "a", "", "𠀀约x", None],
        ngrams(F.col("s"), 1), ngrams(F.col("s"), 2), ngrams(F.col("s"), 3),
    )
    assert got == [
        (["a", "b", "c"], ["ab", "bc", "ca"], ["abc", "bca", "cab"]),
        (["a"], [], []),
        ([], [], []),
        (["𠀀", "约", "x"], ["𠀀约", "约x"], ["𠀀约x"]),
        (None, None, None),
    ]
    assert over(spark, ["Christ's éé 1John"], tokens(F.col("s"))) == [
        (["christ", "s", "1john"],)
    ]
    assert over(spark, ["a😀"], utf16_length("s")) == [(3,)]
