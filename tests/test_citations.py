import pytest
from pyspark.sql import functions as F

from lectern.operators.citations import (
    alias_dim,
    candidate_counts,
    classify_queries,
    expand_fuzzy,
    match_alias_prefix,
    parse_address,
    resolve_citations,
    validate_address,
)


def ref(book, chapter, verse=None, end=None):
    return [("ref", book, chapter, verse, end)]


def fuzzy(book, *readings):
    return [("fuzzy", book, c, v, None) for c, v in readings]


def other(kind, lang="en"):
    return [(kind, lang)]


# The number of verses matters for fuzzy cases only; the fixture has 30 in every chapter.
CASES = {
    "John 1:1": ref(43, 1, 1),
    "约 1:1": ref(43, 1, 1),
    "约翰福音 1:1": ref(43, 1, 1),
    "1 John 2:3": ref(62, 2, 3),
    "1John 2:3": ref(62, 2, 3),
    "Gen 1:1": ref(1, 1, 1),
    "John 1": ref(43, 1),
    "诗 23:1": ref(19, 23, 1),
    "Psalm 23:1": ref(19, 23, 1),
    "Rev 22:21": ref(66, 22, 21),
    "S.S. 2:1": ref(22, 2, 1),
    "John 1:1-5": ref(43, 1, 1, 5),
    "John 1:1 -\u00a05 ": ref(43, 1, 1, 5),
    "创 1:1-3": ref(1, 1, 1, 3),
    "heb 111": fuzzy(58, (1, 11), (11, 1)),
    "heb11": fuzzy(58, (11, None), (1, 1)),
    "Ps 23": fuzzy(19, (23, None), (2, 3)),
    "约 111": fuzzy(43, (1, 11), (11, 1)),
    "Revelation 22": fuzzy(66, (22, None), (2, 2)),
    "heb 011": fuzzy(58, (11, None), (1, 1)),
    "heb 101": ref(58, 10, 1),
    "heb 100": other("word"),
    "ps 119": fuzzy(19, (119, None), (1, 19), (11, 9)),
    "ps " + "0" * 40 + "9": ref(19, 9),
    "Christ": other("word"),
    "基督": other("word", "cn"),
    "love one another": other("word"),
    "John 99:1": other("word"),
    "John 1:99": ref(43, 1, 99),
    "John 1:0": ref(43, 1, 0),
    "John 1:" + "9" * 30: ref(43, 1, -1),
    "John 1:5-2": ref(43, 1, 5, 2),
    "John 1-5": other("word"),
    "John 1:1-": other("word"),
    "1:1": other("word"),
    "jude 5": other("word"),
    "jude 1:5": ref(65, 1, 5),
    "hb 1:1": ref(58, 1, 1),
    "约": other("word", "cn"),
    "约书 1:1": other("word", "cn"),
    "约书亚记 1:1": ref(6, 1, 1),
    "约 1：1": other("word", "cn"),
    "约 1-2": other("word", "cn"),
    "约一 2:3": ref(62, 2, 3),
    "John 约 1:1": other("word", "cn"),
    "John\u20281:1": other("word"),
    "": other("empty"),
    " 　 ": other("empty"),
    "a": other("too_short"),
    " é ": other("too_short"),
    "a b": other("word"),
    "😀": other("word"),
    "爱": other("word", "cn"),
}


@pytest.fixture(scope="module")
def classified(spark, books):
    queries = spark.createDataFrame(list(enumerate(CASES)), "query_id int, raw string")
    return classify_queries(queries, books).cache()


def test_every_case(classified):
    got = {}
    for r in classified.orderBy("query_id", "cand_rank").collect():
        if r.kind in ("ref", "fuzzy"):
            assert r.has_verse == (r.verse is not None)
            got.setdefault(r.query_id, []).append(
                (r.kind, r.book_idx, r.chapter, r.verse, r.verse_end)
            )
        else:
            assert (r.book_idx, r.chapter, r.cand_rank) == (None, None, None)
            got.setdefault(r.query_id, []).append((r.kind, r.lang))
    wrong = {
        raw: (got.get(i), want) for i, (raw, want) in enumerate(CASES.items())
        if got.get(i) != want
    }
    assert wrong == {}


def test_counts_and_resolved_part(spark, books, classified):
    queries = spark.createDataFrame([(1, "heb11"), (2, "love"), (3, None)], "query_id int, raw string")
    rows = resolve_citations(queries, books).orderBy("cand_rank").collect()
    assert [(r.query_id, r.cand_rank) for r in rows] == [(1, 1), (1, 2)]
    counts = {r.query_id: r.n_cand for r in candidate_counts(classified).collect()}
    ps119 = list(CASES).index("ps 119")
    assert counts[ps119] == 3


def test_last_alias_wins_and_names_are_normalised(books):
    got = {(r.kind, r.alias): r.book_idx for r in alias_dim(books).collect()}
    assert got["en", "hb"] == 58
    assert got["en", "songofsongs"] == 22
    assert got["en", "1john"] == 62
    assert got["cn", "约"] == 43
    assert ("en", "") not in got and ("cn", "") not in got


def test_longest_prefix_is_final(spark):
    aliases = spark.createDataFrame([("a", 1), ("ab", 2), ("abcd", 3)], "alias string, book_idx int")
    queries = spark.createDataFrame([(1, "abc 1"), (2, "abcd"), (3, "ac"), (4, "x")], "query_id int, q string")
    got = {r.query_id: (r.book_idx, r.num) for r in match_alias_prefix(queries, aliases).collect()}
    assert got == {1: (2, "c 1"), 2: (3, ""), 3: (1, "c"), 4: (None, None)}


def test_addresses(spark, books):
    rows = [(1, 43, "3:16"), (2, 43, "22:1"), (3, 7, "1:1"), (4, 43, "3"), (5, 43, "3 :1"),
            (6, 43, "3:1 - 4"), (7, 43, "0:1"), (8, 0, "1:1")]
    df = spark.createDataFrame(rows, "query_id int, book_idx int, num string")
    got = validate_address(parse_address(df), books).collect()
    assert {(r.query_id, r.chapter, r.verse, r.verse_end, r.has_verse) for r in got} == {
        (1, 3, 16, None, True), (4, 3, None, None, False), (6, 3, 1, 4, True),
    }


def test_a_book_without_chapter_data_takes_any_chapter_but_no_digits(spark, canon):
    queries = spark.createDataFrame([(1, "Two 9:9"), (2, "Two 9")], "query_id int, raw string")
    got = {r.query_id: (r.kind, r.chapter) for r in classify_queries(queries, canon).collect()}
    assert got == {1: ("ref", 9), 2: ("word", None)}


def readings(digits, chapters):
    """Every way to read the digits, in order, spelled out."""
    out = []
    if 1 <= int(digits) <= len(chapters):
        out.append((int(digits), None))
    for i in range(1, len(digits)):
        c, v = int(digits[:i]), digits[i:]
        if len(v) > 1 and v[0] == "0":
            continue
        if 1 <= c <= len(chapters) and 1 <= int(v) <= chapters[c - 1] and (c, int(v)) not in out:
            out.append((c, int(v)))
    return out[:1] + sorted(out[1:]) if out and out[0][1] is None else sorted(out)


def test_fuzzy_against_brute_force(spark):
    chapters = [12, 3, 130, 9, 10, 1, 1, 25, 40, 5, 17, 99]
    books = spark.createDataFrame([(1, chapters)], "idx int, chapters array<int>")
    digits = [str(n) for n in range(1500)] + ["0" * k + str(n) for k in (1, 2, 12) for n in range(130)]
    digits = sorted(set(digits))
    df = spark.createDataFrame([(d, 1) for d in digits], "num string, book_idx int")
    got = {}
    rows = expand_fuzzy(df, books).orderBy("num", "cand_rank").collect()
    for r in rows:
        got.setdefault(r.num, []).append((r.chapter, r.verse))
        assert r.n_cand == len(readings(r.num, chapters))
    assert got == {d: readings(d, chapters) for d in digits if readings(d, chapters)}


def test_hot_query_text(spark, books):
    """A third of all queries with one text resolve alike."""
    queries = spark.range(3000).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") % 3 == 0, "约 3:16").otherwise(F.concat(F.lit("ps 1:"), F.col("id"))).alias("raw"),
    )
    got = classify_queries(queries, books).groupBy("book_idx").count().collect()
    assert {tuple(r) for r in got} == {(43, 1000), (19, 2000)}
