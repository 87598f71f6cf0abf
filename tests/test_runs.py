"""Hits kept once a term: pages, stored answers; texts cut once."""

from pyspark.sql import functions as F

from checks.inputs import neighbours
from lectern.operators.citations import NAME_AND_NUMBER, split_name
from lectern.operators.search import count_hits, page_hits, search, search_page
from lectern.plans.omni import store_answers


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_page_is_that_of_all_hits(spark, corpus):
    asked = [(1, "one", "en"), (2, "one spirit", "en"), (3, "!!", "en"), (4, "zz", "en"), (5, "one", "en"), (5, "one", "en"), (6, "爱", "cn"), (None, "one", "en")]
    queries = spark.createDataFrame(asked, "query_id int, term string, lang string")
    hits = search(corpus, queries, None).cache()
    for page, size in ((2, 2), (9, 3)):
        want = page_hits(hits, count_hits(hits, queries), page, size)
        got = search_page(corpus, queries, page, size, block=2, rows_per_salt=2)
        assert got.columns == want.columns and rows(got) == rows(want)


def test_equal_queries_are_stored_once(spark, corpus, canon):
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.lit("one spirit").alias("raw"))
    stored = store_answers(queries, corpus, canon)
    assert sorted(i for r in stored.runs.select("rows").collect() for i in r.rows) == [0, 1, 2, 3]
    assert stored.rows.count() == 160 and {r.total for r in stored.status.collect()} == {4}


def test_neighbours_cut_a_text_once(spark):
    texts = ["a b c", "a", "", " ", "a  b ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", neighbours("t").alias("n"))
    for t, n in df.collect():
        words = None if t is None else t.split(" ")
        assert n == (words and [" ".join(words[i : i + 2]) for i in range(len(words))])
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(" in plan and "split(" not in plan.split("lambdafunction(", 1)[1].split(" AS ")[0], plan


def test_only_queries_with_a_last_digit_are_parsed(spark):
    texts = ["One 1:1", "One 1", "7", "", None, "one", "a1b", "x 1:1 - 9", "a\n1", "书 3", "x٣", "x:", "1:2x"]
    df = split_name(spark.createDataFrame([(t,) for t in texts], "q string"))
    want = df.select("q", F.regexp_extract("q", NAME_AND_NUMBER, 1), F.regexp_extract("q", NAME_AND_NUMBER, 2))
    named = [(r.q, r.name, r.num) for r in df.collect()]
    assert named == [(q, a if a is None else a.lower().replace(" ", ""), b) for q, a, b in want.collect()]
    assert "CASE WHEN" in df._jdf.queryExecution().analyzed().toString()
