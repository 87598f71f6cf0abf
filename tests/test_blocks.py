import random
import time

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import blocks
from lectern.operators import search as words
from lectern.operators.search import hit_lists, index_corpus, ranked_runs, search, search_totals
from lectern.sources.corpus import PASSAGES
from lectern.staging import stage


def _crowd(spark, n=300):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["on", "one", "ton", "a", "an", "stone", "b-a", ","], k=rng.randint(0, 9))) for _ in range(n)]
    df = spark.createDataFrame([(i * 7, 1, 1, i, t, t.upper()) for i, t in enumerate(texts)], PASSAGES)
    return {i * 7: t for i, t in enumerate(texts)}, df


def test_hits_leave_as_one_list_a_term_and_block(spark):
    """Pairs of terms and rows aren't shuffled one by one, and only the tables that are read are built."""
    texts, df = _crowd(spark)
    asked = ["on one", "a", "one stone a", "on", "b a", "zz"]
    queries = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)], "query_id int, term string, lang string")
    found = index_corpus(df, ("en",))
    terms = spark.createDataFrame([(f"en:{t}",) for t in asked], "term string")
    few, words.FEW_TERMS = words.FEW_TERMS, 0
    try:
        lists = stage(hit_lists(found, terms, rows=100))
        totals = {r.query_id: r.total for r in search_totals(found, queries).collect()}
        hits = search(found, queries, None, block=100).collect()
    finally:
        words.FEW_TERMS = few
    assert callable(found.tokens._tables["postings"]) and callable(found.tokens._tables["grams"])
    assert lists.groupBy("term").count().where("count > 3").isEmpty() and lists.select("block").distinct().count() == 3
    want = {}
    for i, t in enumerate(asked):
        rows = [(t not in x or " " not in t, n) for n, x in texts.items() if all(p in x for p in t.split())]
        want[i] = [(n, not rest) for rest, n in sorted(rows)]
    assert totals == {i: len(w) for i, w in want.items()}
    for i, w in want.items():
        own = sorted((h["rank"], h.row_idx, h.is_exact) for h in hits if h.query_id == i)
        assert own == [(k + 1, *x) for k, x in enumerate(w)]
    runs = ranked_runs(lists).where(F.col("rank") - F.col("first") + 1 != F.size("rows"))
    assert runs.isEmpty()


def test_repeated_and_null_row_numbers(spark):
    rows = [(1, 1, 1, 1, "on one", "x"), (1, 1, 1, 1, "one on", "x"), (None, 1, 1, 1, "on one", "x"), (None, 1, 1, 1, "on", "x"), (0, 1, 1, 1, "one", "x")]
    found = index_corpus(spark.createDataFrame(rows, PASSAGES), ("en",))
    queries = spark.createDataFrame([(1, "on", "en"), (2, "on one", "en")], "query_id int, term string, lang string")
    got = sorted(((r.query_id, r["rank"], r.row_idx, r.is_exact) for r in search(found, queries, None).collect()))
    assert got == [(1, 1, None, False), (1, 2, 0, False), (1, 3, 1, False), (2, 1, 1, True), (2, 2, 0, False), (2, 3, 1, False)]
    assert {r.query_id: r.total for r in search_totals(found, queries).collect()} == {1: 3, 2: 3}


def _holding(words_, tokens):
    """Token, word and edge by looking at every place."""
    found = {}
    for t, token in enumerate(tokens):
        for w, word in enumerate(words_):
            at = [i for i in range(len(word)) if word.startswith(token, i)]
            if at:
                found[t, w] = (0 in at) + 2 * (len(word) - len(token) in at)
    return [(*k, e) for k, e in sorted(found.items())]


def test_tokens_in_words_as_by_brute_force(monkeypatch):
    """Also where a step ends inside a word, and where characters lie beyond 16 bits."""
    rng = random.Random(3)
    letters = "ab一二\U0001F600-"
    for step in (8, 64, 1 << 22):
        monkeypatch.setattr(blocks, "_STEP", step)
        for _ in range(20):
            held = list({"".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 12))})
            asked = list({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(rng.randint(0, 30))})
            assert list(zip(*(x.tolist() for x in blocks._held(held, asked)))) == _holding(held, asked)


def test_texts_without_blanks_are_not_gone_through_in_python():
    """Thousands of tokens of thirty lengths in one long word (before: a look-up for each place and length)."""
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(500_000))
    asked = sorted({text[i : i + rng.randint(1, 30)] for i in range(0, 400_000, 100)})
    start = time.process_time()
    found = blocks.Words(blocks.pa.array([text, "x"]), asked)
    assert time.process_time() - start < 4
    assert found.bitmaps() == [1] * len(asked) and np.diff(found.begin).tolist() == [1] * len(asked)


def test_blocks_and_chunks_meet_without_copies(spark, monkeypatch):
    """Numbers leave once a term, and neither terms nor texts are shuffled once for each block or chunk."""
    monkeypatch.setattr(blocks, "COUNT_TERMS", 3)
    texts, df = _crowd(spark)
    asked = ["a", "an", "on", "one", "on one", "one stone a", "ton a", "zz"]
    terms = spark.createDataFrame([(f"en:{t}",) for t in asked], "term string")
    store = df.select(F.lit(0).alias("row_part"), "row_idx", F.regexp_replace("text_en", "[^a-z]+", " ").alias("text"))
    found = blocks.find(store, terms, lists=False, rows_per_block=50)
    want = {f"en:{t}": sum(all(p in x for p in t.split()) for x in texts.values()) for t in asked}
    counted = [(r.term, r.n) for r in found.collect()]
    assert sorted(counted) == sorted((t, n) for t, n in want.items() if n)
    plan = blocks.find(store, terms, rows_per_block=50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
