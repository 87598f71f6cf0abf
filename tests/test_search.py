import random
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from lectern.operators.postings import (
    bigram_postings,
    build_bigram_index,
    build_token_index,
    expand_vocab,
    gram_counts,
    load_bigram_index,
    load_token_index,
    parts_asked,
    save_index,
    token_places,
    token_postings,
    vocabulary,
    vocabulary_grams,
    with_row_part,
)
from lectern.operators.search import (
    character_candidates,
    Corpus,
    count_hits,
    english_drivers,
    index_corpus,
    page_hits,
    page_of,
    search,
    search_english,
    search_segments,
    search_totals,
)
from lectern.operators.skew import salted_join
from lectern.sources.corpus import PASSAGES, save_passages_table
from lectern.staging import stage


def scan(rows, term, lang):
    """The same search as a scan over all rows: (row, is_exact) in rank order."""
    if lang == "en":
        parts = re.findall("[a-z0-9]+", term.lower())
        texts, phrase = [(r[0], (r[4] or "").lower()) for r in rows], " ".join(parts)
    else:
        parts = term.split()
        texts, phrase = [(r[0], r[5] or "") for r in rows], "".join(parts)
    if not parts:
        return []
    hits = [
        (i, len(parts) > 1 and phrase in t) for i, t in texts if t and all(p in t for p in parts)
    ]
    return sorted(hits, key=lambda h: (not h[1], h[0]))


TERMS = {
    "en": [
        "one spirit", "spirit one", "join spirit", "one", "spirit", "Christ", "christ's",
        "love love", "word word", "o t", "e", "zz", "zz one", "one zz", "!!", "éé", "",
        "love one another", "amp", "R&D", "the lord in one", "oneone", "1",
    ],
    "cn": ["神 爱", "爱 神", "神爱", "爱", "神", "基督", "神爱世人", "世人 神", "督", "爱神爱", "  ", "人 神 爱", "x"],
}


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"{lang}{i}", t, lang) for lang, ts in TERMS.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "query_id string, term string, lang string")


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.row_idx, r.is_exact))
    return {q: sorted(v) for q, v in out.items()}


def expected(rows, queries, limit=None):
    out = {}
    for q in queries.collect():
        hits = scan(rows, q.term, q.lang)[:limit]
        if hits:
            out[q.query_id] = [(i + 1, row, exact) for i, (row, exact) in enumerate(hits)]
    return out


@pytest.mark.parametrize("limit", [None, 1, 300])
def test_index_search_equals_scan(corpus, verses, queries, limit):
    rows = [tuple(r) for r in verses.collect()]
    got = ranked(search(corpus, queries, limit, block=3, rows_per_salt=4))
    assert got == expected(rows, queries, limit)


def test_totals_count_all_and_zero(corpus, verses, queries):
    rows = [tuple(r) for r in verses.collect()]
    got = {r.query_id: r.total for r in search_totals(corpus, queries).collect()}
    assert got == {q.query_id: len(scan(rows, q.term, q.lang)) for q in queries.collect()}


def test_bigrams_only_prune(spark):
    rows = [(1, 1, 1, 1, None, "ab bc ca"), (2, 1, 1, 2, None, "xabca"), (3, 1, 1, 3, None, "ABCA")]
    found = index_corpus(spark.createDataFrame(rows, PASSAGES), ("cn",))
    asked = spark.createDataFrame([(1, "abca", "cn")], "query_id int, term string, lang string")
    assert ranked(search(found, asked)) == {1: [(1, 2, False)]}


@pytest.fixture(scope="module")
def crowd(spark):
    """A random corpus in which one word and one character are in a third of all rows."""
    rng = random.Random(11)
    sounds = ["an", "ti", "on", "er", "the", "in", "re", "1"]
    chars = "神爱世人基督天地"
    rows = []
    for i in range(400):
        en = ["".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 8))]
        cn = "".join(rng.choices(chars, k=rng.randint(0, 9)))
        if i % 3 == 0:
            en.insert(rng.randint(0, len(en)), "spirit")
            cn += "约"
        rows.append((i * 3, 1, 1, i, " ".join(en) or None, cn or None))
    asked = [(0, "spirit", "en"), (1, "约", "cn"), (2, "约 神", "cn"), (3, "spi the", "en")]
    for i in range(4, 120):
        if i % 3 == 0:
            asked.append((i, "the spirit", "en"))
        elif i % 2:
            words = rng.choices(sounds + ["spirit", "anti"], k=rng.randint(1, 3))
            asked.append((i, " ".join(words), "en"))
        else:
            pieces = range(rng.randint(1, 2))
            words = ["".join(rng.choices(chars + "约", k=rng.randint(1, 2))) for _ in pieces]
            asked.append((i, " ".join(words), "cn"))
    df = spark.createDataFrame(rows, PASSAGES).cache()
    return rows, df, spark.createDataFrame(asked, "query_id int, term string, lang string").cache()


def test_random_corpus_with_hot_words_and_hot_queries(crowd):
    rows, df, asked = crowd
    # Small thresholds make words, queries and answers heavy, so every salted path is taken.
    found = index_corpus(df, rows_per_salt=20)
    assert found.tokens.vocab.where("tok = 'spirit' and n_salt > 1").count() == 1
    assert found.tokens.postings.where("tok = 'spirit'").select("salt").distinct().count() > 1
    got = ranked(search(found, asked, None, block=100, rows_per_salt=5))
    assert got == expected(rows, asked)


def test_characters_not_asked_for_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "神爱世", 0), (2, "爱爱", 0), (3, "", 1), (4, "人", 1)], "row_idx long, text string, row_part int")
    asked = spark.createDataFrame([("cn:爱", "爱"), ("cn:爱 神", "爱"), ("cn:空", "空")], "term string, tok string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = character_candidates(asked, texts)
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == [("cn:爱", 1, 0), ("cn:爱", 2, 0), ("cn:爱 神", 1, 0), ("cn:爱 神", 2, 0)]
    at = {name: min(i for i, line in enumerate(lines) if name in line) for name in ("Exchange hashpartitioning(tok", "LeftSemi", "Generate explode")}
    # from the top: shuffle, then the semi-join, then the text's characters below it
    assert at["Exchange hashpartitioning(tok"] < at["LeftSemi"] < at["Generate explode"]
    assert not any("Exchange" in line for line in lines[at["LeftSemi"] : at["Generate explode"]])


def test_saved_index_answers_alike(spark, crowd, tmp_path):
    rows, df, asked = crowd
    found = index_corpus(df, rows_per_salt=20)
    save_index(found.tokens, str(tmp_path / "tokens"))
    save_index(found.bigrams, str(tmp_path / "bigrams"))
    loaded = Corpus(
        df,
        tokens=load_token_index(spark, str(tmp_path / "tokens")),
        bigrams=load_bigram_index(spark, str(tmp_path / "bigrams")),
    )
    assert ranked(search(loaded, asked, 7)) == expected(rows, asked, 7)
    # A search reads only the parts its terms fall into.
    terms = spark.createDataFrame([("en:spirit the",), ("en:anti",)], "term string")
    drivers = stage(english_drivers(terms, loaded.tokens)).where("part >= 0")
    plan = loaded.tokens.postings.join(drivers, ["part", "tok"])
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString()


def test_broadcast_or_shuffle_gives_the_same(spark, crowd):
    rows, df, asked = crowd
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        assert ranked(search(index_corpus(df), asked, 7)) == expected(rows, asked, 7)
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_word_order_does_not_matter(spark, corpus):
    rows = [(1, "join spirit", "en"), (2, "spirit join", "en"), (3, "神 人", "cn"), (4, "人 神", "cn")]
    asked = spark.createDataFrame(rows, "query_id int, term string, lang string")
    hits = {}
    for r in search(corpus, asked).collect():
        hits.setdefault(r.query_id, set()).add(r.row_idx)
    assert hits[1] == hits[2] and hits[3] == hits[4]


def test_pages_add_up(spark, crowd):
    _, df, _ = crowd
    asked = spark.createDataFrame([(1, "spirit", "en"), (2, "on", "en")], "query_id int, term string, lang string")
    found = index_corpus(df, ("en",))
    hits = search(found, asked, None).cache()
    totals = search_totals(found, asked).cache()
    total = {r.query_id: r.total for r in totals.collect()}
    more = asked.unionByName(spark.createDataFrame([(3, "zz", "en")], asked.schema))
    assert {r.query_id: r.total for r in count_hits(hits, more).collect()} == total | {3: 0}
    seen = {1: 0, 2: 0}
    for page in range(1, max(total.values()) // 20 + 2):
        for r in page_hits(hits, totals, page).groupBy("query_id").agg(
            F.count("*").alias("n"), F.max("shown").alias("shown"), F.max("remaining").alias("rest"),
        ).collect():
            seen[r.query_id] += r.n
            assert r.shown == seen[r.query_id] and r.rest == total[r.query_id] - r.shown
    assert seen == total
    assert hits.where(page_of("rank") == 2).count() == page_hits(hits, totals, 2).count()


def test_postings_and_vocabulary(verses):
    rows = [tuple(r) for r in verses.collect()]
    toks = {(t, r[0]) for r in rows for t in re.findall("[a-z0-9]+", (r[4] or "").lower())}
    got = token_postings(verses)
    assert sorted(map(tuple, got.collect())) == sorted(toks)
    grams = {(r[5][i:i + 2], r[0]) for r in rows if r[5] for i in range(len(r[5]) - 1)}
    assert sorted(map(tuple, bigram_postings(verses).collect())) == sorted(grams)
    df = {r.tok: r.df for r in vocabulary(got).collect()}
    assert df["one"] == 6 and df["joined"] == 1


def test_expansion_against_nested_loop(spark, crowd):
    rows, df, _ = crowd
    words = {t for r in rows if r[4] for t in re.findall("[a-z0-9]+", r[4])}
    cuts = {w[a:a + n] for w in sorted(words)[:60] for a in range(3) for n in (1, 2, 3, 5, 9)}
    asked = sorted(cuts - {""} | {"zzz", "zzzzz"})
    grams = vocabulary_grams(vocabulary(token_postings(df)))
    got = expand_vocab(spark.createDataFrame([(a,) for a in asked], "qtok string"), grams, gram_counts(grams))
    assert sorted((r.qtok, r.tok) for r in got.collect()) == sorted(
        (a, w) for a in asked for w in words if a in w
    )


def test_long_junk_words(spark):
    """One word of a hundred thousand characters neither fails nor slows the index down."""
    junk = "".join(random.Random(5).choices("abcdefgh0123", k=100_000))
    rows = [(1, 1, 1, 1, f"see {junk} here", None), (2, 1, 1, 2, "see there", None)]
    df = spark.createDataFrame(rows, PASSAGES)
    asked = [(1, junk[50_000:50_040], "en"), (2, f"see {junk[-9:]}", "en"), (3, "see", "en")]
    found = Corpus(df, tokens=build_token_index(df))
    got = ranked(search(found, spark.createDataFrame(asked, "query_id int, term string, lang string")))
    assert got == {1: [(1, 1, False)], 2: [(1, 1, False)], 3: [(1, 1, False), (2, 2, False)]}


def test_case_mapping_follows_the_text(spark):
    """Turkish dotted I lower-cases to i and a combining dot: the token is plain i."""
    rows = [(1, 1, 1, 1, "İstanbul", None), (2, 1, 1, 2, "STRASSE Straße", None)]
    df = spark.createDataFrame(rows, PASSAGES)
    asked = spark.createDataFrame(
        [(1, "İ", "en"), (2, "strasse", "en"), (3, "stra", "en")],
        "query_id int, term string, lang string",
    )
    got = ranked(search(Corpus(df, tokens=build_token_index(df)), asked))
    assert got == {1: [(1, 1, False)], 2: [(1, 2, False)], 3: [(1, 2, False)]}


def test_many_tokens_shuffle_the_gram_index(crowd, monkeypatch):
    rows, df, asked = crowd
    monkeypatch.setattr("lectern.operators.postings.FEW_TOKENS", 0)
    monkeypatch.setattr("lectern.operators.postings.salted_join", partial(salted_join, rows_per_salt=5))
    english = asked.where("lang = 'en'")
    got = ranked(search(index_corpus(df, ("en",)), english, 7))
    assert got == expected(rows, english, 7)


def test_bucketed_text_is_not_shuffled(spark, crowd, tmp_path):
    rows, df, asked = crowd
    table = save_passages_table(df, "crowd_passages", str(tmp_path / "table"), 4)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        hits = spark.createDataFrame([("en:the spirit", 3)], "term string, row_idx long")
        plan = hits.join(table, "row_idx")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert ranked(search(index_corpus(table), asked, 7)) == expected(rows, asked, 7)
    finally:
        for k in keys:
            spark.conf.unset(k)
        spark.sql("DROP TABLE IF EXISTS crowd_passages")


def test_places_hold_exactly_the_phrases_of_the_text(spark):
    """A phrase is in the words at their places if and only if it is in the lower-cased text."""
    rnd = random.Random(11)
    gaps = [" ", " ", " ", "  ", "-", ", ", "\n", "é", " é ", "\u00a0", "' ", ""]
    texts = ["".join(rnd.choice(["Ab", "b", "c1", "ÀB", "İx"]) + rnd.choice(gaps) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    texts += [None, "", " ", "..", " a b ", "a", "-a b-"]
    df = spark.createDataFrame([(i, 1, 1, i, t, None) for i, t in enumerate(texts)], PASSAGES)
    lowered = {r.row_idx: r.t for r in df.select("row_idx", F.lower("text_en").alias("t")).collect()}
    places = {r.row_idx: r.places for r in token_places(df).collect()}
    assert set(places) == {i for i, t in enumerate(texts) if t}
    for i, got in places.items():
        words = re.findall("[a-z0-9]+", lowered[i])
        assert [w for w in got.split(" ") if w] == words
        for n in (1, 2, 3):
            for k in range(len(words) - n + 1):
                phrase = " ".join(words[k : k + n])
                assert (phrase in got) == (phrase in lowered[i])
                tail = phrase[1:].lstrip(" ")
                assert (tail in got) == (tail in lowered[i])


@pytest.mark.parametrize("rows_per_part", [7, 1000])
def test_searches_over_row_ranges(crowd, rows_per_part):
    rows, df, asked = crowd
    found = index_corpus(df, rows_per_part=rows_per_part)
    assert ranked(search(found, asked, 7)) == expected(rows, asked, 7)


def test_only_ranges_with_candidates_are_read(spark):
    rows = [(i, 1, 1, i, f"word{i % 50} common {'rare thing' if i == 777 else 'other'}", f"字{i}共") for i in range(1000)]
    df = spark.createDataFrame(rows, PASSAGES)
    tokens, bigrams = build_token_index(df, rows_per_part=50), build_bigram_index(df, rows_per_part=50)
    assert tokens.places.select("row_part").distinct().count() == 20
    pairs = spark.createDataFrame([("en:rare common", 777, 15)], "term string, row_idx long, row_part int")
    read = lambda t: t.select(F.input_file_name()).distinct().count()
    for store in (tokens.places, bigrams.texts):
        asked = parts_asked(store, pairs)
        assert asked.count() == 50 and read(asked) < read(store) / 10
        assert re.search(r"PartitionFilters: \[[^\]]*row_part", asked._jdf.queryExecution().executedPlan().toString())
    terms = spark.createDataFrame([("en:common rare",), ("en:rare thing",), ("en:thing rare",)], "term string")
    hits = search_english(terms, tokens)
    assert sorted(map(tuple, hits.collect())) == [("en:common rare", 777, True), ("en:rare thing", 777, True), ("en:thing rare", 777, False)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "text_en" not in plan and "text_cn" not in plan
    terms = spark.createDataFrame([("cn:字77 7共",)], "term string")
    found = {(r.row_idx, r.is_exact) for r in search_segments(terms, bigrams).collect()}
    assert found == set(scan(rows, "字77 7共", "cn")) == {(777, True), (77, False)}


def test_row_ranges_of_sparse_and_negative_numbers(spark):
    numbers = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "row_idx long")
    parts = {r.row_idx: r.row_part for r in with_row_part(df).collect()}
    assert len(set(parts.values())) > 2 and min(parts.values()) == 0 and max(parts.values()) <= 4096
    assert [parts[n] for n in numbers] == sorted(parts.values())
    assert with_row_part(df.limit(0)).collect() == []
