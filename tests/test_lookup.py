import random

import pytest

from lectern.operators.lookup import (
    adjacent_books,
    chapter_context,
    chapter_title,
    label_rows,
    lookup_chapter,
    lookup_point,
    lookup_range,
    resolve_candidates,
    sibling_chapter,
)
from lectern.sources.corpus import address_dim, corpus_shape

REFS = "query_id int, book_idx int, chapter int, verse int, verse_end int"


@pytest.fixture(scope="module")
def addresses(verses):
    return address_dim(verses).cache()


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_last_duplicate_wins(addresses):
    rows = {(r.book_idx, r.chapter, r.verse): r.row_idx for r in addresses.collect()}
    assert rows[3, 1, 1] == 10
    assert len(rows) == 11


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 2])
def test_points(spark, addresses, rows_per_salt):
    rows = [(i, 3, 1, 1, None) for i in range(9)] + [(20, 1, 1, 2, None), (21, 1, 1, 0, None)]
    refs = spark.createDataFrame(rows, REFS)
    got = lookup_point(refs, addresses, rows_per_salt)
    assert pairs(got, "query_id", "row_idx") == [(i, 10) for i in range(9)] + [(21, 0)]


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 2])
def test_ranges(spark, addresses, rows_per_salt):
    rows = [
        (1, 1, 1, 0, 3), (2, 1, 1, 2, None), (3, 1, 1, 3, 1), (4, 1, 1, 1, 999999999),
        (5, 9, 1, 1, 5), (6, 1, 1, 3, 3), (7, 1, 1, None, None),
    ]
    refs = spark.createDataFrame(rows + [(i, 1, 2, 1, 2) for i in range(10, 16)], REFS)
    got = pairs(lookup_range(refs, addresses, rows_per_salt), "query_id", "verse", "row_idx")
    assert got == [
        (1, 0, 0), (1, 1, 1), (1, 3, 2), (4, 1, 1), (4, 3, 2), (4, 9, 3), (6, 3, 2),
    ] + [(i, v, v + 3) for i in range(10, 16) for v in (1, 2)]


def test_ranges_against_brute_force(spark):
    rng = random.Random(7)
    verses = sorted({(rng.randrange(1, 4), rng.randrange(1, 3), rng.randrange(0, 200)) for _ in range(500)})
    addresses = spark.createDataFrame(
        [(*a, i) for i, a in enumerate(verses)],
        "book_idx int, chapter int, verse int, row_idx long",
    )
    refs = []
    for i in range(300):
        lo = rng.randrange(0, 220)
        hi = rng.choice([None, lo + rng.randrange(0, 90), lo - 1, 10**9])
        refs.append((i, rng.randrange(1, 5), rng.randrange(1, 4), lo, hi))
    got = lookup_range(spark.createDataFrame(refs, REFS), addresses, rows_per_salt=50)
    want = sorted(
        (q, row)
        for q, b, c, lo, hi in refs
        for row, (vb, vc, v) in enumerate(verses)
        if (vb, vc) == (b, c) and lo <= v <= (lo if hi is None else hi)
    )
    assert pairs(got, "query_id", "row_idx") == want


def test_chapters(spark, addresses, canon):
    refs = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 9, 1), (5, 4, 7), (6, 2, 1)],
        "query_id int, book_idx int, chapter int",
    )
    got = lookup_chapter(refs, addresses, canon)
    # Verse 9 is above the count of chapter 1; verse 0 comes first.
    assert pairs(got, "query_id", "verse", "row_idx") == [
        (1, 0, 0), (1, 1, 1), (1, 3, 2), (2, 1, 4), (2, 2, 5),
    ]


def test_context(spark, verses, canon):
    hits = spark.createDataFrame([(1, 2), (2, 3), (3, 10), (4, 99)], "query_id int, row_idx long")
    got = chapter_context(hits, verses, canon)
    assert pairs(got, "query_id", "hit_row", "row_idx") == [
        (1, 2, 0), (1, 2, 1), (1, 2, 2), (2, 3, 0), (2, 3, 1), (2, 3, 2),
        (3, 10, 7), (3, 10, 10),
    ]


def test_candidates(spark, addresses):
    rows = [(1, 1, 1, None, 1), (1, 1, 2, 2, 2), (1, 1, 3, None, 3), (2, 4, 2, None, 1)]
    df = spark.createDataFrame(rows, "query_id int, book_idx int, chapter int, verse int, cand_rank int")
    got = resolve_candidates(df, addresses)
    # Chapter 2 of book 4 has verse 2 only, so it has no verse 1 to anchor at.
    assert pairs(got, "query_id", "cand_rank", "cand_kind", "row_idx") == [
        (1, 1, "chapter", 1), (1, 2, "verse", 5),
    ]


def walk(books, address, book, chapter, direction):
    """Step chapter by chapter as a reader would."""
    chapter += direction
    while book in books:
        counts = books[book]
        if 1 <= chapter <= len(counts):
            for v in range(counts[chapter - 1] + 1):
                if (book, chapter, v) in address:
                    return address[book, chapter, v]
            return None
        book += direction
        if book not in books:
            return None
        chapter = 1 if direction > 0 else len(books[book])
    return None


@pytest.mark.parametrize("direction", [1, -1])
def test_siblings_against_walk(spark, addresses, canon, direction):
    books = {r.idx: r.chapters for r in canon.collect()}
    address = {(r.book_idx, r.chapter, r.verse): r.row_idx for r in addresses.collect()}
    places = [(b, c) for b in range(0, 8) for c in range(0, 5)]
    df = spark.createDataFrame(places, "book_idx int, chapter int")
    got = {
        (r.book_idx, r.chapter): r.sibling_row
        for r in sibling_chapter(df, addresses, canon, direction, rows_per_salt=3).collect()
    }
    assert got == {p: walk(books, address, *p, direction) for p in places}


def test_previous_of_next_is_the_first_row(spark, addresses, canon):
    df = spark.createDataFrame([(1, 1), (3, 1), (4, 1)], "book_idx int, chapter int")
    first = {(1, 1): 0, (3, 1): 10, (4, 1): 8}
    by_row = {r.row_idx: (r.book_idx, r.chapter) for r in addresses.collect()}
    for r in sibling_chapter(df, addresses, canon, 1).collect():
        if r.sibling_row is None:
            continue
        there = spark.createDataFrame([by_row[r.sibling_row]], "book_idx int, chapter int")
        back = sibling_chapter(there, addresses, canon, -1).first().sibling_row
        assert back in (None, first[r.book_idx, r.chapter])


def test_adjacent_books_in_small_blocks(spark):
    rng = random.Random(3)
    idx = sorted(rng.sample(range(1, 90), 70))
    rows = [(i, [1] * rng.choice([0, 0, 0, 2])) for i in idx]
    books = spark.createDataFrame(rows, "idx int, chapters array<int>")
    n = dict((i, len(c)) for i, c in rows)
    for direction in (1, -1):
        want = {}
        for i in idx:
            j = i + direction
            while j in n and n[j] == 0:
                j += direction
            if j in n:
                want[i] = (j, n[j])
        for block in (4, 1000):
            got = adjacent_books(books, direction, block).collect()
            assert {r.book_idx: (r.to_book, r.to_chapters) for r in got} == want


def test_labels(spark, canon):
    rows = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (4, 1, 1)], "book_idx int, chapter int, verse int")
    assert pairs(label_rows(rows, canon), "label") == [("Four 1:1",), ("One 1:2",), ("Two 3:4",)]
    assert pairs(label_rows(rows, canon, "cn"), "label") == [
        ("Four 1:1",), ("Two 3:4",), ("一书 1:2",),
    ]
    assert ("一书 1",) in pairs(chapter_title(rows, canon, "cn"), "title")


def test_shape(addresses, canon):
    got = {(r.book_idx, r.chapter): (r.declared, r.found) for r in corpus_shape(canon, addresses).collect()}
    assert got[1, 1] == (3, 3) and got[1, 3] == (4, 0) and got[4, 2] == (2, 1)
