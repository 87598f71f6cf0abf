"""Alignment of two tokenizers against whole texts encoded by the libraries, and the fragments' algebra."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import alignment, queries
from lectern.llm.fragments import B_IDS, NONE, compose, finish, linked, of_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, row long, codes string, n_a int"


def brute(rows):
    """The contract, from encodings of whole texts, pair by pair."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {chr(c): c for c in letters}
    value.update({chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)})
    docs = []
    for i, text in rows:
        full = (" " + (text or "")).encode()
        ids_a = a.encode(full.decode(), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        parts_a = [bytes(value[c] for c in a.id_to_token(x)) for x in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if not text or b"".join(parts_a) != full or b"".join(parts_b) != full:
            docs.append((i, [], [], [], ""))
            continue
        spans = []
        for parts in (parts_a, parts_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (t, f) in zip(ids_b, spans[1]) if max(s, t) < min(e, f)]
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for high in shared:
            own = [",".join(str(x) for x, (_, e) in zip(ids, sp) if low < e <= high) for ids, sp in zip((ids_a, ids_b), spans)]
            groups.append("|".join(own))
            low = high
        docs.append((i, ids_a, ids_b, links, ";".join(groups)))
    held = Counter(p for *_, links, _ in docs for p in set(links))
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(highest.get(x, 0), n)
    return sorted(
        (
            -1 if i is None else i, len(ids_a), len(ids_b), groups.count(";") + 1 if groups else 0, len(links),
            sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for i, ids_a, ids_b, links, groups in docs
    )


def texts():
    rnd = random.Random(5)
    words = ["the", "Theaning", "it's", "naïve", "über,", "1234", "x=y;", "word.", "中文字", "emoji🙂", "don't", "<|endoftext|>", "</s>", "<0x41>"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    out += [rnd.choice(["  ", "\n", "\t ", " ", "　", "\r\n", " "]).join(rnd.choice(words) for _ in range(20)) for _ in range(30)]
    out += [None, "", " ", "   ", "\n", "a", " a", "a ", "▁x", "x ▁ y", "a\x00b", "é" * 50, "ab" * 400, "的" * 100, " x y", "a   b"]
    out += [out[0]] * 30  # copies
    out.append("".join(rnd.choice("abcdef中é ") for _ in range(3000)))
    out.append("unspaced" * 300 + " end " + "tail" * 200)
    return out


ROWS = [(i, t) for i, t in enumerate(texts())] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]


def result(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in (tuple(x) for x in df.collect()))


def test_query_is_brute_force(spark, tmp_path):
    spark.createDataFrame([(*r, 7, "x", 1) for r in ROWS], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op12_alignment(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(df) == brute(ROWS)


@pytest.mark.parametrize("chunk", [7, 60])
def test_ranges_compose_to_the_whole(spark, monkeypatch, chunk):
    """Nearly every text is cut into ranges of a few bytes, so that groups stay open at their ends."""
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = ROWS[:75] + ROWS[-4:]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], DOCS)
    assert result(alignment.align(df, A, B, chunk=chunk)) == brute(rows)


def test_small_store_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    monkeypatch.setattr(alignment, "ROWS", 3)
    monkeypatch.setattr(alignment, "BYTES", 200)
    pair = alignment.Pair.of((A, B))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(ROWS)), pa.int64()), "text": pa.array([t for _, t in ROWS], pa.string())})
    got = [r for part in alignment._slices(batch) for r in alignment._short(part, pair).to_pylist()]
    assert [i for r in got for i in r["doc_id"]] == list(range(len(ROWS)))
    numbers = [x for r in got for x in zip(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["sha"])]
    expected = {x[0]: (*x[1:5], x[7]) for x in brute([(i, t) for i, (_, t) in enumerate(ROWS)])}
    assert numbers == [expected[i] for i in range(len(ROWS))]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert alignment.align(df, A, B).collect() == []


@st.composite
def tokenisations(draw):
    n = draw(st.integers(1, 40))
    sides = []
    for _ in range(2):
        inner = draw(st.sets(st.integers(1, n), max_size=n)) | {n}
        ends = sorted(inner)
        sides += [draw(st.lists(st.integers(0, 9), min_size=len(ends), max_size=len(ends))), ends]
    return n, sides


def part(sides, low, high):
    a, a_ends, b, b_ends = sides
    keep = lambda ids, ends: [list(x) for x in zip(*[(i, e) for i, e in zip(ids, ends) if low < e <= high])] or [[], []]
    return of_tokens(*keep(a, a_ends), *keep(b, b_ends))


@settings(max_examples=200, deadline=None)
@given(tokenisations(), st.lists(st.integers(0, 40), min_size=2, max_size=2))
def test_fragments_are_a_monoid(case, cuts):
    n, sides = case
    x, y = sorted(min(c, n) for c in cuts)
    p, q, r = part(sides, 0, x), part(sides, x, y), part(sides, y, n)
    left, right = compose(compose(p, q), r), compose(p, compose(q, r))
    assert left == right
    assert compose(NONE, p) == p == compose(p, NONE)
    whole = finish(part(sides, 0, n))
    assert finish(left) == whole
    a, a_ends, b, b_ends = sides
    begins = [0, *a_ends[:-1]], [0, *b_ends[:-1]]
    overlaps = Counter(
        i * B_IDS + j for i, s, e in zip(a, begins[0], a_ends) for j, t, f in zip(b, begins[1], b_ends) if max(s, t) < min(e, f)
    )
    assert whole.links == overlaps == Counter(linked((a, a_ends, b, b_ends)))


def test_units_are_tokenised_a_few_at_once(monkeypatch):
    pair = alignment.Pair(A, B)
    units = [b" " + w.encode() for w in "some words, wörter und 字 of 17 units \x00 that stand apart".split()]
    want = pair.tokens(units)
    seen, tokenizer = [], pair.b

    class Counted:
        def encode(self, texts, **kind):
            seen.append(len(texts))
            return tokenizer.encode(texts, **kind)

    monkeypatch.setattr(alignment, "TOKENISED", 3)
    pair.b = Counted()
    for x, y in zip(pair.tokens(units), want):
        assert x.tolist() == y.tolist()
    assert max(seen) == 3 and sum(seen) == len(units)
    assert [x.tolist() for x in pair.tokens([])] == [[]] * 5
