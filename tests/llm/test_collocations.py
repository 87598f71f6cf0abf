"""Phrase mining against brute force, and what Misra-Gries summaries promise."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import collocations as C

DOCS = "doc_id long, text string, lang string, n long, phrase string, rank string"


def brute(rows, threshold, longest=4, top=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if a >= threshold and len(x[1]) > 1}
    dropped = set()
    for (lang, w), longer in candidates.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                if 100 * longer >= 80 * candidates[lang, w[i : i + s]]:
                    dropped.add((lang, w[i : i + s]))
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) in dropped:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):  # noqa: E741
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return ranked


def corpus():
    rnd = random.Random(9)
    words = ["of", "The", "a", "b", "Éa", "x y", "x-y", "don't", *(f"w{i}" for i in range(40))]
    stops = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", " ? ", ";\r"]
    rows = []
    for _ in range(120):
        text = "".join(rnd.choice(words[: rnd.choice((6, 48))]) + rnd.choice(stops) for _ in range(rnd.randint(1, 120)))
        rows.append((text, rnd.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("new york city hall", "en")] * 40 + [("a a a a a", "de")] * 5  # copies; a phrase that overlaps itself
    rows += [(None, "en"), ("", "fr"), (" \t", "fr"), ("one", "fr"), (".,;", None), ("in in in " * 400, "es")]
    return rows


def found(spark, rows, **kind):
    df = spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    out = C.collocations(df, **kind)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("threshold, longest", [(30, 4), (5, 4), (3, 3), (4, 2)])
def test_brute_force(spark, threshold, longest):
    rows = corpus()
    expected = brute(rows, threshold, longest)
    assert expected and found(spark, rows, threshold=threshold, longest=longest) == sorted(expected)


def test_small_summaries_and_a_full_filter(spark, monkeypatch):
    """Summaries that must take off, many partitions, tasks that give on early, and a filter that lets nearly all in."""
    for name, value in (("COUNTERS", 20), ("HELD", 50), ("FILTER_BITS", 15), ("BYTES", 300)):
        monkeypatch.setattr(C, name, value)
    rows = corpus()
    assert found(spark, rows, threshold=12) == sorted(brute(rows, 12))


def test_top_cuts_by_rank_and_ties_by_phrase(spark):
    rows = [(f"{x} z{x}", "en") for x in "edcba" for _ in range(30)]
    assert [r[2] for r in found(spark, rows, top=3)] == ["a za", "b zb", "c zc"]


def test_empty_and_null(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en")]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=120), min_size=1, max_size=6), st.integers(2, 12), st.integers(1, 3))
def test_frequent_hashes_survive_any_merge(streams, threshold, parts):
    spread = lambda x: np.array(x, np.uint64) * np.uint64((1 << 64) // 31)
    edges = spread([31 * i // parts for i in range(1, parts)])
    true = Counter(x for s in streams for x in s)
    blank = C.Summary(edges, np.ones(parts, np.int64))
    mass = np.bincount(blank.part_of(spread([x for s in streams for x in s])), minlength=parts)
    capacity = mass // threshold + 1
    whole, error = C.Summary(edges, capacity), np.zeros(parts, np.int64)
    for s in streams:
        one = C.Summary(edges, capacity)
        for x in s:
            one.add(spread([x]), np.ones(1, np.int64))
        one.merge()
        part, hashes, counts, wrong = one.taken()
        np.add.at(error, part, wrong)
        whole.add(hashes[counts > 0], counts[counts > 0])
        whole.merge()
    error += whole.error
    assert (error < threshold).all() and (np.diff(np.searchsorted(whole.hashes, np.append(edges, 0))) <= len(whole.hashes)).all()
    held = dict(zip(whole.hashes.tolist(), whole.counts.tolist()))
    for x, n in true.items():
        h = int(spread([x])[0])
        assert held.get(h, 0) <= n <= held.get(h, 0) + error[blank.part_of(spread([x]))[0]]
        assert n < threshold or h in held
