"""MinHash, substrings and embeddings against brute force, with skew, ties, nulls and odd rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import hnsw, minhash, neighbours, substrings
from lectern.llm.components import components
from lectern.llm.fmindex import repeated_windows
from lectern.llm.hnsw import Graph

DOCS = "doc_id long, text string, set_id string, node int, spans string, n_chars int"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def corpus(seed=3):
    """Copies, near copies in a chain, a shared passage, short, empty and null texts."""
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randint(0, 4000)
    texts = [" ".join(word() for _ in range(rnd.randint(1, 150))) for _ in range(60)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{word()} {passage} {word()} é" for _ in range(25)]
    near = [word() for _ in range(120)]
    for _ in range(60):
        near = list(near)
        near[rnd.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [texts[3]] * 40 + [texts[3].upper(), "", "  \n", "one", "One", "a b c", None]
    texts += ["er " * 90, "x\x85y\xa0z " * 20]
    return [(i, t, "s", i, None, 5) for i, t in enumerate(texts)]


def shingles(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots_of(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_is_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rows = corpus()
    sets = [shingles(t, k) for _, t, *_ in rows]
    links = [
        (a, b)
        for a, b in combinations(range(len(rows)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = {i: (len(sets[i]), r) for i, r in enumerate(roots_of(len(rows), links))}
    docs = spark.createDataFrame(rows, DOCS)
    got = minhash.groups(docs, k, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    kept = minhash.keep_one(docs, k, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, r) in want.items() if i == r)
    assert kept.columns == docs.columns and docs.limit(0).transform(minhash.groups).collect() == []


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", "", 0, "", 0), (5, "a b c d e f", "", 0, "", 0), (5, "a b c d e f", "", 0, "", 0)]
    rows += [(7, None, None, None, None, None), (None, "q r s", "", 0, "", 0), (9, "Q r S", "", 0, "", 0)]
    got = minhash.groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [
        ("5", "5"), ("5", "5"), ("7", "7"), ("9", "9"), ("None", "5"), ("None", "9"),
    ]


def test_one_row_of_each_component_stays_and_is_not_cut(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a"))] * 3 + [(2, text("a"))] + [(None, text("b"))] * 2 + [(None, text("b") + " x")]
    rows += [(None, text("c")), (3, text("c")), (4, text("d")), (4, text("d").upper()), (4, text("e")), (5, text("f"))]
    rows += [(6, ""), (6, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, str(n), n, None, 5) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    one = minhash.keep_one(docs)
    kept = [(r["doc_id"], (r["text"] or "-")[0].lower()) for r in one.collect()]
    want = [(1, "a"), (None, "b"), (3, "c"), (4, "d"), (4, "e"), (5, "f"), (6, "-"), (6, "-"), (None, "-"), (None, "-")]
    assert sorted(kept, key=str) == sorted(want, key=str) and one.columns == docs.columns
    assert all(len(words(r["text"])) >= 40 for r in substrings.cut(one).collect() if r["text"])
    assert sum(bool(r["text"]) for r in substrings.cut(one).collect()) == 6


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = base[:1000], base[100:1100]
    s, t, u = minhash.sketches([a, b, base[:1100]])
    assert (np.maximum(s, t) == u).all()
    j = minhash.likelihood_jaccard(np.array([1000.0]), np.array([1000.0]), np.array([(s > t).sum()]), np.array([(s < t).sum()]))
    assert abs(j[0] - 900 / 1100) < 0.15
    assert (minhash.sketches([np.zeros(0, np.uint64)]) == 0).all()


def substring_truth(rows, window):
    lists = [words(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = {}
    for (doc, *_), w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] >= 2:
                gone |= set(range(i, i + window))
        out[doc] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("segments, copies", [(10_000, 100), (1, 100), (10_000, 1), (1, 5)])
def test_substrings_are_brute_force(spark, monkeypatch, segments, copies):
    monkeypatch.setattr(substrings, "SEGMENTS", segments)
    monkeypatch.setattr(substrings, "COPIES", copies)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    rows, window = corpus(), 35
    want = substring_truth(rows, window)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digest_table(docs, window).collect()}
    assert got == {d: v[:2] for d, v in want.items()}
    cut = substrings.cut(docs, window)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    for r in cut.collect():
        if want[r["doc_id"]][1]:
            assert r["text"] == " ".join(want[r["doc_id"]][2]) and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == rows[r["doc_id"]][1]
    assert substrings.digest_table(docs.limit(0)).collect() == []


def test_fm_index_is_a_count():
    rng = np.random.default_rng(0)
    for window in (3, 10, 35):
        base = rng.integers(0, 30, 200).astype(np.uint64)
        made = []
        for _ in range(20):
            at = rng.integers(0, 200 - window - 27)
            row = base[at : at + window + rng.integers(0, 27)].copy()
            if rng.random() < 0.5:
                row[rng.integers(len(row))] = 99
            made.append(tuple(row))
        rows = [np.array(r, np.uint64) for r in dict.fromkeys(made)]
        weights = rng.integers(1, 3, len(rows))
        seen = Counter()
        for r, n in zip(rows, weights):
            for i in range(len(r) - window + 1):
                seen[tuple(r[i : i + window])] += n
        want = [sum(1 << i for i in range(len(r) - window + 1) if seen[tuple(r[i : i + window])] >= 2) for r in rows]
        assert list(repeated_windows(rows, weights, window)) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(600, 700)] + [(7, 7), (900, 901), (901, 900)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    byroot = {}
    for r in rows:
        byroot.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, byroot.values())) == [2, 101, 101] and all(r in s for r, s in byroot.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[2000:2400] = x[0] + 0.02 * rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    found = sum(len(q) for _, q, _ in graph.within(x.astype(np.float32), 0.95, 48))
    true = (x @ x.T >= 0.95).sum()
    assert found >= 0.99 * true
    nearest, _ = graph.search(x[:300].astype(np.float32), 48)
    assert (nearest[:, 0] == np.arange(300)).mean() >= 0.97


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    for i in range(200, 260):
        x[i] = x[0] + 0.03 * rng.normal(size=16)
    x[260:270] = x[5]
    x[270] = 3 * x[6]
    lists = [[float(v) for v in r] for r in x]
    lists += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [1.0] * 3]
    rows = [(i, v, None, "x") for i, v in enumerate(lists)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, root string")
    sound = {i: np.array(v, float) for i, v in enumerate(lists) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b)
        for a, b in combinations(sound, 2)
        if len(sound[a]) == len(sound[b])
        and sound[a] @ sound[b] / np.sqrt((sound[a] @ sound[a]) * (sound[b] @ sound[b])) >= 0.95
    ]
    counts = Counter(i for link in links for i in link)
    want = {i: (counts[i], r) for i, r in enumerate(roots_of(len(rows), links))}
    got = neighbours.groups(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert neighbours.groups(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), str(r["component_id"]), r["n_links"]) for r in neighbours.groups(odd).collect()) == [
        ("4", "4", 0), ("4", "4", 1), ("None", "4", 1),
    ]


@pytest.mark.parametrize("linked", [40, 3000])
def test_embeddings_through_graphs(spark, monkeypatch, linked):
    """Shards of over 2,000 vectors, so that graphs are walked; links are rare, or one group is large."""
    rng = np.random.default_rng(linked)
    n = 8600 + linked
    x = rng.normal(size=(n, 24))
    x[8600:] = x[:40].repeat(-(-linked // 40), 0)[:linked] + 0.1 * rng.normal(size=(linked, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    walked = spark.sparkContext.accumulator(0)
    search = Graph.search

    def counted(self, queries, width):
        walked.add(len(queries))
        return search(self, queries, width)

    monkeypatch.setattr(Graph, "search", counted)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    graph = Graph(x)
    width = neighbours.audited(graph, x, x[::50], 0.95)
    assert walked.value > 0 and 4 * width < n / 4
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neighbours.groups(rows).collect()}
    assert len(got) == n and near.sum() > linked
    assert sum(got[i]["n_links"] for i in range(n)) >= 0.99 * near.sum()
    assert all(got[i]["n_links"] <= c for i, c in enumerate(near.sum(1)))
    roots = roots_of(n, zip(*(a.tolist() for a in np.nonzero(near))))
    assert sum(got[i]["component_id"] == r for i, r in enumerate(roots)) >= 0.999 * n


def test_planted_audit_vectors_link():
    x = np.random.default_rng(4).normal(size=(700, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = neighbours.planted(x, 0.95)
    assert len(made) >= 256 and np.allclose(np.linalg.norm(made, axis=1), 1)
    assert ((made @ x.T).max(1) >= 0.95).all()


def test_segments_that_stand_once_are_not_written(spark, monkeypatch):
    """Sixty words stand in two of twenty texts; the others' segments don't leave the task that reads them."""
    rnd, written, real = random.Random(4), [], substrings.stage
    made = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    made[7] += " " + " ".join(made[3].split()[100:160])
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    monkeypatch.setattr(substrings, "stage", lambda df: written.append(real(df)) or written[-1])
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.digest_table(docs).collect()}
    assert {d: n for d, n in removed.items() if n} == {3: 60, 7: 60}
    assert sum(df.count() for df in written) < substrings.segment_table(docs, substrings.WINDOW).count() / 4


def test_wide_beams_are_searched_a_few_at_once(monkeypatch):
    """All vectors are near each other, so beams widen until they hold all; what is held at once stays bounded."""
    x = np.random.default_rng(6).normal(size=(1, 16)) + 0.02 * np.random.default_rng(7).normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    monkeypatch.setattr(hnsw, "BEAMS", 1 << 12)
    monkeypatch.setattr(hnsw, "SCANNED", 1 << 14)
    at, q, node = zip(*graph.within(x.astype(np.float32), 0.95, 48))
    assert sum(map(len, q)) == 900 * 900
    assert max(map(len, q)) <= 1 << 14


def test_a_graph_comes_in_pieces_and_queries_stream_after_it(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    asked = x + 0.05 * rng.normal(size=x.shape).astype(np.float32)
    monkeypatch.setattr(neighbours, "PIECE", 1000)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "MEASURED", 100)
    single, double = pa.list_(pa.float32()), pa.list_(pa.float64())
    lists = lambda v: {"whole": pa.array(v.tolist(), single), "exact": pa.nulls(len(v), double)}
    same = {"dim": pa.array([8] * 500, pa.int32()), "shard": [3] * 500, "node": range(500)}
    built = neighbours._build(pa.table({**same, "rank": range(500), "copies": [1] * 500, **lists(x)}), 0.95)
    pieces = built.slice(500)
    n = pieces.num_rows
    assert n > 10 and pieces.column("graph").null_count == 0 and built.slice(0, 500).column("graph").null_count == 500
    none = {"whole": pa.nulls(n, single), "exact": pa.nulls(n, double)}
    first = pa.table({**{c: pieces.column(c) for c in ("dim", "shard", "piece", "graph")}, "block": [0] * n, "node": pa.nulls(n, pa.int64()), **none})
    rest = pa.table({**same, "block": [0] * 500, "piece": pa.nulls(500, pa.int32()), "graph": pa.nulls(500, pa.binary()), **lists(asked)})
    batches = pa.concat_tables([first, rest.select(first.column_names)]).to_batches(70)
    links = sum(sum(b.column("links").to_pylist()) for b in neighbours._ask(0.95)(iter(batches)))
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (asked.astype(float), x.astype(float)))
    assert links == (a @ b.T >= 0.95).sum() > 400
