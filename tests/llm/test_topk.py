"""Exact top-k through M-trees against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import mtree, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, k=5, every=50):
    sound = [
        (i, [int(np.floor(256 * float(c))) for c in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for i, q in sound:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **kind):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **kind).collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    v = centres[rng.integers(0, 8, n)] + 0.1 * rng.normal(size=(n, dim))
    return v.astype(np.float32)


def test_search_is_brute_force_and_passes_entries_over():
    v = np.floor(256 * clustered(20000, 8, 1).astype(float))
    ids = np.random.default_rng(2).permutation(20000)
    tree = mtree.build(ids, v, float((v * v).sum(1).max()))
    assert len(tree.nodes) > 20 and max(len(n.parent) for n in tree.nodes) <= mtree.PAGE
    computed = 0
    for i in range(0, 20000, 200):
        scores = (v @ v[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        got = mtree.search(tree, v[i], int(ids[i]), 5)
        assert got.ids == ids[order].tolist() and got.scores == scores[order].tolist()
        computed += got.computed
    assert computed < 100 * 20000 / 2  # less than half of all distances


def test_covering_radii_and_parent_distances_hold():
    v = np.floor(256 * clustered(3000, 6, 3).astype(float))
    top = float((v * v).sum(1).max())
    tree = mtree.build(np.arange(3000), v, top)

    def below(place):
        n = tree.nodes[place]
        return n.vectors if not len(n.children) else np.concatenate([below(c) for c in n.children])

    for n in tree.nodes:
        for centre, radius, child in zip(n.vectors, n.radii, n.children):
            own = below(child)
            up = mtree.lift(own, top)
            far = mtree.distances(own, up, centre, mtree.lift(centre[None], top)[0])
            assert far.max() <= radius + 1e-6
    assert len(below(0)) == 3000


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_all_shards_are_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    v = clustered(600, 5, 4)
    v[100:300] = v[0]  # a third of all rows are one vector: a hot pivot, and ties
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 1.0]), (None, [9.0, 9.0])]
    rows += [(250, [0.0, 0.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (7, [-1.0, -2.0]), (9, [0.3])]
    got = found(spark, rows)
    assert [(r, v) for q, r, v, _ in got if q == 0] == [(1, 2), (2, 3), (3, 9), (4, 250), (5, 7)]
    assert [v for q, _, v, _ in got if q == 250] == [0, 2, 3, 7, 9]  # all score 0: by id
    assert {q for q, *_ in got} == {0, 250}


def test_few_candidates_repeated_and_empty(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []
    # a repeated row is a candidate each time and a query each time, never its own
    assert found(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]) == sorted([(0, 1, 1, 131072), (0, 2, 1, 131072)] * 2)


def test_large_components_stay_exact(spark):
    big = float(1 << 20)  # products pass 2**53
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 1.0 + 1 / 256]), (3, [-big, 5.0])]
    assert found(spark, rows) == brute(rows)


class Batches:
    """What _routes asks of a table: the function that it maps."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_routes_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(topk, "ROUTED", 64)
    pivots = np.random.default_rng(5).normal(size=(16, 3))
    batch = pa.RecordBatch.from_pydict(
        {"uid": range(500), "id": range(500), "x": [np.zeros(3).tobytes()] * 500, "floor": pa.array([None] * 500, pa.float64()), "home": [0] * 500}
    )
    routed = list(topk._routes(Batches(), pivots, np.ones(16), 9.0)(iter([batch])))
    assert [u for b in routed for u in b.column("uid").to_pylist()] == [u for u in range(500) for _ in range(16)]  # without a floor every pivot is asked
    assert max(b.num_rows for b in routed) <= 64
