import pytest
from pyspark.sql import functions as F

from lectern.operators.skew import (
    heavy_keys,
    key_counts,
    order_edges,
    range_of,
    rank_in_group,
    salted_join,
)


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds a third of the left rows, key 1 a third of the right rows."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("int").alias("k"),
        F.col("id").alias("a"),
    )
    right = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 89).cast("int").alias("k"),
        F.col("id").alias("b"),
    )
    return left, right


@pytest.mark.parametrize("both", [False, True])
def test_salting_changes_no_row(hot, both):
    left, right = hot
    want = sorted(map(tuple, left.join(right, "k").select("a", "b").collect()))
    got = salted_join(
        left, right, ["k"], ["a"], rows_per_salt=20,
        right_counts=key_counts(right, ["k"]) if both else None, right_spread_by=["b"],
    )
    assert sorted(map(tuple, got.select("a", "b").collect())) == want


def test_salted_left_join_keeps_every_left_row_once(hot):
    left, right = hot
    one = right.groupBy("k").agg(F.max("b").alias("b")).where("k > 3")
    want = sorted(map(str, left.join(one, "k", "left").select("a", "b").collect()))
    got = salted_join(left, one, ["k"], ["a"], "left", rows_per_salt=20)
    assert sorted(map(str, got.select("a", "b").collect())) == want
    with pytest.raises(ValueError):
        salted_join(left, one, ["k"], ["a"], "left", right_counts=key_counts(one, ["k"]))


def test_heavy_keys_are_few(spark, monkeypatch):
    monkeypatch.setattr("lectern.operators.skew.MAX_HEAVY", 100)
    n = F.when(F.col("id") < 150, 10_000).otherwise(1)
    counts = spark.range(5000).select(F.col("id").alias("k"), n.alias("n"))
    # 150 keys share nearly all rows, so none holds more than a hundredth of them.
    assert heavy_keys(counts, ["k"], rows_per_salt=1) is None
    heavy = heavy_keys(counts.where("k >= 90"), ["k"], rows_per_salt=1)
    assert heavy.count() == 60
    assert heavy.where("n_salt < 2").count() == 0
    assert heavy_keys(counts.where("k < 0"), ["k"]) is None


@pytest.mark.parametrize("limit", [None, 0, 5, 1500])
def test_ranking_in_ranges_equals_one_window(spark, limit):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("q"),
        (F.col("id") * 7).alias("row_idx"),
        (F.col("id") % 4 == 1).alias("is_exact"),
    )
    got = rank_in_group(rows, ["q"], "row_idx", "is_exact", limit, block=100)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (not r.is_exact, r.row_idx)):
        want.setdefault(r.q, []).append(r.row_idx)
    expected = sorted(
        (q, i + 1, row) for q, all_rows in want.items() for i, row in enumerate(all_rows[:limit])
    )
    assert sorted((r.q, r["rank"], r.row_idx) for r in got.collect()) == expected


@pytest.mark.parametrize("order", ["id", "xxhash64(id)", "id * id * id - 1000000", "9223372036854775807 - id * 1000000007"])
def test_ranges_hold_a_bounded_number_of_rows(spark, order):
    rows = spark.range(3000).select(F.expr(order).alias("row_idx"), (F.col("id") % 2).alias("q"))
    edges = order_edges(rows, "row_idx", 100)
    assert edges == sorted(set(edges)) and 25 <= len(edges) < 30
    numbers = [r.row_idx for r in rows.collect()]
    got = rows.select("row_idx", range_of(F.col("row_idx"), edges).alias("at")).collect()
    assert all(r.at == sum(e <= r.row_idx for e in edges) for r in got)
    held = [sum(r.at == i for r in got) for i in range(len(edges) + 1)]
    assert max(held) <= 150 and sum(held) == len(numbers)
    ranked = rank_in_group(rows, ["q"], "row_idx", block=100).orderBy("q", "rank").collect()
    want = sorted((r.q, r.row_idx) for r in rows.collect())
    assert [(r.q, r.row_idx) for r in ranked] == want
    assert [r["rank"] for r in ranked] == [*range(1, 1501)] * 2


def test_ranges_of_few_or_no_rows(spark, monkeypatch):
    assert order_edges(spark.range(0), "id", 10) == order_edges(spark.range(10), "id", 10) == []
    assert rank_in_group(spark.range(0).withColumn("q", F.lit(1)), ["q"], "id").collect() == []
    monkeypatch.setattr("lectern.operators.skew.MAX_HEAVY", 7)
    assert len(order_edges(spark.range(3000), "id", 10)) == 6  # the bound on ranges wins
    same = spark.range(500).select(F.col("id").alias("q"), F.lit(5).alias("verse"))
    assert order_edges(same, "verse", 10) == [5]
    assert {r["rank"] for r in rank_in_group(same, ["q"], "verse", block=10).collect()} == {1}


def test_negative_limit(spark):
    with pytest.raises(ValueError):
        rank_in_group(spark.range(1), ["id"], "id", limit=-1)
