"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage

# Rows of one key above which the key is spread over several tasks.
ROWS_PER_SALT = 1_000_000
# Upper bound on the number of keys that are spread; see heavy_keys.
MAX_HEAVY = 10_000
# Largest limit for which Spark cuts a ranking window before its shuffle.
WINDOW_LIMIT = 1_000
# Rows of a range of the sort key that a table is cut into for ranking, about.
RANK_BLOCK = 1_000_000


def heavy_threshold(total: int, rows_per_salt: int) -> int:
    """Row count above which a key is heavy: max(rows_per_salt, total / MAX_HEAVY).

    At most MAX_HEAVY keys can each hold more than 1/MAX_HEAVY of all rows, so the heavy set
    is bounded whatever the data size.
    """
    return max(rows_per_salt, math.ceil(total / MAX_HEAVY))


def heavy_keys(
    counts: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame | None:
    """The few heavy keys of a (key, n) table with the salts each needs; None without any.

    Two numbers, the total and the largest count, come to the driver.
    """
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    limit = heavy_threshold(total or 0, rows_per_salt)
    if (largest or 0) <= limit:
        return None
    n_salt = F.ceil(F.col("n") / limit).cast("int").alias("n_salt")
    return stage(counts.where(F.col("n") > limit).select(*keys, n_salt))


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; combined map-side, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    right_spread_by: Sequence[str] = (),
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Equi-join in which the rows of a heavy key are spread over several tasks.

    The key counts are looked at first; where they are not given, the left side is written
    out, as it is then read twice. Without a heavy key this is a plain join, and with the
    left side's size known Spark broadcasts it or not on facts. Otherwise left rows of a
    heavy key get a salt from a hash of ``spread_by``, and the matching right rows are
    repeated once per salt; other keys keep the single salt 0. Where the right side may be
    heavy too, its counts are given and it is spread in the same way against the left. The
    heavy lists are bounded (see heavy_threshold), which makes their broadcast safe.
    """
    if right_counts is not None and how != "inner":
        raise ValueError("only an inner join may spread its right side")
    on = list(on)
    if counts is None:
        left = stage(left)
        counts = key_counts(left, on)
    left_heavy = heavy_keys(counts, on, rows_per_salt)
    right_heavy = None
    if right_counts is not None:
        right_heavy = heavy_keys(right_counts, on, rows_per_salt)
    if left_heavy is None and right_heavy is None:
        return left.join(right, on, how)
    none = (left_heavy or right_heavy).limit(0)
    heavy = F.broadcast(
        (left_heavy or none)
        .withColumnRenamed("n_salt", "_nl")
        .join((right_heavy or none).withColumnRenamed("n_salt", "_nr"), on, "full")
    )

    def salt(columns: Sequence[str], n: str) -> Column:
        own = F.pmod(F.xxhash64(*columns), F.col(n))
        return F.coalesce(own, F.lit(0)).cast("int") if columns else F.lit(0)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))

    left_salted = (
        left.join(heavy, on, "left")
        .withColumn("_l", salt(spread_by, "_nl"))
        .withColumn("_r", every("_nr"))
    )
    right_salted = (
        right.join(heavy, on, "left")
        .withColumn("_r", salt(right_spread_by, "_nr"))
        .withColumn("_l", every("_nl"))
    )
    extra = ["_nl", "_nr"]
    joined = left_salted.drop(*extra).join(right_salted.drop(*extra), [*on, "_l", "_r"], how)
    return joined.drop("_l", "_r")


def order_edges(rows: DataFrame, order: str, block: int = RANK_BLOCK) -> list[int]:
    """Lower ends of the ranges of ``order`` but the first, each range holding about ``block`` rows.

    They are quantiles of the numbers there are, so hashed or sparse numbers are cut as well
    as dense ones. A range holds one in MAX_HEAVY of all rows if that is more than ``block``,
    so the driver gets at most MAX_HEAVY numbers.
    """
    total = rows.count()
    n = -(-total // heavy_threshold(total, block))
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx(F.col(order).cast("long"), shares, 10 * n)).first()[0]
    return sorted(set(found or []))


def range_of(order: Column, edges: list[int]) -> Column:
    """Number of the range an order falls into: how many edges are at most it, by halving."""
    if not edges:
        return F.lit(0)
    # One string, made into one constant array when the query is planned.
    ends = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(ends, at + step - 1) <= order, at + step).otherwise(at),
    )


def rank_in_group(
    rows: DataFrame,
    group: Sequence[str],
    order: str,
    first: str | None = None,
    limit: int | None = None,
    block: int = RANK_BLOCK,
    rank: str = "rank",
) -> DataFrame:
    """Number the rows of each group 1.. by (``first`` true before false, ``order``).

    ``order`` is an integer, unique in its group. Without a small limit the rows are read
    three times, so pass a written table (see staging.stage). With a small limit one window
    is enough: Spark keeps only the first ``limit`` rows per group and task before the
    shuffle. Without one, a group may hold a large part of the table, so it is cut into
    ranges of ``order`` (see order_edges): rows are numbered inside each range, and the
    ranges' counts are summed up to give every range its offset. No task then has to hold
    more than one range of a group.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must be None or >= 0")
    group = list(group)
    head = [F.desc(first)] if first else []
    if limit is not None and limit <= WINDOW_LIMIT:
        w = W.partitionBy(*group).orderBy(*head, F.col(order))
        return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)

    part = [*group, *([first] if first else []), "_block"]
    cut = rows.withColumn("_block", range_of(F.col(order), order_edges(rows, order, block)))
    inner = cut.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy(order)))
    # The counts come from the numbered rows, so both branches share one shuffle.
    before = W.partitionBy(*group).orderBy(*head, F.col("_block")).rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = (
        inner.groupBy(*part)
        .agg(F.max("_n").alias("_count"))
        .withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        .drop("_count")
    )
    ranked = (
        inner.join(offsets, part)
        .withColumn(rank, (F.col("_n") + F.col("_before")).cast("long"))
        .drop("_n", "_before", "_block")
    )
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)
