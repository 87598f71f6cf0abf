"""Exact top-k by inner product over M-trees of shards, in two rounds.

Vectors go to the nearest of a bounded number of pivots; a pivot with many is split into shards of a bounded
size, and each shard is bulk-loaded into pages that are written out once. A query first asks one shard
near it. The k-th score found there bounds the second round, which asks only the shards of pivots
whose covering radius lets them hold something as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.staging import stage

from .mtree import Node, Tree, build, distances, lift, search

#: Vectors of a shard, about; a shard is one task's memory.
SHARD_ROWS = 8192
#: Pivots at most; they and their radii are sent to every task.
PIVOTS = 1024
#: Rows that a batch of routes has, about; a query's own stay together.
ROUTED = 16_384
#: Pages that are written, and read again, at once.
PAGES_HELD = 64

_PAGES = "shard int, kind int, node int, uid long, id long, floor double, top double, radius double, x binary, parent binary, radii binary, children binary, ids binary"
_LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(id, x, length): floor(scale * component) as doubles, and the squared length; only sound vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, lengths = [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    xs.append(x.tobytes())
                    lengths.append(float(x @ x))
            columns = [pa.array(ids, pa.int64()), pa.array(xs, pa.binary()), pa.array(lengths, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "length"])

    return df.mapInArrow(run, "id long, x binary, length double")


def _matrix(xs, dim: int) -> np.ndarray:
    """Rows of bytes as vectors of dim components; a shorter one goes on with zeros."""
    out = np.zeros((len(xs), dim))
    for row, x in zip(out, xs):
        v = np.frombuffer(x, np.float64)
        row[: len(v)] = v
    return out


def _placed(base: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """base with its nearest pivot and the distance to it."""
    lifts, dim = lift(pivots, top), pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("x").to_pylist(), dim)
            up = lift(own, top)
            near = np.argmax(own @ pivots.T + up[:, None] * lifts, axis=1) if len(own) else np.zeros(0, np.int64)
            far = np.sqrt(((own - pivots[near]) ** 2).sum(1) + (up - lifts[near]) ** 2)
            columns = [*batch.columns, pa.array(near, pa.int32()), pa.array(far, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot", "far"])

    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes).replace("bigint", "long")
    return base.mapInArrow(run, kinds + ", pivot int, far double")


def _pages(group: pd.DataFrame, top: float, dim: int) -> pd.DataFrame:
    tree = build(group["id"].to_numpy(np.int64), _matrix(list(group["x"]), dim), top)
    rows = []
    for place, n in enumerate(tree.nodes):
        held = [np.ascontiguousarray(a).tobytes() for a in (n.vectors, n.parent, n.radii, n.children, n.ids)]
        if not place:  # the root also has the tree's centre, before its entries
            held[0] = tree.centre.tobytes() + held[0]
        rows.append((int(group["shard"].iloc[0]), 0, place, None, None, None, top, tree.radius, *held))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGES.split(", ")])


def _read(rows: list[dict], dim: int) -> Tree:
    tree = Tree(rows[0]["top"], np.frombuffer(rows[0]["x"], np.float64)[:dim], rows[0]["radius"])
    for place, r in enumerate(rows):
        x = np.frombuffer(r["x"], np.float64)[0 if place else dim :]
        parent, radii = (np.frombuffer(r[c], np.float64) for c in ("parent", "radii"))
        children, ids = (np.frombuffer(r[c], np.int64) for c in ("children", "ids"))
        tree.nodes.append(Node(x.reshape(len(parent), dim), parent, radii, children, ids))
    return tree


def _ask(pages: DataFrame, routed: DataFrame, k: int, dim: int, shards: int) -> DataFrame:
    """(uid, query_id, vec_id, score, computed) of the k best in each shard asked.

    A shard's pages come once and first, its queries stream after them.
    """
    names = [c.split()[0] for c in _PAGES.split(", ")]
    asked = routed.select(*[F.col(c) if c in routed.columns else F.lit(None).alias(c) for c in names])
    both = pages.union(asked.withColumn("kind", F.lit(1)).select(*names))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, tree = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["shard"] != at:
                    at, rows, tree = r["shard"], [], None
                if r["kind"] == 0:
                    rows.append(r)
                    continue
                if tree is None:
                    tree, rows = _read(rows, dim), []
                floor = -np.inf if r["floor"] is None else r["floor"]
                found = search(tree, _matrix([r["x"]], dim)[0], r["id"], k, floor)
                for score, i in zip(found.scores, found.ids):
                    out.append((r["uid"], r["id"], i, max(-_LONG - 1, min(_LONG, score)), found.computed))
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*out)) if out else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "query_id", "vec_id", "score", "computed"])

    return both.mapInArrow(run, "uid long, query_id long, vec_id long, score long, computed long")


def _routes(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, top: float) -> DataFrame:
    """(uid, id, x, floor, home, pivot) for every pivot that may hold a score of floor or more.

    A query can have as many rows as there are pivots, so batches are cut by what they may become.
    """
    lifts, dim = lift(pivots, top), pivots.shape[1]
    most = max(ROUTED // len(pivots), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
            rows, pivot = [], []
            for i, (x, floor) in enumerate(zip(batch.column("x").to_pylist(), batch.column("floor").to_pylist())):
                q = _matrix([x], dim)[0]
                length = float(q @ q)
                far = distances(pivots, lifts, q, 0.0)
                reach = np.inf if floor is None else np.sqrt(max(length + top - 2.0 * floor, 0.0)) + 1e-7 * np.sqrt(length + top + 1.0)
                near = np.flatnonzero(far - radii <= reach)
                rows += [i] * len(near)
                pivot += near.tolist()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(pivot, pa.int32())], [*taken.schema.names, "pivot"])

    return queries.select("uid", "id", "x", "floor", "home").mapInArrow(
        run, "uid long, id long, x binary, floor double, home int, pivot int"
    )


def top_k(df: DataFrame, asked: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(scale * component) for each row in asked.

    asked is a condition on df's columns. Candidates are all rows but those with the query's own id.
    Ties go to the smaller id; a query with fewer than k candidates gets them all. Rows with a null id, a null vector or one with
    null or non-finite components take no part. A shorter vector goes on with zeros, an empty one scores 0.
    A repeated row is a candidate each time and, if asked, a query each time. An empty table, or one without
    queries, gives no rows. Other columns aren't looked at. Scores past 64 bits stand at the end of their range.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    base = stage(whole_vectors(rows.select("id", "v"), scale))
    asking = stage(whole_vectors(rows.where("asked").select("id", "v"), scale).withColumn("uid", F.monotonically_increasing_id()))
    count, top, size = base.agg(F.count("*"), F.max("length"), F.max(F.octet_length("x"))).first()
    spark, names = df.sparkSession, ["query_id", "rank", "vec_id", "score"]
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, wanted = max(size // 8, 1), min(PIVOTS, -(-count // SHARD_ROWS))
    sample = base.select("x", F.xxhash64("id", "x").alias("h")).orderBy("h", "x").limit(2 * wanted).collect()
    pivots = _matrix(list(dict.fromkeys(bytes(r["x"]) for r in sample))[:wanted], dim)
    placed = stage(_placed(base, pivots, top).withColumn("n", F.monotonically_increasing_id()))
    held = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    radii, parts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in held:
        radii[r["pivot"]], parts[r["pivot"]] = r["radius"], -(-r["n"] // SHARD_ROWS)
    first = np.concatenate([[0], np.cumsum(parts)])
    shards = int(first[-1])
    # at most PIVOTS rows; its size isn't known to Spark, which would shuffle all vectors by pivot
    spots = F.broadcast(spark.createDataFrame([(p, int(first[p]), int(parts[p])) for p in range(len(parts)) if parts[p]], "pivot int, first int, parts int"))
    shard = lambda n: (F.col("first") + F.pmod(F.xxhash64(n), "parts")).cast("int")
    rows = placed.join(spots, "pivot").select(shard("n").alias("shard"), "id", "x")
    pages = stage(rows.groupBy("shard").applyInPandas(lambda g: _pages(g, top, dim), _PAGES), rows_held=PAGES_HELD)
    # the first round asks one shard of the nearest pivot
    homes = stage(_placed(asking, pivots, top).join(spots, "pivot").withColumn("home", shard("uid")).drop("first", "parts", "pivot", "far"))
    near = stage(_ask(pages, homes.withColumn("shard", F.col("home")), k, dim, shards))
    floor = near.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    bounded = homes.join(floor, "uid", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")))
    routed = _routes(bounded, pivots, radii, top).join(spots, "pivot")
    routed = routed.withColumn("shard", F.explode(F.expr("sequence(first, first + parts - 1)"))).where("shard <> home")
    more = stage(_ask(pages, routed.drop("pivot", "first", "parts", "home"), k, dim, shards))
    ranked = near.union(more).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(*names)
