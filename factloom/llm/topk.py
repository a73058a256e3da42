"""Exact search for the k largest inner products: ball trees, branch and bound.

Vectors become integers, floor(scale * x). They are dealt once into cells, by
the nearest of some of them, and each cell into shards of bounded bytes; a shard
builds one ball tree, and queries stream through it. A query visits a tree's
nodes best bound first: no vector in a ball with centre c and radius r scores
over q.c + |q| r. It stops where the bound falls under the query's kth score so
far. That score is shared: a first wave takes each query to one shard of the
cell of its best bound, and only cells whose bound reaches the kth score found
there are visited in the second; within a shard the score passes on from leaf to
leaf. Vectors are shuffled twice, whatever the number of queries, a task's
memory is a shard and a batch of queries, and each shard returns at most k rows
for a query.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; every other row is a candidate of every
query but its own row, also if ids are repeated, and each row that asks is a
query; a shorter vector counts as filled up with zeros; ties go to the smaller
id; an empty table or one without queries gives no rows; other columns are
ignored. Scores are exact, and ranked exactly, up to 37 decimal digits (beyond
it they are cut to that and ties, as are components beyond 1e100); those that no long holds are returned as the
largest or smallest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from factloom.plans.arrow import giving_back
from factloom.plans.scratch import Scratch

#: Bytes and rows of a shard at most, rows of a tree's leaf, cells at most, queries whose bounds are computed at once.
SHARD_BYTES, SHARD, LEAF, CELLS, BATCH = 32 << 20, 1 << 16, 256, 256, 256
#: Scores, and components, are cut to these.
MOST, WIDEST = 10**37, 1e100


def matrix(vectors: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, short vectors filled up with zeros."""
    ends = vectors.offsets.to_numpy()
    sizes, flat = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return np.floor(np.clip(scale * out, -WIDEST, WIDEST))


class BallTree:
    """A ball tree over integer vectors; ids break ties, and ``rows`` tell rows of one id apart."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.rows = ids[order], points[order], (ids if rows is None else rows)[order]
        self.largest = float(np.abs(points).max(initial=0))
        self.parts: list[tuple[np.ndarray, float]] = []
        self.below: list[tuple[int, int] | None] = []
        self.own: list[np.ndarray | None] = []
        if len(ids):
            self._build(np.arange(len(ids)))
            self.centres, self.radii = np.array([c for c, _ in self.parts]), np.array([r for _, r in self.parts])

    def _build(self, own: np.ndarray) -> int:
        points = self.points[own]
        centre = points.mean(axis=0)
        away = ((points - centre) ** 2).sum(axis=1)
        at, radius = len(self.parts), float(np.sqrt(away.max()))
        self.parts.append((centre, radius))
        self.below.append(None)
        self.own.append(own)
        if len(own) > LEAF and radius > 0:
            far = points[np.argmax(away)]
            other = points[np.argmax(((points - far) ** 2).sum(axis=1))]
            order = np.argsort(points @ (other - far), kind="stable")
            half = len(own) // 2
            self.below[at] = self._build(np.sort(own[order[:half]])), self._build(np.sort(own[order[half:]]))
            self.own[at] = None
        return at

    def _scores(self, query: np.ndarray, own: np.ndarray) -> np.ndarray:
        if float(np.abs(query).max(initial=0)) * self.largest * max(1, len(query)) < 2.0**52:
            return self.points[own] @ query
        whole = [int(x) for x in query]
        exact = [sum(a * int(b) for a, b in zip(whole, p, strict=True)) for p in self.points[own]]
        return np.array([max(-MOST, min(MOST, x)) for x in exact], dtype=object)

    def search(self, queries: np.ndarray, own_rows: list, k: int, floors: list) -> Iterator[list[tuple[int, int]]]:
        """For each query at most k (score, id), best first, of those that can be in the result given its kth score so far."""
        for i in range(0, len(queries), BATCH):
            some = queries[i : i + BATCH]
            norms = np.sqrt((some**2).sum(axis=1))[:, None]
            bounds = some @ self.centres.T
            bounds += norms * self.radii
            bounds += 1e-9 * (np.abs(bounds) + norms * (1 + np.abs(self.centres).max(initial=0)) + 1)
            for j, q in enumerate(some):
                yield self._best(q, bounds[j].tolist(), own_rows[i + j], k, floors[i + j])

    def _best(self, query: np.ndarray, bound: list, own_row: int, k: int, floor: float) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        heap = [(-bound[0], 0)]
        while heap:
            top, i = heapq.heappop(heap)
            if -top < floor:
                break
            if self.below[i] is not None:
                for j in self.below[i]:
                    if bound[j] >= floor:
                        heapq.heappush(heap, (-bound[j], j))
                continue
            own = self.own[i]
            scores = self._scores(query, own)
            near = np.flatnonzero((scores >= floor) & (self.rows[own] != own_row))
            if len(near) > k:  # ids are in order, so that of equal scores the smaller ids come first
                near = near[np.argsort(-scores[near], kind="stable")[:k]]
            for score, point in zip(scores[near].tolist(), self.ids[own[near]].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (int(score), -point))
                else:
                    heapq.heappushpop(best, (int(score), -point))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def found_schema(large: bool) -> T.StructType:
    """Found rows; ``large``: scores that a long may not hold."""
    return T.StructType([*(T.StructField(k, T.LongType()) for k in ("query_row", "query_id", "vec_id")), T.StructField("score", T.DecimalType(38, 0) if large else T.LongType())])


def _floors(given: pa.Array) -> np.ndarray:
    """Scores that a result must reach: none for null, and no more than the exact one where a double is coarse."""
    floor = np.array([-np.inf if x is None else x for x in given.to_pylist()], float)
    return np.where(np.abs(floor) < 2.0**53, floor, np.nextafter(floor, -np.inf))


def _visit(points: DataFrame, queries: DataFrame, shards: int, width: int, scale: float, k: int, large: bool) -> DataFrame:
    """What queries (shard, row, id, v, floor) find in the trees over points (shard, row, id, v)."""
    shape = found_schema(large)
    target = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard) | np.diff(asks)) + 1).tolist(), len(shard)]
            for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                if lo == hi:
                    continue
                if shard[lo] != now:
                    now, held, tree = shard[lo], [], None
                rows, ids, vectors, floors = (batch.column(i).slice(lo, hi - lo) for i in (2, 3, 4, 5))
                own = rows.to_numpy(), ids.to_numpy(), matrix(vectors, width, scale)
                if not asks[lo]:
                    held.append(own)
                    continue
                if tree is None and held:
                    tree, held = BallTree(*(np.concatenate([h[i] for h in held]) for i in (1, 2, 0))), []
                if tree is None:
                    continue
                floor = _floors(floors).tolist()
                out = [(r, q, point, Decimal(score) if large else score) for r, q, best in zip(own[0].tolist(), own[1].tolist(), tree.search(own[2], own[0].tolist(), k, floor), strict=True) for score, point in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    blank = F.lit(None).cast("double").alias("floor")
    both = points.select("shard", F.lit(0).alias("asks"), "row", "id", "v", blank).unionByName(queries.select("shard", F.lit(1).alias("asks"), "row", "id", "v", "floor"))
    return both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "asks").mapInArrow(giving_back(run), shape)


def _near(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the distance."""
    cell = np.argmin((centres**2).sum(axis=1) - 2 * (vectors @ centres.T), axis=1)
    return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(axis=1))


def top_inner_products(df: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the column ``is_query`` holds, the k best others."""
    scratch = Scratch(df.sparkSession, "topk")
    vector = F.col(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = df.where(F.col(id_col).isNotNull() & vector.isNotNull() & whole)
    rows = scratch.save(given.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, asking, width, most = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n or not asking:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    large = width * min(scale * (most or 0.0) + 1, WIDEST) ** 2 >= 2.0**62
    size = max(1, min(SHARD, SHARD_BYTES // (8 * width)))
    chosen = rows.orderBy(F.xxhash64("row"), "row").select("v").limit(min(CELLS, -(-n // size))).toArrow()["v"].combine_chunks()
    centres = matrix(chosen, width, scale)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = _near(matrix(b.column(2), width, scale), centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["row", "id", "v", "asks", "cell", "away"])

    dealt = scratch.save(rows.mapInArrow(deal, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])), "cells")
    found = {r["cell"]: (r["n"], r["r"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()}
    cells = sorted(found)
    pieces = np.array([-(-found[c][0] // size) for c in cells])  # shards of a cell
    start = np.cumsum([0, *pieces])
    middles, radii = centres[cells], np.array([found[c][1] for c in cells])
    first_of = F.create_map(*(F.lit(int(x)) for c, s in zip(cells, start) for x in (c, s)))  # noqa: B905
    pieces_of = F.create_map(*(F.lit(int(x)) for c, p in zip(cells, pieces, strict=True) for x in (c, p)))
    points = dealt.select((first_of[F.col("cell")] + F.pmod(F.xxhash64("row", F.lit(5)), pieces_of[F.col("cell")]).cast("int")).alias("shard"), "row", "id", "v")
    shape = "row long, id long, v array<double>, floor double, shard int"

    def aim(wave: int):
        """Queries (row, id, v, floor) with the shards of the wave: one of the best cell, then all others that the floor allows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = matrix(b.column(2), width, scale)
                norms = np.sqrt((q**2).sum(axis=1))[:, None]
                bounds = q @ middles.T + norms * radii
                bounds += 1e-9 * (np.abs(bounds) + norms * (1 + np.abs(middles).max(initial=0)) + 1)
                best = start[np.argmax(bounds, axis=1)]
                if wave == 1:
                    at, shard = np.arange(len(q)), best
                else:
                    floor = _floors(b.column(3))
                    at, shard = np.nonzero(np.repeat(bounds >= floor[:, None], pieces, axis=1))
                    at, shard = at[shard != best[at]], shard[shard != best[at]]
                for i in range(0, len(at), 4096):
                    part = b.take(pa.array(at[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard[i : i + 4096].astype(np.int32))], names=["row", "id", "v", "floor", "shard"])

        return run

    asked = rows.where("asks").select("row", "id", "v")
    shards = int(start[-1])
    ahead = asked.withColumn("floor", F.lit(None).cast("double")).mapInArrow(aim(1), shape)
    one = scratch.save(_visit(points.where(F.col("shard").isin([int(x) for x in start[:-1]])), ahead, len(cells), width, scale, k, large), "ahead")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    rest = asked.join(kth, "row", "left").select("row", "id", "v", "floor").mapInArrow(aim(2), shape)
    every = one.unionByName(_visit(points, rest, shards, width, scale, k, large))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    edge = (1 << 63) - 1
    score = F.greatest(F.lit(-edge - 1).cast("decimal(38,0)"), F.least(F.lit(edge).cast("decimal(38,0)"), F.col("score"))).cast("long") if large else F.col("score")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every hundredth vector."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), n AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""
