"""Whitening of vectors, by a covariance that is computed tile by tile.

Entries become whole numbers, so that counts, sums and deviations are exact. For
the covariance the rows are taken in blocks, and the columns of a block in
column blocks; each pair of column blocks is a tile of the covariance. The
column blocks of a row block go to the task of each tile and row block that
needs them, are centred there, multiplied, and summed over what the task holds;
sums of tasks are added entry by entry. So no task needs more than some pairs of
column blocks and its tiles, however many rows or dimensions there are. The
driver gets sums alone: one number a dimension, and one for each pair of
dimensions, from which it takes the eigenvectors.

Defined results: vectors that are null or empty, or hold null, infinite or NaN
entries or entries of 2^52 and more (which have no long), take no part and have no
rows; of vectors of several lengths those of the most frequent length (of equals,
the greatest) take part. Rows with a null id, and rows that share an id or a
vector, are rows like others. Where the covariance has no spread along a
component (a single row, equal rows, more components than independent
dimensions) whitened is 0 and identity_error 1, as nothing can make the variance 1.
A deviation beyond a long is null. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.plans.arrow import giving_back
from factloom.plans.scratch import Scratch

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows of a row block, and dimensions of a column block.
ROWS, COLUMNS = 4096, 32
_LARGEST = float(1 << 52)
_LONG = (1 << 63) - 1


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, x) of the vectors that take part, as whole numbers."""
    good = lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False))
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", good), F.lit(False))).select("id", x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python's integers."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest + max(map(abs, sums)) < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _spread(x, n, sums).astype(np.float64) / n


def _deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of whole numbers; None beyond a long."""
    largest = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    if largest * largest * y.shape[1] <= _LONG:
        return np.einsum("ij,ij->i", y, y).tolist()
    z = y.astype(object)
    return [d if d <= _LONG else None for d in (z * z).sum(axis=1)]


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in _blocks(batches):
            x = _matrix(batch.column(0), dims)
            fits = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < _LONG
            n, sums = n + len(x), sums + x.sum(axis=0, dtype=np.int64 if fits else object).astype(object)
        if n:
            out = pa.array([str(s) for s in (n, *sums)])
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), out], names=["dim", "s"])

    found = rows.select("x").mapInArrow(giving_back(run), "dim int, s string")
    of = {r.dim: int(r.s) for r in found.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return of.get(-1, 0), [of.get(i, 0) for i in range(dims)]


def covariance(rows: DataFrame, dims: int, n: int, sums: list[int], columns: int = COLUMNS) -> np.ndarray:
    """The covariance (divisor n) of rows (x), tile by tile."""
    edges = [(lo, min(lo + columns, dims)) for lo in range(0, dims, columns)]
    tiles = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    dealt = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("i", "j", "rows")] + [T.StructField("block", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("a", "b")]
    )
    target = to_arrow_schema(dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in _blocks(batches):
            x = _matrix(batch.column(0), dims)
            small = x.min() >= -(1 << 31) and x.max() < 1 << 31
            parts = [np.ascontiguousarray(x[:, lo:hi].astype("<i4" if small else "<i8")).tobytes() for lo, hi in edges]
            for i, j in tiles:  # one at a time: a row is two column blocks
                yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "rows": len(x), "block": block, "a": parts[i], "b": parts[j] if i != j else None}], schema=target)
            block += 1

    summed = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("tile", pa.list_(pa.float64()))])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}

        def part(raw: bytes, k: int, m: int) -> np.ndarray:
            lo, hi = edges[k]
            x = np.frombuffer(raw, "<i4" if len(raw) == 4 * m * (hi - lo) else "<i8").reshape(m, hi - lo).astype(np.int64)
            return _centred(x, n, sums[lo:hi])

        for batch in batches:
            for r in range(batch.num_rows):
                i, j, m, _, a, b = (c[r].as_py() for c in batch.columns)
                left = part(a, i, m)
                tile = left.T @ (left if b is None else part(b, j, m))
                found[i, j] = found[i, j] + tile if (i, j) in found else tile
        for (i, j), tile in found.items():
            yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "tile": tile.ravel().tolist()}], schema=summed)

    blocks = rows.select("x").mapInArrow(giving_back(deal), dealt).repartition("i", "j", "block")
    partial = blocks.mapInArrow(giving_back(multiply), "i int, j int, tile array<double>")
    each = partial.select("i", "j", F.posexplode("tile").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum("value").alias("value"))
    whole = np.zeros((dims, dims))
    for r in each.toLocalIterator():
        (lo, _), (left, right) = edges[r.i], edges[r.j]
        u, v = lo + r.at // (right - left), left + r.at % (right - left)
        whole[u, v] = whole[v, u] = r.value / n
    return whole


def principal(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return values, vectors * np.where(sign == 0, 1, sign)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, columns: int = COLUMNS) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    kinds = (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(k, t) for k, t in kinds])
    rows = Scratch(spark, "whitening").save(whole_numbers(df, id_col, vector_col), "vectors")
    length = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length.dims
    rows = rows.where(F.size("x") == dims)
    n, sums = column_sums(rows, dims)
    cov = covariance(rows, dims, n, sums, columns)
    values, vectors = principal(cov, min(components, dims))
    trace = float(np.trace(cov))
    flat = values <= max(trace, 0.0) * dims * np.finfo(float).eps
    to_white = np.where(flat, 0.0, vectors / np.sqrt(np.where(flat, 1.0, values)))
    explained = (np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))).tolist()
    k = len(values)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in _blocks(batches):
            white = _centred(_matrix(batch.column(0), dims), n, sums) @ to_white
            total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    products = rows.select("x").mapInArrow(giving_back(scatter), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    identity = np.zeros(k * k)
    identity[[r.at for r in products]] = [r.value / n for r in products]
    error = float(np.abs(identity.reshape(k, k) - np.eye(k)).max())
    target = to_arrow_schema(schema)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            m = batch.num_rows
            y = _spread(_matrix(batch.column(1), dims), n, sums)
            white = (y.astype(np.float64) / n) @ to_white
            each = np.repeat(np.arange(m), k)
            found = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(_deviations(y), pa.int64()).take(pa.array(each)),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, target, strict=True)], schema=target)

    return rows.select("id", "x").mapInArrow(giving_back(result), schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components, each of variance 1."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
