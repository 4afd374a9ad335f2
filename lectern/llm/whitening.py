"""Whitening of embeddings with a covariance that is exact until its last division.

Entries are made whole numbers first. Sums, squares of centred values and squares of centred sums of two dimensions
are then whole numbers as well: a covariance is half the difference between the variance of a
sum and the two variances (polarisation). Tasks add them up without rounding and hand on one number per
pair of dimensions; only the finished table of d(d+1)/2 numbers reaches the driver for eigh.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

SCALE = 256.0
COMPONENTS = 4
# Eigenvalues below this share of the largest are rounding, not variance.
RANK_SHARE = 1e-12
# Products held at once, and the bound under which sums of whole numbers stay exact in 64 bits.
BLOCK, EXACT = 1 << 20, 1 << 62


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: entries as ``floor(256 * c)``; rows whose vector is null, empty or holds a null or an entry that is not finite are dropped."""
    given = F.col(vector_col).cast("array<double>")
    finite = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return table.select(F.col(id_col).alias("vec_id"), given.alias("given"), (finite & (F.size(given) > 0)).alias("fits")).filter("fits").select(
        "vec_id", F.transform("given", lambda c: F.floor(c * SCALE)).alias("x")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK // max(1, width))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            yield part, _matrix(part.column("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums`` as whole numbers: in 64 bits where that is exact, else as Python numbers."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums), default=0) >= EXACT:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sum of squares of each column."""
    if not len(values):
        return [0] * values.shape[1]
    most = max(abs(int(values.min())), abs(int(values.max())))
    if values.dtype != object and most * most * len(values) < EXACT:
        return (values * values).sum(axis=0).tolist()
    if values.dtype != object and most < 1 << 50:
        # value = high * 2^25 + low, so that the three sums stay small
        high, low = values >> 25, values & ((1 << 25) - 1)
        if len(values) <= 1 << 10:
            parts = [(a * b).sum(axis=0).tolist() for a, b in ((high, high), (high, low), (low, low))]
            return [(h << 50) + (m << 26) + s for h, m, s in zip(*parts, strict=True)]
        half = len(values) // 2
        return [a + b for a, b in zip(square_sums(values[:half]), square_sums(values[half:]), strict=True)]
    return (values.astype(object) ** 2).sum(axis=0).tolist()


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    rows = 0
    for part, x in _blocks(batches, 1024):
        most = max(abs(int(x.min())), abs(int(x.max())))
        own = (x if most * len(x) < EXACT else x.astype(object)).sum(axis=0).tolist()
        total = [a + b for a, b in zip(total, own, strict=True)] if total else own
        rows += part.num_rows
    if rows:
        yield _numbers(list(range(-1, len(total))), [0] * (len(total) + 1), [rows, *total])


def _numbers(i: list[int], j: list[int], value: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in value], pa.decimal128(38, 0))], names=["i", "j", "value"]
    )


def _squares(n: int, sums: list[int]):
    """For every dimension the squares of its centred values, and for every two those of their sum."""
    width = len(sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width - i) for i in range(width)]
        rows = 0
        for part, x in _blocks(batches, width):
            z = centred(x, n, sums)
            for i in range(width):
                pair = z[:, i:] + z[:, i : i + 1]
                pair[:, 0] = z[:, i]
                total[i] = [a + b for a, b in zip(total[i], square_sums(pair), strict=True)]
            rows += part.num_rows
        if rows:
            for i in range(width):
                yield _numbers([i] * (width - i), list(range(i, width)), total[i])

    return run


def _added(found: DataFrame) -> dict[tuple[int, int], int]:
    return {(r.i, r.j): int(r.value) for r in found.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


class Whitening:
    """Mean, covariance and leading components of a list of whole vectors."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int = COMPONENTS):
        width = len(sums)
        self.n, self.sums = n, sums
        self.covariance = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                twice = 2 * squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
                # The quotient of two whole numbers is rounded once.
                self.covariance[i, j] = self.covariance[j, i] = twice / (2 * n**3)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(values)[::-1][:components]
        order = order[values[order] > RANK_SHARE * max(values.max(initial=0.0), 0.0)]
        trace = sum(squares[i, i] for i in range(width)) / n**3
        self.values = values[order]
        # The sign of a component is fixed by its largest entry.
        found = vectors[:, order]
        self.vectors = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]) if len(order) else found
        self.explained = self.values / trace if len(order) else self.values

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened values of centred vectors ``n * x - sums``."""
        return (z / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a written list of whole vectors ``x`` of one length; None for an empty list."""
    kind = "i int, j int, value decimal(38,0)"
    first = _added(vectors.select("x").mapInArrow(_sums, kind))
    if not first:
        return None
    n = first.pop((-1, 0))
    sums = [first[i, 0] for i in range(len(first))]
    return Whitening(n, sums, _added(vectors.select("x").mapInArrow(_squares(n, sums), kind)), components)


def identity_error(vectors: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened values minus the identity, measured over ``vectors``."""
    k, width = len(whitening.values), len(whitening.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches, width):
            w = whitening.project(centred(x, whitening.n, whitening.sums))
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        i, j = np.indices((k, k))
        rows = [np.append(i.ravel(), np.arange(k)), np.append(j.ravel(), np.full(k, -1)), np.append(total.ravel(), mean)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2])], names=["i", "j", "value"])

    added = vectors.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    found = {(r.i, r.j): r.value / whitening.n for r in added}
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(k))


def _rows(whitening: Whitening, error: float, kind):
    k, width = len(whitening.values), len(whitening.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            z = centred(x, whitening.n, whitening.sums)
            white = whitening.project(z)
            deviation = np.array(square_sums(np.ascontiguousarray(z.T)), object) if len(z) else np.zeros(0, object)
            deviation = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
            rows = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, whitening.n, np.int64)),
                    deviation.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(whitening.explained, len(x))),
                    pa.array(np.full(rows, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and leading component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    The fit is over distinct vectors, so copies do not weigh. Vectors that are null or empty, hold nulls or entries that
    are not finite, or differ in length from the commonest (ties: the longest) are dropped. Components without variance
    (all vectors equal, a single vector, fewer dimensions) have no rows; so has an empty table. A deviation beyond
    64 bits is null, and entries are bounded by 64 bits. Repeated rows and ids are returned as often as they occur.
    Other columns are not read.
    """
    spark = table.sparkSession
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = whole_vectors(table, id_col, vector_col)
    distinct = written(found.select("x").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    alike = F.size("x") == lengths[0]["width"]
    whitening = fit(distinct.filter(alike), components)
    if not len(whitening.values):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct.filter(alike), whitening)
    return found.filter(alike).mapInArrow(_rows(whitening, error, kind), schema)
