"""Whitening of embeddings, with covariances by polarisation.

Entries become whole numbers.  A first pass sums them up, and each dimension is moved by its rounded mean, so what is squared is
centred and small.  A second pass adds up exact squares of every dimension and of the sum of every two dimensions; the variance
of a sum less the variances of its terms is twice their covariance, so no product of two dimensions is ever taken.  The matrix,
as large as the number of dimensions squared, is put together from whole numbers on the driver and given to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmark.llm.shared import stored

#: Rows of a block within a task.
BLOCK = 1024
#: Components whose share of the largest eigenvalue is not above this have no variance but rounding, and are left out.
LEAST = 1e-12
_SUM = "i int, j int, total decimal(38,0)"


def whole_entries(vector: Column | str, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * x) + shift`` of every entry, as long; what is beyond 2^62 in size before the shift becomes that."""
    inside = lambda x: F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-(2.0**62))), F.lit(2.0**62))
    return F.transform(vector, lambda x: F.floor(inside(x)).cast("long") + F.lit(shift).cast("long"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _small(x: np.ndarray, power: int, factor: int = 1) -> np.ndarray:
    """``x`` as longs where sums of powers over its rows fit them, else as Python's whole numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * factor
    return x if most**power * max(1, len(x)) < 1 << 62 else x.astype(object)


def _sums(rows: DataFrame, of) -> list:
    """Whole sums over all rows, by task and then over the tasks: ``of(matrix)`` gives ``[(i, j, totals)]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, int] = {}
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for i, found in of(_matrix(batch.column(0).slice(at, BLOCK))):
                    held[i] = held[i] + found.astype(object) if i in held else found.astype(object)
        for i, found in held.items():
            totals.update({(i, j): int(t) for j, t in enumerate(found)})
        if totals:
            i, j = zip(*totals)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(t) for t in totals.values()], pa.decimal128(38, 0))], ["i", "j", "total"])

    return rows.select("x").mapInArrow(run, _SUM).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()


class Whitening(NamedTuple):
    """``n`` rows; pivots (rounded means) and sums of what is left; eigenvalues and vectors (columns) by falling eigenvalue."""

    n: int
    pivot: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(np.float64) - self.rest.astype(np.float64) / self.n

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of ``(n x - S)^2``; what is beyond a long becomes its end."""
        y = x - self.pivot
        most = self.n * (abs(int(y.max(initial=0))) + abs(int(y.min(initial=0))) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            return ((self.n * y - self.rest) ** 2).sum(1)
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return np.minimum(exact, np.iinfo(np.int64).max).astype(np.int64)


def covariance(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``(n, pivots, sums of the rest, covariance)`` of ``rows(x)``, vectors of one length; the covariance has the divisor n."""
    n = rows.count()
    first = _sums(rows, lambda x: [(0, _small(x, 1).sum(0))])
    total = {r["j"]: int(r["total"]) for r in first}
    d = len(total)
    pivot = np.array([(2 * total[j] + n) // (2 * n) for j in range(d)], np.int64)
    rest = [total[j] - n * int(pivot[j]) for j in range(d)]

    def squares(x: np.ndarray):
        y = _small(x - pivot, 2, 2)
        yield -1, (y * y).sum(0)
        for i in range(d - 1):
            both = y[:, i : i + 1] + y[:, i + 1 :]
            yield i, (both * both).sum(0)

    found = {(r["i"], r["j"]): int(r["total"]) for r in _sums(rows, squares)}
    # n times the sum of squares less the square of the sum is n^2 times the variance
    own = [n * found[-1, j] - rest[j] ** 2 for j in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            both = n * found[i, j - i - 1] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return n, pivot, np.array(rest, np.int64), out


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of ``rows(x)``; no rows give none.  Components without variance are left out."""
    if rows.isEmpty():
        return None
    n, pivot, rest, matrix = covariance(rows)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > LEAST * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool))[:components]
    return Whitening(n, pivot, rest, values[keep], vectors[:, keep], float(np.trace(matrix)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, in its worst entry, from the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.white(_matrix(batch.column(0)))
            total, square = total + w.sum(0), square + w.T @ w
        yield pa.record_batch([pa.array(np.repeat(np.arange(-1, k), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()), pa.array(np.vstack([total, square]).ravel())], ["i", "j", "total"])

    k = len(model.values)
    sums = np.zeros((k + 1, k))
    for r in rows.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        sums[r["i"] + 1, r["j"]] = r["total"]
    mean = sums[0] / model.n
    return float(np.abs(sums[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``rows(vec_id, x)``, x whole numbers.

    One row for each row and component, numbered from one by falling eigenvalue.  Rows with a null vector or a null entry, and
    vectors of another length than most have (of two such lengths the longer one), take no part; rows that share an id, or
    have none, are rows like others.  Components without variance have no row, nor has an empty table; other columns are not
    read.  Deviations beyond a long become its end.
    """
    spark = rows.sparkSession
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<bigint>").alias("x")).where("size(x) > 0 and not exists(x, c -> c is null)"), "entries")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == length["d"])
    model = fit(rows, components)
    error = identity_error(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                x, m = _matrix(own.column(1)), own.num_rows
                columns = [
                    own.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(model.deviation(x), k)), pa.array(model.white(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
