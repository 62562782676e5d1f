"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Sums and scatter are exact integers, added up by Spark from one small table per task, so
that they do not depend on how the rows are dealt.  Only the scatter, whose size is the
square of the vectors' width, reaches the driver, which factorises it: the rotated columns of the
triangular factor have the roots of the eigenvalues as norms and the components as directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecohort.llm.vectors import on_grid, usable_vectors
from carecohort.storage import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_EPS = np.finfo(np.float64).eps
_WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """``components`` holds one unit eigenvector a row, by falling ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor L (as many columns as the rank) and the order of rows: ``matrix[order][:, order] = L @ L.T``."""
    left, size = matrix.astype(np.float64).copy(), len(matrix)
    factor, order = np.zeros((size, size)), np.arange(size)
    least = size * _EPS * max(np.max(np.diag(left), initial=0.0), 0.0)
    for k in range(size):
        best = k + int(np.argmax(np.diag(left)[k:]))
        if not left[best, best] > least:
            return factor[:, :k], order
        swap = [best, k]
        order[[k, best]] = order[swap]
        factor[[k, best]] = factor[swap]
        left[[k, best]] = left[swap]
        left[:, [k, best]] = left[:, swap]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and directions of ``factor``'s columns after rotating them until all are orthogonal.

    Each round rotates disjoint pairs of columns; a sweep meets every pair once.
    """
    g = np.array(factor, np.float64)
    columns = g.shape[1]
    seats = list(range(columns)) + [-1] * (columns % 2)
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[:half - 1:-1], strict=True) if min(a, b) >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            a, b = np.sum(g[:, p] ** 2, axis=0), np.sum(g[:, q] ** 2, axis=0)
            c = np.sum(g[:, p] * g[:, q], axis=0)
            open_ = np.abs(c) > _EPS * np.sqrt(a * b)
            if not open_.any():
                continue
            rotated, p, q, a, b, c = True, p[open_], q[open_], a[open_], b[open_], c[open_]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            left, right = g[:, p], g[:, q]
            g[:, p], g[:, q] = cos * left - cos * t * right, cos * t * left + cos * right
        if not rotated:
            break
    norms = np.sum(g**2, axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / np.sqrt(norms[order])


def _added(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([i for i, _ in totals], pa.int32()),
        pa.array([j for _, j in totals], pa.int32()),
        pa.array([Decimal(v) for v in totals.values()], _WHOLE),
    ], ["i", "j", "total"])


def _summed(rows: DataFrame, add) -> dict[tuple[int, int], int]:
    """Sums by (i, j) over all rows; ``add`` turns a task's batches into its own sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added(add(batches))

    parts = rows.select("vector").mapInArrow(task, "i int, j int, total decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()  # width squared rows at most
    return {(r["i"], r["j"]): int(r["total"]) for r in found}


def _scatter(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in exact integers."""
    largest = int(np.max(np.abs(y), initial=0))
    if largest * largest * len(y) < 2**53:  # every partial sum is exact in doubles
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def learn_whitening(vectors: DataFrame, width: int, n: int, scale: float = SCALE, shift: int = SHIFT) -> Whitening:
    """Fit to all ``vectors`` (a column ``vector`` of ``width`` entries, ``n`` rows).

    Vectors are centred at the whole number next to their mean before they are multiplied;
    what that leaves of the mean is taken off exactly.  Directions without spread give no component.
    """

    def sums(batches):
        total = np.zeros(width, object)
        for batch in batches:
            x = on_grid(batch.column(0), width, scale, shift)
            fits = int(np.max(np.abs(x), initial=0)) * len(x) < 2**63
            total += (x if fits else x.astype(object)).sum(axis=0).astype(object)
        return {(i, 0): v for i, v in enumerate(total)}

    total = _summed(vectors, sums) if n else {}
    at = [total.get((i, 0), 0) for i in range(width)]
    centre = np.array([round(s / n) for s in at] if n else [0] * width, np.int64)

    def scatter(batches):
        held = np.zeros((width, width), object)
        for batch in batches:
            held += _scatter(on_grid(batch.column(0), width, scale, shift) - centre)
        return {(i, j): held[i, j] for i in range(width) for j in range(i, width)}

    cross = _summed(vectors, scatter) if n else {}
    rest = [s - n * int(c) for s, c in zip(at, centre, strict=True)]
    covariance = np.zeros((width, width))
    for (i, j), v in cross.items():
        covariance[i, j] = covariance[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    factor, order = pivoted_cholesky(covariance)
    values, directions = one_sided_jacobi(factor)
    components = np.zeros((len(values), width))
    components[:, order] = directions.T
    for row in components:  # either sign is right; take the one with a positive largest entry
        row *= np.sign(row[np.argmax(np.abs(row))])
    return Whitening(n, tuple(at), values, components, float(np.trace(covariance)))


def apply_whitening(vectors: DataFrame, model: Whitening, components: int = COMPONENTS,
                    scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Replace ``vector`` by ``deviation`` (exact squared distance from the mean, times n squared) and ``whitened``."""
    n, width = model.n, len(model.sums)
    used = model.components[:components]
    roots = np.sqrt(model.eigenvalues[:components])
    sums = np.array(model.sums, object)
    centre = np.array([round(s / n) for s in model.sums] if n else [0] * width, np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(model.sums, centre, strict=True)] if n else [0.0] * width)
    kept = vectors.schema.fields[:-1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = on_grid(batch.column(batch.num_columns - 1), width, scale, shift)
            far = int(np.max(np.abs(x), initial=0)) * n + max(map(abs, model.sums), default=0)
            if width * far * far < 2**63:
                deviation = np.sum((n * x - sums.astype(np.int64)) ** 2, axis=1)
            else:
                deviation = np.sum((n * x.astype(object) - sums) ** 2, axis=1)
            scores = ((x - centre) - rest) @ used.T / roots
            starts = np.arange(len(x) + 1, dtype=np.int32) * len(used)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1],
                pa.array([Decimal(int(v)) for v in deviation], _WHOLE),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(scores.ravel())),
            ], [*(f.name for f in kept), "deviation", "whitened"])

    schema = T.StructType([
        *kept, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    return vectors.mapInArrow(project, schema)


def identity_error(rows: DataFrame, components: int) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity; one pass, centred as it goes."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = F.col("whitened")
    found = rows.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else []
    return max((abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True) if c is not None), default=0.0)


def whiten(df: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
           id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening, float]:
    """Whitened vectors (id, deviation, whitened), the fitted model, and the error of the identity.

    Entries become ``floor(scale * c) + shift``.  Rows whose vector is null, empty, of another
    width than most or holds null or non-finite entries are left out; entries too large for 64-bit integers raise an
    error.  Repeated rows and null ids count like any other.  With less than ``components`` directions of spread there are as many
    as there are; an empty table, or one without spread, has none.  Equal eigenvalues
    have any orthonormal components of their space.  Other columns are not read.
    """
    vectors, width, n = usable_vectors(df, vector_col, [id_col])
    model = learn_whitening(vectors, width, n, scale, shift)
    rows = written(apply_whitening(vectors, model, components, scale, shift), "whitened")
    return rows, model, identity_error(rows, min(components, len(model.eigenvalues)))


def whitened_components(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is a 64-bit integer; a sum beyond it raises an error (``whiten`` gives 38 digits).
    """
    rows, model, error = whiten(df, components)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:components]]).cast("array<double>")
    return rows.select(
        "vec_id", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
