"""Whitening of embeddings by shifted Cholesky QR.

Vectors are put on an integer grid, where sums are exact, and each distinct grid vector is fitted once. With A the centred fit rows, a pass over
Spark's partitions sums the Gram matrix of A's rows after the triangular solves so far; its Cholesky factor is the next solve. The first
factor has a shift that keeps the matrix positive definite whatever A's condition; two further passes make the columns orthonormal to
rounding, so A = Q R3 R2 R1. The singular values and right singular vectors of the small product R are those of A, and errors stay at the
level of A's condition number, where the covariance matrix itself would square it.

The driver holds matrices of dimension x dimension; rows stay on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage_table
from .vectors import finite_rows, width

#: Rows that a task works on at once.
ROWS = 4096
#: Directions whose spread is below this share of the greatest spread count as none: they are made of rounding.
FLAT = 1e-11


@dataclass
class Whitening:
    """What a fit found: rows, exact sums, grid, components (columns), their standard deviations and shares of the whole variance."""

    n: int
    sums: np.ndarray
    scale: int
    offset: int
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def on_grid(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean: the difference is an integer before its one division."""
    return (n * x - sums) / n


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular ``r``, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular factor of gram + shift; the shift grows as long as rounding leaves the sum indefinite."""
    least = len(gram) * np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, size: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows ``x`` of ``of``(matrix) with ``size`` numbers: one partial sum a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in slices(batches, ROWS):
            x = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i8").reshape(-1, d)
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["part"])

    parts = rows.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "one")).groupBy("at").agg(F.sum("one").alias("one"))
    out = np.zeros(size, np.int64 if kind == "long" else float)
    for r in parts.collect():  # ``size`` rows
        out[r["at"]] = r["one"]
    return out


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 0, passes: int = 3) -> Whitening | None:
    """Fit on each distinct grid vector floor(scale * c) + offset once; None without vectors.

    Null vectors, those with a null or non-finite entry and those shorter than the longest take no part. Directions without spread are no
    components, so there are fewer where vectors are few, equal or linearly dependent. |scale * c| has to stay below 2^53.
    """
    d = width(df, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            x = on_grid(finite_rows(part.column(0), d)[1], scale, offset).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    rows = stage_table(df.select(vec_col).mapInArrow(run, "x binary").distinct(), "whitening-fit")
    n = rows.count()
    if not n or not d:
        return None
    sums = _sums(rows, lambda x: x.sum(axis=0), d, d, "long")
    factors: list[np.ndarray] = []
    for i in range(passes):

        def gram(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            for r in factors:
                y = solve_rows(y, r)
            return y.T @ y

        g = _sums(rows, gram, d, d * d).reshape(d, d)
        shift = 0.0 if i else 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.eigvalsh(g)[-1])
        if not np.trace(g):
            break
        factors.append(shifted_cholesky(g, shift))
    r = np.eye(d) if factors else np.zeros((d, d))
    for factor in factors:
        r = factor @ r
    _, spread, directions = np.linalg.svd(r)
    k = min(components, int((spread > FLAT * spread[0]).sum()))
    chosen = directions[:k].T
    chosen = chosen * np.where(np.take_along_axis(chosen, np.abs(chosen).argmax(axis=0)[None], 0) < 0, -1, 1)  # the greatest entry is positive
    deviations = spread[:k] / np.sqrt(n)
    explained = spread[:k] ** 2 / max((spread**2).sum(), np.finfo(float).tiny)

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), centred(x, n, sums) @ chosen / deviations])
        return z.T @ z

    m = _sums(rows, moments, d, (k + 1) ** 2).reshape(k + 1, k + 1) / n if k else np.ones((1, 1))
    error = np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0.0)
    return Whitening(n, sums, scale, offset, chosen, deviations, explained, float(error))


def transform(df: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, whitened: a number for each component, deviation: the sum over dimensions of (n x - sums)^2) of each row with a whole vector.

    Rows that repeat or have a null id stay each for itself. A deviation beyond a long is null. Other columns are not read.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, whitened array<double>, deviation long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(fitted.sums) if fitted else 0
        for part in slices(batches, ROWS):
            whole, vectors = finite_rows(part.column(1), d)
            if not fitted or not len(vectors):
                continue
            x = on_grid(vectors, fitted.scale, fitted.offset)
            z = centred(x, fitted.n, fitted.sums) @ fitted.components / fitted.deviations
            off = fitted.n * x - fitted.sums
            if int(np.abs(off).max()) ** 2 * d < 1 << 63:
                deviation = (off * off).sum(axis=1).tolist()
            else:
                exact = [sum(v * v for v in row) for row in off.tolist()]
                deviation = [v if v < 1 << 63 else None for v in exact]
            offsets = np.arange(0, z.size + 1, z.shape[1] or 1, dtype=np.int32) if z.size else np.zeros(len(z) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(whole)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel())), pa.array(deviation, pa.int64())], names=["id", "whitened", "deviation"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
