"""Embedding whitening: principal components by a randomised range finder, and vectors projected on them at unit variance.

The covariance of the distinct vectors is never formed at first: it is applied to a thin random matrix. Every pass over
the centred rows multiplies it with ``COMPONENTS + OVERSAMPLE`` columns, which are then made orthonormal, so that they
come to span the leading eigenvectors (``PASSES`` power passes). Rayleigh-Ritz solves the small problem within that span.
A pair of value and vector is good if its residual, which the last pass gives too, is within ``RESIDUAL`` of the largest
value; where one is not (a flat spectrum), the span is extended to the full dimension, which one more pass makes exact.

Sums of the vectors are exact integers, and centring is exact before it is rounded: (n * x - sum) / n. Of a task only
sums leave: one row of numbers for each dimension.

Scale: the distinct vectors are one aggregation, stored; each pass reads them once and shuffles a matrix of dimension
times columns per task; the driver holds matrices of that size (of dimension squared, if the span is extended).

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; shorter vectors count as
padded with zeros (before scaling) to the longest one; repeated vectors are fitted once and repeated rows answered each
by itself; components without variance have no unit variance and are left out, so a table of equal vectors, like an empty
one, gives an empty result; equal eigenvalues share their components in either order; a deviation beyond 64 bits is null; sums
beyond 64 bits raise ``ValueError``; ids may be null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.codes import matrix, whole_vectors
from stowage.llm.common import mapped, stored

COMPONENTS = 16
OVERSAMPLE = 8
PASSES = 3
#: Of a good pair: length of (V u - e u) in parts of the largest eigenvalue.
RESIDUAL = 1e-13
#: Eigenvalues below this part of the largest are rounding errors of zero.
NOTHING = 1e-12
SCALE = 64
SHIFT = 1_000_000
#: Rows that are multiplied at once.
CHUNK = 4096
SEED = 13


@dataclass
class Fit:
    n: int
    sums: np.ndarray  # int64
    components: np.ndarray  # dimension x components, orthonormal columns
    values: np.ndarray  # falling eigenvalues
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for top in range(0, batch.num_rows, CHUNK):
        yield matrix(batch.column(column).slice(top, CHUNK))


def added(rows: DataFrame, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all vectors' chunks of a matrix made from each, added up in the task, then row by row and column."""

    def run(source: Iterator[pa.RecordBatch]):
        total = None
        for batch in source:
            for x in pieces(batch, 0):
                total = product(x) if total is None else total + product(x)
        if total is not None:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], names=["i", "values"])

    kind = "bigint" if np.issubdtype(product(np.zeros((1, len(rows.first()["x"])), np.int64)).dtype, np.integer) else "double"
    summed = mapped(rows.select("x"), run, f"i int, values array<{kind}>").select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not summed:
        return None
    out = np.zeros((max(r["i"] for r in summed) + 1, max(r["j"] for r in summed) + 1), np.int64 if kind == "bigint" else np.float64)
    for r in summed:
        out[r["i"], r["j"]] = r["v"]
    return out


def rayleigh_ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) within the span of an orthonormal basis, whose image under V is given; largest first."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def fitted(distinct: DataFrame, size: int, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, residual: float = RESIDUAL) -> tuple[Fit, bool]:
    """(the fit, whether the span was extended). distinct: x, each vector once, of ``size`` components."""
    n = distinct.count()
    sums = added(distinct, lambda x: x.sum(0)[None, :])[0]
    centre = Fit(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0).centred

    def image(basis: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.column_stack([c.T @ (c @ basis), (c * c).sum(0)])

        return added(distinct, product) / n

    wide = min(size, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, wide)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(image(basis)[:, :-1])[0]
    pairs = image(basis)
    trace = float(pairs[:, -1].sum())
    values, vectors, off = rayleigh_ritz(basis, pairs[:, :-1])
    wanted = min(components, size)
    extended = wide < size and bool((off[:wanted] > residual * max(values[0], 0)).any())
    if extended:
        whole = np.eye(size)
        values, vectors, _ = rayleigh_ritz(whole, image(whole)[:, :-1])
    good = int((values[:wanted] > NOTHING * max(values[0], 0)).sum())
    return Fit(n, sums, vectors[:, :good], values[:good], trace), extended


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""

    def product(x: np.ndarray) -> np.ndarray:
        w = fit.whitened(x)
        return np.column_stack([w.T @ w, w.sum(0)])

    total = added(distinct, product) / fit.n
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - sums) ** 2 of each row, exact; None beyond 64 bits."""
    off = x * n - sums
    if float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(1).tolist()
    every = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in every]


def prepared(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id and x of all rows with whole vectors; x, each once; dimension)."""
    kept = whole_vectors(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v", SCALE, SHIFT).select("vec_id", "x")
    size = kept.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    base = stored(kept.select("vec_id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(size) - F.size("x"))).alias("x")))
    return base, stored(base.select("x").distinct()), size


def bounded(distinct: DataFrame) -> None:
    most = distinct.agg(F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double"))), F.count("*")).first()
    if 2 * (most[0] or 0) * most[1] >= 2.0**63:
        raise ValueError("components are too large for exact sums in 64 bits")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    base, distinct, size = prepared(rows, id_col, vector_col)
    nothing = rows.sparkSession.createDataFrame([], schema)
    if not size:
        return nothing
    bounded(distinct)
    fit, _ = fitted(distinct, size, components)
    if not len(fit.values):
        return nothing
    error, explained, k = identity_error(distinct, fit), fit.values / fit.trace, len(fit.values)

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            top = 0
            for x in pieces(batch, 1):
                m = len(x)
                ids = batch.column(0).slice(top, m).take(pa.array(np.repeat(np.arange(m), k)))
                numbers = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), None, fit.whitened(x).ravel(), np.tile(explained, m), np.full(m * k, error)]
                far = pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([ids, *(far if v is None else pa.array(v) for v in numbers)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                top += m

    return mapped(base, run, schema)


def vector_deviations(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation: the exact columns of ``whiten``, which SQL can express."""
    kind = rows.schema[id_col].dataType.simpleString()
    base, distinct, size = prepared(rows, id_col, vector_col)
    if not size:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, n long, deviation long")
    bounded(distinct)
    n, sums = distinct.count(), added(distinct, lambda x: x.sum(0)[None, :])[0]

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            far = [v for x in pieces(batch, 1) for v in deviations(x, n, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, n)), pa.array(far, pa.int64())], names=["vec_id", "n", "deviation"])

    return mapped(base, run, f"vec_id {kind}, n long, deviation long")
