"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runwise.session import scratch_path

from .vectors import integer_vectors, matrix, pack, padded, summed

FACTOR, COMPONENTS = 256, 4
#: Values of a block of rows, and the size of a singular value, next to all of them, that counts as zero.
BLOCK_VALUES, ZERO = 262_144, 1e-12
SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """What the fit list gives: its size and sums, and one column, deviation and share for each component."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Integer rows less their mean; the difference is exact before it is divided."""
    return (x.astype(np.int64) * n - sums) / n


def bidiagonalise(products, size: int, norm: float, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal columns V, and the upper bidiagonal B with X V = U B.

    ``products(a, A)`` gives X'Xa, (XA)'Xa and |Xa|^2. A left vector u has an entry for every row of X and
    is never held: it is Xa for a short a, which is all that is kept of it, so a task makes its entries
    anew from its rows. Both sides are orthogonalised against all vectors before them. Where the
    space closes early, as it does with equal singular values, a new direction opens the next block.
    """
    draw = np.random.default_rng(seed)
    steps = min(size, steps or size)
    V, A, Z, B = np.zeros((size, steps)), np.zeros((size, steps)), np.zeros((size, steps)), np.zeros((steps, steps))

    def direction(k: int, r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - V[:, :k] @ (V[:, :k].T @ r)
        return r

    v, beta = draw.standard_normal(size), 0.0
    v /= np.linalg.norm(v)
    for k in range(steps):
        V[:, k] = v
        a = v - (beta * A[:, k - 1] if k else 0.0)
        z, shared, square = products(a, A[:, :k])
        a, z = a - A[:, :k] @ shared, z - Z[:, :k] @ shared
        alpha = float(np.sqrt(max(square - shared @ shared, 0.0)))
        if alpha > ZERO * norm:
            A[:, k], Z[:, k], B[k, k] = a / alpha, z / alpha, alpha
            rest = direction(k + 1, Z[:, k] - alpha * v)
        else:
            rest = np.zeros(size)
        beta = float(np.linalg.norm(rest))
        if k + 1 < steps:
            if beta <= ZERO * norm:
                beta, rest = 0.0, direction(k + 1, draw.standard_normal(size))
            B[k, k + 1] = beta
            v = rest / np.linalg.norm(rest)
    return V, B


def _partials(blocks: DataFrame, size: int, add, width: int, kind: str) -> np.ndarray:
    """Sum over all blocks of the array that ``add`` makes of a block's integers."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in batches:
            for n, dtype, data in zip(*(batch.column(c).to_pylist() for c in ("n", "kind", "data"))):
                total += add(matrix(data, dtype, n, size))
        yield pa.record_batch([pa.array([total])], names=["part"])

    spark_kind = {"int64": "bigint", "float64": "double"}[kind]
    return summed(blocks.select("n", "kind", "data").mapInArrow(each, f"part array<{spark_kind}>"), kind)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``, of ``size`` integers each; None where there is none.

    Each step is one pass over the distinct vectors, written once as blocks: a task multiplies its rows
    with the right vector, and its rows' transpose with the result. Only sums of ``2 * size + 1`` values
    at most reach the driver. ``steps`` bounds the passes; without it the space is completed, ``size`` passes,
    and the components are exact to rounding, whatever the gaps between them.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "fit_list")
    pack(rows.select("x").distinct(), max(1, BLOCK_VALUES // max(size, 1)), size).write.parquet(path)
    blocks = spark.read.parquet(path)
    n = blocks.agg(F.sum("n")).first()[0]
    if not n or not size:
        return None
    def totals(x):
        x = x.astype(np.int64)
        return np.append(x.sum(0), (x * x).sum())

    found = _partials(blocks, size, totals, size + 1, "int64")
    sums = found[:size]
    # n times the trace of the covariance, exact until it is divided
    spread = (n * int(found[size]) - sum(int(s) ** 2 for s in sums)) / n
    if spread <= 0:
        return Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), np.zeros(0), 0.0)

    def products(a: np.ndarray, A: np.ndarray):
        k = A.shape[1]

        def add(x):
            c = centred(x, n, sums)
            w = c @ a
            return np.concatenate([c.T @ w, (c @ A).T @ w, [w @ w]])

        out = _partials(blocks, size, add, size + k + 1, "float64")
        return out[:size], out[size : size + k], out[-1]

    V, B = bidiagonalise(products, size, spread**0.5, steps)
    _, sigma, turned = np.linalg.svd(B)
    keep = sigma[:components] > ZERO * spread**0.5
    columns = (V @ turned.T)[:, : len(keep)][:, keep]
    columns *= np.sign(columns[np.abs(columns).argmax(0), np.arange(columns.shape[1])])
    sigma = sigma[: len(keep)][keep]
    deviations = sigma / n**0.5
    k = len(sigma)

    def squares(x):
        w = centred(x, n, sums) @ columns / deviations
        return np.append((w.T @ w).reshape(-1), w.sum(0))

    found = _partials(blocks, size, squares, k * k + k, "float64")
    mean = found[k * k :] / n
    error = np.abs(found[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0)
    return Whitening(n, sums, columns, deviations, sigma**2 / spread, float(error))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR,
           components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """Per row of ``df`` and component: ``SCHEMA``.

    Entries become the integers ``floor(factor * entry)``; every statistic is over the distinct
    vectors of these. ``deviation`` is the squared distance from the mean times n squared, exact; ``whitened`` the
    row's projection in standard deviations. Components have the sign that makes their largest entry positive.

    Rows whose vector is null or holds a null or non-finite entry are left out. Shorter vectors count as if zeros
    followed. Repeated vectors count once in the statistics, and each of their rows is returned; rows may
    share an id or have none. Components of no variance are left out, so a table of one distinct vector, and an empty
    one, give no rows. Components of equal variance are some basis of their space. Other columns play no part.
    """
    rows = integer_vectors(df, factor, vec_id, vector)
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = padded(rows, size)
    found = fit(rows, size, components, steps)
    if found is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    n, sums, columns, deviations, explained, error = found
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, square = len(deviations), sum(int(s) ** 2 for s in sums)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            w = centred(x, n, sums) @ columns / deviations
            # the square of n x - S, sum by sum, in numbers without a bound
            own, cross = (x * x).sum(1).tolist(), (x @ sums).tolist()
            far = pa.array([Decimal(n * n * p - 2 * n * q + square) for p, q in zip(own, cross)], pa.decimal128(38, 0))
            for j in range(k):
                m = batch.num_rows
                yield pa.record_batch([batch.column("vec_id"), pa.array(np.full(m, j + 1, np.int32)), pa.array(np.full(m, n)), far, pa.array(w[:, j].copy()),
                                       pa.array(np.full(m, explained[j])), pa.array(np.full(m, error))], names=names)

    return rows.mapInArrow(project, SCHEMA)
