"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Method: the entries become whole numbers (``floor(256 * c)``), each distinct vector counts once.
Tasks sum the whole vectors exactly and then the products of the centred ones. The covariance
is split by polar decompositions: the orthogonal factor U of ``V - shift * I`` (QDWH: a
dynamically weighted Halley iteration by QR factorisations) gives the projector ``(U + I) / 2``
on the components above the shift; bases of its range and of its complement are invariant
subspaces, and the covariance restricted to each is split again until every subspace holds one
component or is a multiple of the identity. The leading components and their scales are then
broadcast, and tasks project the rows.

What reaches the driver is the covariance: width x width numbers, whatever the number of rows.
Distinct vectors meet by Spark's aggregate, which combines equal ones before the shuffle.

Defined cases: rows with a null vector, or with a null or non-finite entry in it, are dropped;
shorter vectors (empty ones too) count as padded with zeros to the longest; a component without
variance (its eigenvalue is within rounding of 0) has null ``whitened`` and is left out of
``identity_error``; ``explained`` is null if nothing varies; repeated rows and null ids stay as
they are; entries beyond the whole numbers of 64 bits are cut to their range; a deviation beyond
them is null; an empty table gives an empty result; further columns are carried along, those named
like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .exchange import stored

STEPS = 256
EPS = np.finfo(float).eps
LONG = 2**63 - 1
ADDED = ("deviation", "whitened")


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH, from a lower bound of eps on its singular values."""
    n = len(a)
    x, low, eye = a / np.linalg.norm(a), EPS, np.eye(n)
    while low < 1 - 4 * EPS:
        sq = low * low
        d = math.cbrt(4 * (1 - sq) / (sq * sq))
        root = math.sqrt(1 + d)
        wa = root + math.sqrt(max(8 - 4 * d + 8 * (2 - sq) / (sq * root), 0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))[0]
        x = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        low = min(low * (wa + wb * sq) / (1 + wc * sq), 1.0)
    return x


def _shifts(a: np.ndarray, draw: np.random.Generator) -> Iterator[float]:
    """Numbers between the least and the greatest eigenvalue."""
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.mean(diagonal) * np.eye(len(a))) / math.sqrt(len(a))
    yield float(np.median(diagonal))
    yield float(np.mean(diagonal))
    for _ in range(12):
        yield float(np.mean(diagonal) + spread * draw.uniform(-0.7, 0.7))


def _split(a: np.ndarray, scale: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift."""
    m, best = len(a), None
    for shift in _shifts(a, draw):
        moved = a - shift * np.eye(m)
        if not np.any(moved):
            continue
        projector = (polar(moved) + np.eye(m)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < m:
            continue
        above = projector @ draw.standard_normal((m, k))
        for _ in range(2):
            above = projector @ np.linalg.qr(above)[0]
        whole = np.linalg.qr(np.hstack([above, draw.standard_normal((m, m - k))]))[0]
        above, below = whole[:, :k], whole[:, k:]
        off = np.linalg.norm(below.T @ a @ above)
        if best is None or off < best[0]:
            best = off, above, below
        if off <= 16 * EPS * m * scale:
            break
    return None if best is None else best[1:]


def components(v: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Each subspace is restricted from ``v`` itself, so that errors do not add up over the splits. Of a vector's two
    signs the one with a positive largest entry is taken.
    """
    width, draw, scale = len(v), np.random.default_rng(seed), float(np.linalg.norm(v))
    found, waiting = [], [np.eye(width)] if width else []
    while waiting:
        basis = waiting.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m = len(a)
        even = m == 1 or np.linalg.norm(a - np.trace(a) / m * np.eye(m)) <= 4 * EPS * scale
        halves = None if even else _split(a, scale, draw)
        if halves is None:
            found.append(basis)
        else:
            waiting += [np.linalg.qr(basis @ h)[0] for h in halves]
    if not found:
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.hstack(found)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors, their sums, the leading components as columns, their deviations (0: no variance) and shares of the trace."""

    column: str
    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    deviations: np.ndarray
    explained: tuple[float | None, ...]
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN where a component has no variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, (x - mean) @ self.basis / self.deviations, np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of ``(n * x - sum) ** 2``, in whole numbers."""
        if not x.size:
            return [0] * len(x)
        reach = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in self.sums)
        if reach * reach * x.shape[1] <= LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        moved = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(t) if t <= LONG else None for t in (moved * moved).sum(axis=1)]


def usable(column: str) -> Column:
    return F.expr(f"`{column}` IS NOT NULL AND NOT exists(`{column}`, c -> c IS NULL OR isnan(c) OR abs(double(c)) = double('infinity'))")


def whole(column: str, width: int) -> Column:
    """The entries as whole numbers, padded with zeros."""
    entries = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * STEPS))
    return F.concat(entries, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(column)))


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.names.index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def _summed(vectors: DataFrame, width: int, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of an array of fixed size; tasks add up their own batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(_matrix(batch, "x", width)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    cells = vectors.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("cell", "value"))
    got = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    return out


def _exact_sums(vectors: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", width)
                n += len(x)
                if x.size:
                    small = max(abs(int(x.max())), abs(int(x.min()))) * len(x) <= LONG
                    sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
        if n:
            yield pa.record_batch([pa.array([*range(-1, width)], pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["cell", "value"])

    cells = vectors.mapInArrow(run, "cell int, value string")
    got = {r["cell"]: int(r["value"]) for r in cells.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    return got.get(-1, 0), tuple(got.get(i, 0) for i in range(width))


def fit(vectors: DataFrame, column: str = "embedding", most: int = 4) -> Whitening:
    """Components of the distinct vectors of a table, ``most`` at most."""
    usable_rows = vectors.where(usable(column)).select(F.col(f"`{column}`").alias(column))
    width = usable_rows.agg(F.max(F.size(column))).first()[0] or 0
    distinct = stored(usable_rows.select(whole(column, width).alias("x")).distinct(), "whole-vectors")
    n, sums = _exact_sums(distinct, width)
    if not n or not width:
        return Whitening(column, n, sums, np.zeros((width, 0)), np.zeros(0), ())
    mean = np.array([s / n for s in sums])
    covariance = _summed(distinct, width, lambda x: (x - mean).T @ (x - mean)).reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    values, basis = components(covariance)
    values, basis, trace = values[:most], basis[:, :most], float(np.trace(covariance))
    deviations = np.sqrt(np.where(values > 4 * EPS * width * trace, values, 0))
    k = len(values)
    model = Whitening(column, n, sums, basis, deviations, tuple(float(e) / trace if trace else None for e in values))

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.nan_to_num(model.project(x))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums_w = _summed(distinct, width, moments)
    first, second = sums_w[:k] / n, sums_w[k:].reshape(k, k) / n
    defined = deviations > 0
    off = np.abs(second - np.outer(first, first) - np.eye(k))[np.ix_(defined, defined)]
    return Whitening(column, n, sums, basis, deviations, model.explained, float(off.max()) if off.size else None)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """The usable rows with ``deviation`` and ``whitened``, an array of one coordinate for each component.

    A vector longer than those of the fit is cut to their width by the covariance it has no part in; fit and rows are
    meant to come from the same table or from tables of one width.
    """
    width, column = len(model.sums), model.column
    rows = vectors.where(usable(column)).select(*[F.col(f"`{c}`") for c in vectors.columns if c not in ADDED])
    rows = rows.select(F.struct(*rows.columns).alias("_row"), F.slice(whole(column, width), 1, width).alias("_x") if width else F.array().cast("array<long>").alias("_x"))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "_x", width)
            whitened = shared.value.project(x) if shared.value.n else np.zeros((len(x), 0))
            values = pa.array(whitened.ravel(), pa.float64(), mask=np.isnan(whitened.ravel()))
            starts = pa.array(np.arange(len(x) + 1) * whitened.shape[1], pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.array(shared.value.deviation(x), pa.int64()), pa.ListArray.from_arrays(starts, values)], ["_row", *ADDED])

    schema = rows.select("_row", F.lit(None).cast("long").alias(ADDED[0]), F.lit(None).cast("array<double>").alias(ADDED[1])).schema
    return rows.mapInArrow(run, schema).select("_row.*", *ADDED)
