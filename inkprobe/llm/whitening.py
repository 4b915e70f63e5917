"""Whitening of embeddings by mixed-precision eigenvectors of a distributed covariance.

Pass 1 adds up exact integer sums per dimension, pass 2 the products of centred
rows, a block of rows at a time; both send one partial result a task through a
shuffle that ends in as many numbers as the covariance has. The driver solves
this one small matrix (dimensions squared, whatever the rows): eigenvectors in
float32, corrected by the iteration of Ogita and Aishima (Japan J. Indust. Appl.
Math. 35, 2018; clusters: 36, 2019), whose matrix products run in extended
precision. Eigenvalues too close for the iteration to part are rotated by the
eigenvectors of their own projected block, which is solved the same way. Pass 3
measures the covariance of the whitened rows; the last pass writes them.

Entries become whole numbers floor(1024 * c) + 100000, saturated at +-2**39.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries go; where lengths differ, only those of the commonest length stay (of
equally common ones the longest); rows equal in key or vector all count and all
come back, null keys too; a component whose eigenvalue is zero, up to rounding,
has a null ``whitened`` and doesn't count in the identity error, which is null
where none counts; a deviation beyond a long is null; an empty table gives no rows.
The input is read four times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.vectors import matrix, usable, whole_numbers

FACTOR, SHIFT, MOST = 1_024, 100_000, 1 << 39
COMPONENTS = 8
BLOCK_ROWS = 4_096
ROUNDS = 12
HIGH = np.longdouble
LONG_MAX = (1 << 63) - 1


# -------------------------------------------------------------- eigenvectors

def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m * m).sum()))


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima correction: better eigenvectors, eigenvalues of ``x``, and the gap they can't part."""
    r = np.eye(len(a), dtype=HIGH) - x.T @ x
    s = x.T @ (a @ x)
    # Exactly symmetric, or the rounding of s would spoil the right angles between close eigenvectors.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    least_gap = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= least_gap
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return x + x @ e, values, least_gap


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within ``gap``, groups of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(a: np.ndarray, noise: float = 0.0) -> np.ndarray:
    """Unit eigenvectors (columns, extended precision) of a symmetric matrix.

    ``noise`` is the rounding that the matrix itself carries: a block no larger
    than it belongs to one multiple eigenvalue, of which any basis will do.
    """
    a = a.astype(HIGH)
    size = float(np.abs(a).max(initial=0))
    n = len(a)
    if n < 2 or not np.isfinite(size) or size <= noise:
        return np.eye(n, dtype=HIGH)
    a = a / HIGH(size)
    own = max(noise / size, float(np.finfo(HIGH).eps) * n)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    goal = float(np.finfo(np.float64).eps) / 16
    for _ in range(ROUNDS):
        x, values, gap = correct(a, x)
        for group in clusters(values, gap):
            part = x[:, group]
            middle = values[group].mean()
            block = part.T @ (a @ part) - middle * (part.T @ part)
            if len(group) < n or np.abs(block).max() < 0.5:
                x[:, group] = part @ eigenvectors((block + block.T) / 2, own)
            else:  # the whole matrix in one group: float64 parts what float32 can't
                x = x @ np.linalg.eigh(((block + block.T) / 2).astype(np.float64))[1].astype(HIGH)
        r = np.abs(np.eye(n, dtype=HIGH) - x.T @ x).max()
        s = x.T @ (a @ x)
        off = np.abs(s - np.diag(np.diag(s))).max()
        if r <= goal and off <= max(goal, own):
            break
    return x / np.sqrt((x * x).sum(axis=0))


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue, in double precision."""
    x = eigenvectors(cov)
    values = ((x * (cov.astype(HIGH) @ x)).sum(axis=0)).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    lead = np.abs(x).argmax(axis=0) if len(x) else np.zeros(0, int)
    signs = np.where(x[lead, np.arange(x.shape[1])] < 0, -1, 1)
    return values[order], (x * signs).astype(np.float64)


# ------------------------------------------------------------- distributed sums

@dataclass(frozen=True)
class Whitening:
    """What the rows are whitened by; its size follows the dimensions and not the rows."""

    n: int
    sums: tuple[int, ...]      # exact, per dimension
    values: np.ndarray         # eigenvalues, falling
    vectors: np.ndarray        # unit columns
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def kept(self) -> np.ndarray:
        """Of the first components, those with an eigenvalue above rounding."""
        first = self.values[:COMPONENTS]
        return first > self.width * np.finfo(np.float64).eps * self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows minus the mean; the whole part is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The first components of each row; NaN where the eigenvalue is zero."""
        scale = np.where(self.kept, np.sqrt(np.where(self.kept, self.values[:COMPONENTS], 1)), np.nan)
        return self.centred(x) @ self.vectors[:, :COMPONENTS] / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - sums) ** 2 of each row; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        far = int(np.abs(x - whole).max(initial=0)) * self.n + self.n
        if far * far * self.width <= LONG_MAX:
            d = self.n * (x - whole) - np.array(rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * (x - whole).astype(object) - np.array(rest, object)
        return [t if t <= LONG_MAX else None for t in (d * d).sum(axis=1)]


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return whole_numbers(matrix(column, width), FACTOR, MOST) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums per dimension) of the commonest length."""
    def run(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            widths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(widths).tolist():
                part = batch.column(1).filter(pa.array(widths == w))
                n, total = held.get(w, (0, 0))
                held[w] = n + len(part), total + numbers(part, w).sum(axis=0)
            if sum(n for n, _ in held.values()) >= 1 << 20:  # far below what a long holds
                yield from _flush(held)
                held = {}
        yield from _flush(held)

    def _flush(held):
        for w, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array([n] * w, pa.int64()),
                 pa.array(total.tolist(), pa.int64())], names=["width", "dim", "n", "total"])

    parts = rows.mapInArrow(run, "width int, dim int, n bigint, total bigint")
    per = parts.groupBy("width", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    best = per.filter("dim = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not best:
        return 0, []
    found = per.filter(F.col("width") == best[0]["width"]).collect()  # one row a dimension
    return best[0]["n"], [int(r["total"]) for r in sorted(found, key=lambda r: r["dim"])]


def _products(rows: DataFrame, width: int, project) -> np.ndarray:
    """Sum over all rows of project(x)^T project(x), square; one partial sum a task."""
    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                y = project(numbers(batch.column(1).slice(at, BLOCK_ROWS), width))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r["j"] for r in found), default=-1) + 1
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    named = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    return named.filter(usable(F.col("vector")))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """Mean, covariance and its eigenvectors over all usable rows; None where there are none."""
    rows = _rows(vectors, key, vector)
    n, sums = _sums(rows)
    if not n:
        return None
    width = len(sums)
    plain = Whitening(n, tuple(sums), np.zeros(0), np.zeros((width, 0)), 0.0)
    fitted = rows.filter(F.size("vector") == width)
    cov = _products(fitted, width, plain.centred) / n
    values, x = principal(cov)
    return Whitening(n, tuple(sums), values, x, float(np.trace(cov)))


def identity_error(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, as measured."""
    if not model.kept.any():
        return None
    rows = _rows(vectors, key, vector).filter(F.size("vector") == model.width)

    def project(x):
        # A column of ones gives the sums beside the products.
        return np.column_stack([model.whiten(x)[:, model.kept], np.ones(len(x))])

    found = _products(rows, model.width, project) / model.n
    mean = found[-1, :-1]
    return float(np.abs(found[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row and component: ``key``, component, n, deviation, whitened, explained."""
    kind = vectors.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double"
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    k = min(COMPONENTS, model.width)
    shares = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [None] * k

    def run(batches):
        for batch in batches:
            x = numbers(batch.column(1), model.width)
            rows = len(x)
            w = model.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, model.n), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(w, pa.float64(), mask=np.isnan(w)),
                pa.array(shares * rows, pa.float64())],
                names=["key", "component", "n", "deviation", "whitened", "explained"])

    rows = _rows(vectors, key, vector).filter(F.size("vector") == model.width)
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
