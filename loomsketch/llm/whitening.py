"""Whitened embeddings by spectral divide and conquer.

The vectors' sums come first, then their covariance, centred before it is multiplied: partitions send one array each, and a
tree of tasks adds them up. Eigenvectors of the covariance, a matrix of the dimension's size, come from polar decompositions: the
unitary factor U of the matrix less a shift gives the projectors (U + 1) / 2 and (1 - U) / 2 on the spaces of larger and of smaller
eigenvalues; both are split on, each in a basis of its own, until a block is a multiple of the identity. The factor is found by
dynamically weighted Halley steps over QR decompositions (QDWH), six or so whatever the matrix's condition. The components, a
matrix that a task can hold, then go to all rows by a broadcast.

Left out are vectors that are null or hold null or non-finite entries. Vectors of each length are whitened by themselves. A null vec_id and
repeated rows are rows like others. Vectors without entries have no component, so no row. A component without spread (fewer rows than components, equal vectors) has whitened null and explained 0,
and doesn't count in identity_error, which is null where no component has any. A deviation that a long can't hold is null.
Entries of 2**40 and more are exact as doubles only up to their last bits. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import finite
from .partial import totals

#: x = floor(SCALE * c) + SHIFT of the query's contract; COMPONENTS are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Spread below this share of the largest eigenvalue, times the dimension, is none.
NONE = 4 * np.finfo(float).eps
#: Rows of vectors that are multiplied at a time.
PORTION = 8_192


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary factor of a symmetric matrix: each step maps singular values x to x (a + b x^2) / (1 + c x^2), with the weights that
    bring the least of them nearest to 1."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    low = np.finfo(float).eps  # a bound from below of singular values that count
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2) if low < 1 else 0.0
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(np.maximum(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        g = (h - 1) ** 2 / 4
        c = h + g - 1
        q = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))[0]
        new = g / c * x + (h - g / c) / np.sqrt(c) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (h + g * square) / (1 + c * square))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-15 * n or (low >= 1 - 1e-15 and moved < 1e-10):
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal columns: the first rank span the projector's range, the others its complement. Columns of the largest rest are taken
    first, then the space is turned once more to the projector."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        at = int(np.square(rest).sum(0).argmax())
        picked.append(at)
        v = rest[:, at] / np.linalg.norm(rest[:, at])
        rest = rest - np.outer(v, v @ rest)
    span = np.linalg.qr(projector @ np.linalg.qr(projector[:, picked])[0])[0]
    return np.linalg.qr(np.concatenate([span, np.eye(len(projector))], 1))[0] if rank < len(projector) else span


def divided(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, in no order; what is not above tiny counts as 0."""
    n = len(a)
    a = (a + a.T) / 2
    spread = np.linalg.norm(a - np.diag(np.full(n, np.trace(a) / n)))
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= tiny or spread <= tiny:
        return np.diag(a).copy(), np.eye(n)
    middle, wide = np.trace(a) / n, spread / np.sqrt(n)
    for shift in (0.0, 0.31, -0.37, 0.17, -0.23, 0.53, -0.59):  # the mean lies between the least and the largest; others if it meets one
        u = polar(a - (middle + shift * wide) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = _basis(projector, rank)
        turned = basis.T @ a @ basis
        if np.linalg.norm(turned[:rank, rank:]) <= 100 * tiny:
            break
    else:
        raise ArithmeticError("no shift splits the matrix")
    halves = [divided(turned[:rank, :rank], tiny), divided(turned[rank:, rank:], tiny)]
    vectors = np.concatenate([basis[:, :rank] @ halves[0][1], basis[:, rank:] @ halves[1][1]], 1)
    return np.concatenate([halves[0][0], halves[1][0]]), vectors


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix with no large negative eigenvalue. A last turn of
    first order takes off what rounding left between the components."""
    size = np.linalg.norm(a)
    values, vectors = divided(a, NONE * size) if size else (np.zeros(len(a)), np.eye(len(a)))
    rest = vectors.T @ a @ vectors
    gap = np.diag(rest)[None, :] - np.diag(rest)[:, None]
    small = np.abs(gap) <= 1e-7 * size
    turn = np.where(small, 0.0, rest / np.where(small, 1.0, gap))
    np.fill_diagonal(turn, 0.0)
    vectors = np.linalg.qr(vectors + vectors @ turn)[0]
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _portions(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column(at), width)
        for i in range(0, len(x), PORTION):
            yield x[i : i + PORTION]


def _moments(portions: Iterator[np.ndarray], width: int) -> np.ndarray:
    """[n, mean, products about the mean] of rows, as one array of doubles; portions are merged without taking squares of uncentred numbers."""
    total = np.zeros(1 + width + width * width)
    for rows in portions:
        mean = rows.mean(0) if len(rows) else np.zeros(width)
        off = rows - mean
        total = merged(width, total, np.concatenate([[len(rows)], mean, (off.T @ off).ravel()]))
    return total


def merged(width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1 : 1 + width] - a[1 : 1 + width]
    out = np.empty_like(a)
    out[0] = n
    out[1 : 1 + width] = a[1 : 1 + width] + apart * (b[0] / n)
    out[1 + width :] = a[1 + width :] + b[1 + width :] + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)
    return out


@dataclass
class Whitening:
    """What whitens vectors of one length: n rows' sums, and the components' axes (columns) with their eigenvalues, falling."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def spreads(self) -> np.ndarray:
        return self.values > NONE * len(self.values) * max(float(self.values.max(initial=0)), 0.0)

    def applied(self, x: np.ndarray, components: int) -> np.ndarray:
        """The first components of rows, each of mean 0 and variance 1; of those without spread, 0."""
        k = min(components, len(self.values))
        scale = np.divide(1.0, np.sqrt(np.maximum(self.values[:k], 0)), out=np.zeros(k), where=self.spreads()[:k])
        return (x - self.mean) @ (self.axes[:, :k] * scale)


Numbers = Callable[[np.ndarray], np.ndarray]


def contract_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE) + SHIFT


def fitted(vectors: DataFrame, width: int, numbers: Numbers = contract_numbers) -> Whitening | None:
    """The whitening of the whole numbers that numbers makes of vectors(v) of one length. Sums are exact; the driver gets sums and one
    matrix of width * width, and no rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, high, low = 0, [0] * width, [0] * width
        for x in _portions(batches, 0, width):
            whole = numbers(x)
            if not len(whole):
                continue
            n += len(whole)
            top = np.floor(whole / 2.0**26)  # both parts' sums of a portion are exact
            for i, (a, b) in enumerate(zip(top.sum(0), (whole - top * 2.0**26).sum(0), strict=True)):
                high[i] += int(a)
                low[i] += int(b)
        digits = [n, *(a * 2**26 + b for a, b in zip(high, low, strict=True))]
        return np.array([_limbs(d) for d in digits], np.int64)

    found = totals(vectors.select("v"), summed)
    n, *sums = [_joined(d) for d in found] if found is not None else [0]
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width, width))
        for x in _portions(batches, 0, width):
            off = numbers(x) - mean
            total += off.T @ off
        return total

    covariance = totals(vectors.select("v"), products) / n
    values, axes = spectrum(covariance)
    return Whitening(n, sums, axes, values, float(np.trace(covariance)))


def _limbs(value: int) -> list[int]:
    """Digits of a whole number in base 2**40, of which very many can be added up; the last has the sign."""
    out = []
    for _ in range(30):
        out.append(value & ((1 << 40) - 1))
        value >>= 40
    return [*out, value]


def _joined(digits: np.ndarray) -> int:
    return sum(int(d) << (40 * i) for i, d in enumerate(digits))


def identity_error(vectors: DataFrame, width: int, w: Whitening, components: int, numbers: Numbers = contract_numbers) -> float | None:
    """How far the covariance of the whitened rows is from the identity at most, over components with spread."""
    use = np.flatnonzero(w.spreads()[:components])
    k = len(use)
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return _moments((w.applied(numbers(x), components)[:, use] for x in _portions(batches, 0, width)), k)

    def merge(some: list[np.ndarray]) -> np.ndarray:
        out = some[0]
        for more in some[1:]:
            out = merged(k, out, more)
        return out

    total = totals(vectors.select("v"), moments, merge)
    return float(np.abs(total[1 + k :].reshape(k, k) / total[0] - np.eye(k)).max())


def whitened(table: DataFrame, components: int = COMPONENTS, numbers: Numbers = contract_numbers) -> list[tuple[DataFrame, Whitening, float | None]]:
    """For each length of vectors in table(vec_id, embedding): (vec_id, deviation, whitened array<double>) of its rows, what whitened them, and
    the identity error. Null stands for what a component without spread would be."""
    given = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    valid = given.where(finite(F.col("v")) & (F.size("v") > 0))
    widths = sorted(r[0] for r in valid.select(F.size("v")).distinct().collect())  # lengths of vectors: a few
    found = []
    for width in widths:
        rows = valid.where(F.size("v") == width)
        w = fitted(rows, width, numbers)
        error = identity_error(rows, width, w, components, numbers)

        def run(batches: Iterator[pa.RecordBatch], width=width, w=w) -> Iterator[pa.RecordBatch]:
            none = np.flatnonzero(~w.spreads()[:components])
            for batch in batches:
                x = numbers(_matrix(batch.column(1), width))
                made = w.applied(x, components)
                absent = np.zeros(made.shape, bool)
                absent[:, none] = True
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel(), mask=absent.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(x, w), lists], names=["vec_id", "deviation", "whitened"])

        made = rows.select("vec_id", "v").mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")
        found.append((made, w, error))
    return found


def _deviations(x: np.ndarray, w: Whitening) -> pa.Array:
    """Sums of (n x - S)^2, exact: in longs if they are sure to do, else in Python's integers."""
    if not len(x):
        return pa.array([], pa.int64())
    n = w.n
    top = max((abs(n * int(v) - s) for row in (x.min(0), x.max(0)) for v, s in zip(row, w.sums, strict=True)), default=0)
    if top * top * max(1, x.shape[1]) < 1 << 63 and max(map(abs, w.sums), default=0) < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return pa.array(np.square(n * x.astype(np.int64) - np.array(w.sums, np.int64)).sum(1))
    sums = [sum((n * int(v) - s) ** 2 for v, s in zip(row, w.sums, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in sums], pa.int64())


def components_of(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector of table(vec_id, embedding) and component."""
    out = None
    for rows, w, error in whitened(table, components):
        explained = F.array(*(F.lit(float(v / w.trace) if s else 0.0) for v, s in zip(w.values[:components], w.spreads()[:components], strict=True)))
        some = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(w.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, "place").alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
        out = some if out is None else out.unionAll(some)
    if out is None:
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return table.limit(0).select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()))
    return out
