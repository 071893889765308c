"""Embedding whitening by mixed-precision refinement of the covariance's eigenvectors.

Entries become whole numbers, so that the covariance is an exact sum: each batch is shifted by whole numbers near the
mean, cut into limbs whose products a float64 matrix product adds without rounding, and the batches' sums are added as
integers. Dividing once at the end gives a covariance that is right to the last bit, whatever the number of rows, their
order or the partitions.

The eigenvectors start as float32 ones and are corrected by Ogita-Aishima steps: matrix products in long double that
square the error each time. Where eigenvalues lie closer than a step can tell apart, the vectors of such a cluster are
turned by a sub-solve: the covariance, shifted and projected on the cluster, is a small problem of its own scale, in
which the same method tells them apart.

Memory holds d * d numbers for d dimensions, in a task and on the driver, and never a share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.store import written

SCALE, OFFSET = 1024, 100_000
#: A limb has so many bits and a product so many rows that the sums of products stay below 2^53.
LIMB_BITS, PRODUCT_ROWS = 20, 4096
#: Products added in one int64 matrix before it is handed on.
FLUSH = 512
#: An eigenvalue below this part of the largest (times d) is none: rounding alone gives as much.
NOTHING = 2.0**-52
_HIGH = np.longdouble


# --- eigenvectors -------------------------------------------------------------------------------------------------


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, _HIGH, _HIGH]:
    """One Ogita-Aishima correction: new vectors, eigenvalues, the gap that could be told apart, and the correction's size."""
    rest = np.eye(len(a), dtype=_HIGH) - x.T @ x
    seen = x.T @ a @ x
    values = np.diag(seen) / (1 - np.diag(rest))
    off = seen - np.diag(values)
    gap = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((rest**2).sum()))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    e = np.where(near, rest / 2, (seen + values[None, :] * rest) / np.where(near, 1, apart))
    return x + x @ e, values, gap, np.abs(e).max()


def _straight(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal in long double (two Newton steps of the polar factor; they are nearly so already)."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=_HIGH) - x.T @ x) / 2
    return x


def eigenvectors(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in long double.

    Vectors of equal eigenvalues are some orthonormal basis of their space. A zero matrix has the unit vectors.
    """
    a = (np.asarray(a, _HIGH) + np.asarray(a, _HIGH).T) / 2
    size = np.abs(a).max() if a.size else _HIGH(0)
    if not size:
        return np.zeros(len(a), _HIGH), np.eye(len(a), dtype=_HIGH)
    a = a / size  # float32 has a narrow range
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_HIGH)[:, ::-1]
    values = np.diag(x.T @ a @ x)
    for _ in range(3):
        x, values, gap, _ = _step(a, x)
    # vectors whose eigenvalues lie too close for the steps: a small problem for each run of them
    order = np.argsort(-values, kind="stable")
    x, values = _straight(x[:, order]), values[order]
    borders = [0, *(np.flatnonzero(values[:-1] - values[1:] > gap) + 1).tolist(), len(a)]
    for begin, end in zip(borders, borders[1:], strict=False):
        if 1 < end - begin < len(a) or (1 < end - begin and depth < 1):
            part, middle = x[:, begin:end], values[begin:end].mean()
            inner = part.T @ (a @ part) - middle * (part.T @ part)
            if np.abs(inner).max() > 64 * np.finfo(_HIGH).eps:  # smaller ones are rounding: equal eigenvalues
                x[:, begin:end] = part @ eigenvectors(inner, depth + 1)[1]
    last = _HIGH(np.inf)
    for _ in range(12):
        better, values, _, change = _step(a, x)
        if change >= last:  # as far as rounding goes
            break
        x, last = better, change
    x = _straight(x)
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


# --- exact sums ---------------------------------------------------------------------------------------------------


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers: floor(1024 * c) + 100000; exact, as the scale is a power of two."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(len(column), -1)).astype(np.int64) + OFFSET


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as the sum of limb k times 2^(20 k), each a float64 matrix of whole numbers; the highest has the sign."""
    out = []
    while True:
        if not len(y) or np.abs(y).max() < 1 << LIMB_BITS:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        y = y >> LIMB_BITS


_HALVES = "row int, shift int, high array<bigint>, low array<bigint>"
_HALF_SCHEMA = pa.schema([("row", pa.int32()), ("shift", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def _halves(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row for each matrix row and shift: int64 numbers as high * 2^32 + low, so that 2^31 of them can be added."""
    rows = [(i, shift, line >> 32, line & 0xFFFFFFFF) for shift, matrix in sums.items() for i, line in enumerate(matrix)]
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HALF_SCHEMA, strict=True)], schema=_HALF_SCHEMA)


def _added(parts: DataFrame, width: int, height: int) -> list[list[int]]:
    """The sum of all parts, as ``height`` rows of ``width`` integers of any size; one row of the matrix is one group."""

    def add(group: pa.Table) -> pa.Table:
        high, low = (np.stack(group[c].to_numpy()).sum(axis=0) for c in ("high", "low"))
        return pa.table([group["row"][:1], group["shift"][:1], pa.array([high]), pa.array([low])], schema=_HALF_SCHEMA)

    total = [[0] * width for _ in range(height)]
    for r in parts.groupBy("row", "shift").applyInArrow(add, _HALVES).collect():  # d rows of d numbers for each shift
        line = total[r["row"]]
        for j, (high, low) in enumerate(zip(r["high"], r["low"], strict=True)):
            line[j] += ((high << 32) + low) << r["shift"]
    return total


def _pieces(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, PRODUCT_ROWS):
            yield batch.slice(begin, PRODUCT_ROWS)


def column_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows, and each dimension's exact sum of whole numbers."""

    def add(batches):
        sums = {0: np.zeros((1, size + 1), np.int64), 32: np.zeros((1, size + 1), np.int64)}
        for piece in _pieces(batches):
            x = _whole(piece.column(0))
            sums[0][0] += np.append((x & 0xFFFFFFFF).sum(axis=0), len(x))
            sums[32][0, :size] += (x >> 32).sum(axis=0)
        yield _halves(sums)

    total = _added(rows.select("v").mapInArrow(add, _HALVES), size + 1, 1)[0]
    return total[-1], total[:-1]


def product_sums(rows: DataFrame, centre: list[int]) -> list[list[int]]:
    """The exact sum of (x - centre) (x - centre)^T over all rows."""
    centre, size = np.array(centre, np.int64), len(centre)

    def add(batches):
        sums, held = {}, 0
        for piece in _pieces(batches):
            limbs = _limbs(_whole(piece.column(0)) - centre)
            for i, one in enumerate(limbs):
                for j, two in enumerate(limbs):
                    shift = LIMB_BITS * (i + j)
                    sums[shift] = sums.get(shift, 0) + (one.T @ two).astype(np.int64)
            held += 1
            if held == FLUSH:
                yield _halves(sums)
                sums, held = {}, 0
        yield _halves(sums)

    return _added(rows.select("v").mapInArrow(add, _HALVES), size, size)


# --- the operator -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums, whole numbers near the means, and the components with a variance."""

    n: int
    sums: list[int]
    near: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def deviations(self, y: np.ndarray) -> pa.Array:
        """The sum of (n * x - sum)^2 of each row (y = x - near), exact; null beyond a long."""
        rest = [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if most**2 * max(len(rest), 1) < 1 << 63:
            return pa.array(((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def whitened(self, y: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.near, strict=True)])
        return (y - rest) @ (self.components / np.sqrt(self.values))


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The input row as ``input`` and its vector of doubles as ``v``, where the vector can be used (see ``whiten``)."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.struct("*").alias("input"), v.alias("v"))
    # beyond 2^62 a whole number of 64 bits does not exist
    rows = rows.where(f"size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {2.0**62 / SCALE!r}D)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def fit(rows: DataFrame, most: int) -> Whitening | None:
    """The whitening of all rows of column ``v`` (arrays of one length), or None if there are none."""
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return None
    n, sums = column_sums(rows, first["n"])
    near = [(2 * s + n) // (2 * n) for s in sums]
    products = product_sums(rows, near)
    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    # integers to the end: centring at whole numbers near the mean, and what is left of the mean taken off exactly
    exact = [[n * products[i][j] - rest[i] * rest[j] for j in range(len(rest))] for i in range(len(rest))]
    covariance = np.array([[v / (n * n) for v in line] for line in exact])
    values, vectors = eigenvectors(covariance)
    kept = (values[:most] > len(values) * NOTHING * values[0]).nonzero()[0]
    trace = sum(line[i] for i, line in enumerate(exact)) / (n * n)
    return Whitening(
        n, sums, near, values[kept].astype(np.float64), vectors[:, kept].astype(np.float64),
        (values[kept] / trace).astype(np.float64) if trace else np.zeros(0),
    )


def whiten(vectors: DataFrame, *, components: int = 8, vector_col: str = "embedding", also: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row per usable vector: ``also`` (columns of the input), n, deviation, ``whitened`` and ``explained`` (arrays by
    component), and identity_error, the largest absolute entry of the whitened columns' covariance minus the identity.

    Entries become floor(1024 * c) + 100000; the fit list is all usable vectors. Vectors that are null or empty, hold a
    null, a number that is not finite or one too large for a long (2^52 and more) take no part, nor do those of another
    length than most have (of equally many, the longer ones). Repeated rows and ids count each time; a null id is handed
    through. Components without variance (one row, equal rows, fewer rows than dimensions) cannot be scaled and are
    left out: arrays may be shorter than ``components``, and empty. Equal eigenvalues share a space of which any
    orthonormal basis is given. A deviation beyond a long is null. An empty table gives an empty result.
    """
    rows = written(usable(vectors, vector_col).select(*[F.col("input").getField(c).alias(f"in_{i}") for i, c in enumerate(also)], "v"), "vectors")
    model = fit(rows, components)
    width = len(model.values) if model else 0
    near = np.array(model.near if model else [], np.int64)

    def project(batches):
        for piece in _pieces(batches):
            y = _whole(piece.column(len(also))) - near
            parts = model.whitened(y)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(also))), model.deviations(y), *(pa.array(parts[:, k]) for k in range(width))],
                names=[*(f"in_{i}" for i in range(len(also))), "deviation", *(f"w{k}" for k in range(width))],
            )

    own = [f"in_{i} {rows.schema[f'in_{i}'].dataType.simpleString()}" for i in range(len(also))]
    found = written(rows.mapInArrow(project, ", ".join([*own, "deviation bigint", *(f"w{k} double" for k in range(width))])), "whitened")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    error = 0.0
    if pairs:
        seen = found.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    numbers = lambda columns: F.array(*columns).cast("array<double>")
    return found.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(also)], F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        numbers([F.col(f"w{k}") for k in range(width)]).alias("whitened"),
        numbers([F.lit(float(e)) for e in (model.explained if model else [])]).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
