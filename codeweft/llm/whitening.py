"""Whitening of embeddings from an exact integer scatter matrix (operator 13).

Entries become integers.  A shift is subtracted, tasks accumulate sums and cross-products without rounding, and the
driver forms ``n * X'X - S S'`` in Python integers, which no shift changes.  Only then are numbers made floating, by
one division each, and decomposed by ``eigh``.

Numbers of any size are held as limbs of ``LIMB`` bits.  Products of limbs, summed over at most ``ROWS`` rows,
are below 2**53, so that a matrix product of doubles is exact; carries go up after each, and Spark adds the limbs of
all tasks as longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import kernels
from codeweft.llm.frames import cut

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
LIMB, ROWS = 20, 4096
#: Scaled entries beyond this are set to it, so that the offset can be added in a long.
LARGEST = 1 << 62


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: entries as ``floor(64 * c) + 1000000``; vectors that are null or hold nulls, NaN or infinities are
    left out."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + F.lit(OFFSET))
    return rows.where(v.isNotNull() & ~bad).select("vec_id", whole.alias("x"))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list column of longs, lists of one size at a time; empty lists are left out."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


class Scatter:
    """Exact ``A'A`` of rows of integers, as limbs: ``limbs[k]`` counts ``2 ** (LIMB * k)``."""

    def __init__(self, size: int):
        self.limbs = np.zeros((2, size, size), np.int64)

    def add(self, rows: np.ndarray) -> None:
        for low in range(0, len(rows), ROWS):
            some = rows[low : low + ROWS]
            most = max(abs(int(some.min())), abs(int(some.max())))
            n = max(1, -(-most.bit_length() // LIMB))
            sign, size = np.sign(some), np.abs(some)
            parts = [(sign * (size >> (LIMB * k) & ((1 << LIMB) - 1))).astype(np.float64) for k in range(n)]
            for a in range(n):
                for b in range(n):
                    self._grow(a + b + 2)
                    self.limbs[a + b] += (parts[a].T @ parts[b]).astype(np.int64)
            self._carry()

    def _grow(self, n: int) -> None:
        if n > len(self.limbs):
            self.limbs = np.concatenate([self.limbs, np.zeros((n - len(self.limbs), *self.limbs.shape[1:]), np.int64)])

    def _carry(self) -> None:
        if (np.abs(self.limbs[-1]) >> LIMB).any():
            self._grow(len(self.limbs) + 1)
        for k in range(len(self.limbs) - 1):
            self.limbs[k + 1] += self.limbs[k] >> LIMB
            self.limbs[k] &= (1 << LIMB) - 1


def _whole(limbs: dict[tuple[int, int], dict[int, int]], i: int, j: int) -> int:
    return sum(value << (LIMB * k) for k, value in limbs.get((min(i, j), max(i, j)), {}).items())


class Fit:
    """What is known of the fit list of vectors of one size: its exact moments and its components.

    ``sums`` are those of the shifted entries.  ``axes`` holds a component's direction over the square root of its
    eigenvalue in each column, and zeros for a component without variance.
    """

    def __init__(self, n: int, sums: list[int], cross: list[list[int]], components: int):
        size = len(sums)
        self.n, self.sums = n, sums
        self.scatter = [[n * cross[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
        covariance = np.array([[value / (n * n) for value in row] for row in self.scatter])
        values, directions = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(components, size)]
        values, directions = values[order], directions[:, order]
        total = sum(self.scatter[i][i] for i in range(size)) / (n * n)
        self.varies = values > size * np.finfo(float).eps * max(float(np.abs(covariance).max()), 0.0)
        values = np.where(self.varies, values, 0.0)
        self.explained = values / total if total else values
        self.axes = np.divide(directions, np.sqrt(values), out=np.zeros_like(directions), where=self.varies)

    def centred(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S`` of shifted rows, exactly, and its quotient by ``n`` in doubles."""
        bound = self.n * max(abs(int(rows.min())), abs(int(rows.max()))) + max(map(abs, self.sums))
        if bound < 1 << 62:
            apart = rows * np.int64(self.n) - np.array(self.sums, np.int64)
            return apart, apart / self.n
        apart = rows.astype(object) * self.n - np.array(self.sums, object)
        return apart, (apart / self.n).astype(np.float64)

    def whitened(self, rows: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Each row's deviation (null if no long holds it) and its components."""
        apart, plain = self.centred(rows)
        bound = max(abs(int(apart.min())), abs(int(apart.max())))
        squares = apart if apart.dtype == object or rows.shape[1] * bound * bound < 1 << 63 else apart.astype(object)
        deviation = [d if d < 1 << 63 else None for d in (squares * squares).sum(axis=1).tolist()]
        return deviation, np.einsum("ij,jk->ik", plain, self.axes)


def fits(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of the vectors in ``rows.x`` by their size; each row counts.

    The driver gets the square of a size numbers, however many rows there are.
    """

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            for _, some in by_size(batch.column("x")):
                size = some.shape[1]
                # The column of ones gives the sums and the number of rows.
                held.setdefault(size, Scatter(size + 1)).add(np.column_stack([some - OFFSET, np.ones(len(some), np.int64)]))
        for size, scatter in held.items():
            for k, limb in enumerate(scatter.limbs):
                i, j = np.triu_indices(size + 1)
                yield pa.record_batch([pa.array(np.full(len(i), size)), pa.array(i), pa.array(j), pa.array(np.full(len(i), k)), pa.array(limb[i, j])], names=["size", "i", "j", "limb", "value"])

    summed = rows.select("x").mapInArrow(run, "size long, i long, j long, limb long, value long").groupBy("size", "i", "j", "limb").agg(F.sum("value").alias("value"))
    limbs: dict[int, dict[tuple[int, int], dict[int, int]]] = {}
    for size, i, j, k, value in summed.where("value <> 0").collect():
        limbs.setdefault(size, {}).setdefault((i, j), {})[k] = value
    out = {}
    for size, own in limbs.items():
        sums = [_whole(own, i, size) for i in range(size)]
        cross = [[_whole(own, i, j) for j in range(size)] for i in range(size)]
        out[size] = Fit(_whole(own, size, size), sums, cross, components)
    return out


def identity_error(rows: DataFrame, fitted: dict[int, Fit]) -> float:
    """The largest absolute entry of the covariance of the whitened ``rows.x`` less the identity, over all sizes.

    Rows are centred by the mean of what was whitened before they are multiplied, which takes two passes.
    Components without variance are left out.
    """

    def summed(power: int, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        @kernels.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for _, some in by_size(batch.column("x")):
                    size = some.shape[1]
                    z = fitted[size].whitened(some - OFFSET)[1] - means.get(size, 0.0)
                    own = z.sum(axis=0)[None, :] if power == 1 else z.T @ z
                    held[size] = held.get(size, 0.0) + own
            for size, own in held.items():
                i, j = np.indices(own.shape).reshape(2, -1)
                yield pa.record_batch([pa.array(np.full(len(i), size)), pa.array(i), pa.array(j), pa.array(own[i, j])], names=["size", "i", "j", "value"])

        sums = rows.select("x").mapInArrow(run, "size long, i long, j long, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value"))
        out = {size: np.zeros((1 if power == 1 else fit.axes.shape[1], fit.axes.shape[1])) for size, fit in fitted.items()}
        for size, i, j, value in sums.collect():
            out[size][i, j] = value / fitted[size].n
        return out

    means = {size: mean[0] for size, mean in summed(1, {}).items()}
    worst = 0.0
    for size, covariance in summed(2, means).items():
        varies = fitted[size].varies
        apart = np.abs(covariance - np.eye(len(covariance)))[np.ix_(varies, varies)]
        worst = max(worst, float(apart.max(initial=0.0)))
    return worst


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component.

    The covariance is fitted on each distinct integer vector once, ``n`` of them; vectors of different sizes are fitted
    apart, and ``identity_error`` is the largest of all.  Left out are null vectors, vectors with null, NaN or infinite
    entries, and empty ones, which have no component.  Null ids and repeated rows are kept.  A component without
    variance has ``whitened`` null and explains 0.  ``deviation`` is exact, and null where no long holds it; entries
    beyond 2**62 when scaled count as that.  Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(quantised(vectors, vec_id, embedding))
    distinct = cut(rows.select("x").distinct())
    fitted = fits(distinct, components)
    error = identity_error(distinct, fitted)
    key = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    @kernels.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in by_size(batch.column("x")):
                fit = fitted[some.shape[1]]
                deviation, z = fit.whitened(some - OFFSET)
                k = z.shape[1]
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))
                flat = pa.array(z.ravel(), mask=np.tile(~fit.varies, len(at)))
                n, error_column = np.full(len(component), fit.n), np.full(len(component), error)
                repeated = [pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), flat, pa.array(np.tile(fit.explained, len(at)))]
                yield pa.record_batch([batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(component), pa.array(n), *repeated, pa.array(error_column)], names=names)

    return rows.mapInArrow(run, f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double")
