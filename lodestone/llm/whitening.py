"""Embedding whitening by shifted CholeskyQR: Gram passes orthogonalise the centred rows, the composed R gives the components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces
from lodestone.session import cut_lineage

UNIT = np.finfo(np.float64).eps / 2
#: Gram passes at most; three are enough unless components differ by ten orders of magnitude.
PASSES = 8
#: Integers of a vector stay below this, components with a smaller share of the largest singular value count as none.
LARGEST, LEAST_SHARE = 2.0 ** 62, 1e-12


@dataclass(frozen=True)
class Centre:
    """Sums of ``n`` integer vectors, as exact integers."""
    n: int
    sums: tuple[int, ...]

    def pivots(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder of the mean: ``x - mean == (x - whole) - rest / n``."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


@dataclass(frozen=True)
class Whitening:
    """Components as columns of ``axes`` with eigenvalues ``spread``, largest first, and the trace of the covariance."""
    centre: Centre
    axes: np.ndarray
    spread: np.ndarray
    trace: float


def _integers(scale: int, offset: int):
    """Rows whose vector is finite, its entries as ``floor(scale * c) + offset``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "vector"):
            lists = part.column("vector")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = lists.flatten()
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(entries.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            fine = (np.abs(values) < LARGEST) & entries.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(owner[~fine], minlength=len(sizes)) > 0
            keep = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & ~bad)
            kept = ~bad[owner]
            x = pa.array(values[kept].astype(np.int64) + offset)
            offsets = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), x)], ["key", "x"])

    return run


def integer_rows(rows: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    slim = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return slim.mapInArrow(_integers(scale, offset), slim.select("key", F.lit(None).cast("array<long>").alias("x")).schema)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def centre_of(points: DataFrame, width: int) -> Centre:
    """Exact sums: high and low halves of the integers are added apart in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for part in pieces(batches, "x"):
            x = _matrix(part)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = points.mapInArrow(run, "i long, n long, high long, low long")
    total = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # a row a dimension
    return Centre(int(total[0]["n"]), tuple((int(r["high"]) << 32) + int(r["low"]) for r in total))


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inv(factor)`` for an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(points: DataFrame, width: int, centre: Centre, image: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``image(centred rows)`` and of its products, one partial matrix a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = centre.pivots()
        total = np.zeros((width + 1, width))
        for part in pieces(batches, "x", 4 << 20):
            q = image((_matrix(part) - whole) - rest / centre.n)
            total[:width] += q.T @ q
            total[width] += q.sum(axis=0)
        above, edge = np.triu_indices(width), np.arange(width)
        i, j = np.concatenate((above[0], np.full(width, width))), np.concatenate((above[1], edge))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    cells = points.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # bounded by the dimensions squared
    out = np.zeros((width + 1, width))
    out[cells["i"], cells["j"]] = cells["v"]
    square = out[:width]
    return square + np.triu(square, 1).T, out[width]


def _factor(square: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular Cholesky factor of the shifted matrix; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(square + shift * np.eye(len(square))).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(points: DataFrame, width: int, components: int) -> Whitening:
    """Shifted CholeskyQR of the centred rows of ``points(x)``, and the singular values of the composed R."""
    centre = centre_of(points, width)
    factors: list[np.ndarray] = []

    def image(rows: np.ndarray) -> np.ndarray:
        for f in factors:
            rows = _solved(rows, f)
        return rows

    composed, null = np.eye(width), -1
    for turn in range(PASSES):
        square, _ = gram(points, width, centre, image)
        if turn == 0:
            size = float(np.trace(square))
            if size <= 0:
                return Whitening(centre, np.zeros((width, 0)), np.zeros(0), 0.0)
            # the published shift, at most what still leaves the next pass well conditioned
            shift = min(11 * (centre.n * width + width * (width + 1)) * UNIT, 1e-8) * size
        else:
            values = np.linalg.eigvalsh(square)
            before, null = null, int((values <= 1e-6).sum())
            if ((values <= 1e-6) | (np.abs(values - 1) <= 1e-10)).all() and null in (0, before):
                break
            shift = 4 * width * UNIT
        factors.append(_factor(square, shift))
        composed = factors[-1] @ composed
    _, singular, rows = np.linalg.svd(composed)
    axes = rows.T * np.sign(rows.T[np.abs(rows.T).argmax(axis=0), np.arange(width)])
    count = min(components, int((singular > LEAST_SHARE * singular[0]).sum()))
    spread = singular ** 2 / centre.n
    return Whitening(centre, axes[:, :count], spread[:count], float(spread.sum()))


def identity_error(points: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    count, n = model.axes.shape[1], model.centre.n
    turn = model.axes / np.sqrt(model.spread)
    padded = np.zeros((width, width))
    padded[:, :count] = turn
    square, sums = gram(points, width, model.centre, lambda rows: rows @ padded)
    mean = sums[:count] / n
    return float(np.abs(square[:count, :count] / n - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


def _deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Sums of ``(n * x - sums) ** 2``, exact; none where one does not fit a long."""
    whole, rest = centre.pivots()
    y = x - whole
    near = (centre.n * y.astype(np.float64) - rest) ** 2
    small = near.sum(axis=1) < 2.0 ** 62
    out: list[int | None] = [None] * len(x)
    exact = ((centre.n * y[small] - rest) ** 2).sum(axis=1) if small.any() else np.zeros(0, np.int64)
    for at, value in zip(np.flatnonzero(small).tolist(), exact.tolist(), strict=True):
        out[at] = value
    for at in np.flatnonzero(~small).tolist():
        value = sum((centre.n * a - b) ** 2 for a, b in zip(y[at].tolist(), rest.tolist(), strict=True))
        out[at] = value if value < 1 << 63 else None
    return out


def _projected(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = model.centre.pivots()
        count, n = len(model.spread), model.centre.n
        for part in pieces(batches, "x"):
            x = _matrix(part)
            values = ((x - whole) - rest / n) @ model.axes / np.sqrt(model.spread)
            rows = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                 pa.array(_deviations(x, model.centre), pa.int64()).take(pa.array(rows)), pa.array(values.reshape(-1)),
                 pa.array(np.tile(model.spread / model.trace, len(x))), pa.array(np.full(len(rows), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for each usable row and leading component.

    An entry ``c`` becomes the integer ``floor(scale * c) + offset``.  The components are those of the distinct integer vectors, ``n``
    of them: their centred rows are orthogonalised by shifted Cholesky factors of distributed Gram matrices, and the
    product of the factors is decomposed.  ``whitened`` is the row's projection over the root of the component's
    variance, ``explained`` the component's part of all variance, ``deviation`` the exact sum of ``(n * x - S) ** 2``
    over the dimensions (null past a long), ``identity_error`` how far the whitened covariance is from the identity.

    Vectors that are null, empty, hold null or non-finite entries or such as leave 62 bits take no part, nor do vectors of
    another length than the commonest (of equally common ones the longest).  Repeated vectors are fitted once and come
    back each; null keys too.  Components without variance are left out, so equal vectors, a single one or an empty table give an empty
    result.  Other columns are ignored.
    """
    kept = cut_lineage(integer_rows(rows, key, vector, scale, offset))
    width = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).select("width").first()
    width = width["width"] if width else 0
    kept = kept.where(F.size("x") == width)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = kept.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return kept.sparkSession.createDataFrame([], schema).toDF(*names)
    points = cut_lineage(kept.select("x").distinct())
    model = fit(points, width, components)
    if not len(model.spread):
        return kept.sparkSession.createDataFrame([], schema).toDF(*names)
    error = identity_error(points, width, model)
    return kept.mapInArrow(_projected(model, error), schema).toDF(*names)
