import math

import numpy as np
import pytest

from lodestone.llm import whitening
from lodestone.llm.whitening import Centre, whitened

KINDS = "vec_id long, embedding array<double>"


def plain(rows, components=16):
    """Eigenvectors of the exact covariance by numpy, from whole numbers."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    points = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(points), points.sum(axis=0)
    centred = np.array((points * n - sums).tolist(), np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviations = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    projected = np.array((x * n - sums).tolist(), np.float64) / n @ axes[:, order] / np.sqrt(values[order])
    return n, deviations, projected, values[order] / values.sum()


def run(spark, rows, **more):
    out = {}
    for r in whitened(spark.createDataFrame(rows, KINDS).repartition(3), **more).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_against_eigenvectors(spark, spread):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(20, 20)) * np.geomspace(spread, 0.5, 20)
    rows = [(i, (rng.normal(size=20) @ mix + 3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    n, deviations, projected, explained = plain(rows)
    out = run(spark, rows)
    assert len(out) == len(rows) and n == 400
    signs = np.sign([out[0][c + 1].whitened * projected[0, c] for c in range(16)])
    for (i, _), dev, line in zip(rows, deviations, projected, strict=True):
        assert sorted(out[i]) == list(range(1, 17))
        for c in range(16):
            r = out[i][c + 1]
            assert (r.n, r.deviation) == (n, dev) and r.whitened == pytest.approx(signs[c] * line[c], abs=1e-7)
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_directions_that_hardly_vary(spark):
    """Eigenvalues nine orders apart: a covariance that was not centred first, or one Gram pass, would lose the last."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(rng.integers(-10**6, 10**6)), float(rng.integers(-10**6, 10**6)), float(rng.integers(0, 3)) / 64]) for i in range(500)]
    n, _, projected, explained = plain(rows)
    out = run(spark, rows)
    assert explained[2] < 1e-15 and all(out[i][3].explained == pytest.approx(explained[2], rel=1e-6) for i in (0, 1))
    assert all(abs(out[i][3].whitened) == pytest.approx(abs(projected[i, 2]), abs=1e-4) for i in range(500)) and out[0][1].identity_error < 1e-6


def test_constant_and_repeated_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [*v, v[0], 7.0, v[1] + v[2] * 0]) for i, v in enumerate(rng.integers(-50, 50, (200, 3)).astype(float).tolist())]
    out = run(spark, rows)
    assert all(sorted(v) == [1, 2, 3] for v in out.values()) and out[0][1].identity_error < 1e-8
    assert sum(out[0][c].explained for c in (1, 2, 3)) == pytest.approx(1.0)


def test_unusable_rows_and_other_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 1.0, 1.0]), (105, [1e300, 0.0, 0.0]), (106, [1.0, 2.0]), (None, [0.5, 0.5, 0.5])]
    out = run(spark, rows + odd)
    assert set(out) == {*range(30), None} and {r.n for v in out.values() for r in v.values()} == {31}
    more = spark.createDataFrame(rows, KINDS).selectExpr("vec_id", "embedding", "'a' AS x", "1 AS key", "2 AS n")
    assert whitened(more).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whitened(more).count() == 90


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], KINDS)
    assert whitened(df).count() == whitened(df.limit(1)).count() == whitened(df.limit(0)).count() == 0


def test_deviations_are_exact_or_null():
    x = np.array([[2**55, -2**55], [3, 5], [10**9, 7]], np.int64)
    centre = Centre(7, (21, 35))
    want = [sum((7 * int(a) - s) ** 2 for a, s in zip(r, centre.sums)) for r in x]
    assert whitening._deviations(x, centre) == [None if w >= 1 << 63 else w for w in want] and want[0] >= 1 << 63
