"""Maps against numpy's least squares, distances against sorted samples."""

import numpy as np
import pytest

from leafmill.operators import calibration as C


def test_affine_maps(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for page in range(5):
        p = r.normal(size=(12, 2)) * 50
        q = p @ r.normal(size=(2, 2)) + r.normal(size=2) * 9 + r.normal(size=(12, 2))
        rows += [(page, *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)]
        m, *_ = np.linalg.lstsq(np.c_[p, np.ones(12)], q, rcond=None)
        left = q - np.c_[p, np.ones(12)] @ m
        want[page] = [*m[:, 0], *m[:, 1], np.sqrt((left**2).sum(1).mean())]
    rows += [(9, float(k), 2.0 * k, 1.0, 2.0) for k in range(4)]  # on a line
    got = {x.page: [x.a, x.b, x.c, x.d, x.e, x.f, x.error] for x in C.affine_maps(spark.createDataFrame(rows, "page int, x double, y double, u double, v double"), ["page"]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_distances_equal_the_sorted_definition(spark):
    r = np.random.default_rng(5)
    a = {k: r.integers(0, 30, 24) for k in range(6)} | {7: np.array([3, 3])}
    b = {k: r.integers(0, 30, 24) + k for k in range(6)} | {8: np.array([1])}
    frame = lambda d: C.histogram(spark.createDataFrame([(k, float(x)) for k, v in d.items() for x in v] + [(0, None)], "k int, x double"), ["k"], "x")
    got = {x.k: x.distance for x in C.distances(frame(a), frame(b), ["k"]).collect()}
    assert got == {k: pytest.approx(np.abs(np.sort(a[k]) - np.sort(b[k])).mean()) for k in range(6)}
    assert C.distances(frame(a).limit(0), frame(b).limit(0), ["k"]).count() == 0


def test_nearest_parameter(spark):
    seen = spark.createDataFrame([("x", 5.0, 4), ("x", 9.0, 4), ("y", 1.0, 1)], "k string, value double, n long")
    tried = spark.createDataFrame([(k, s, v + s, 2) for k, vs in (("x", (2.0, 6.0)), ("y", (0.0, 2.0))) for s in range(5) for v in vs], "k string, s long, value double, n long")
    got = {x.k: (x.s, x.distance) for x in C.nearest_parameter(tried, seen, ["k"], "s").collect()}
    assert got == {"x": (3, 0.0), "y": (0, 1.0)}
