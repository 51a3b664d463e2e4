"""Shape fits against sums over all offsets, point by point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.operators import geometry as G


def plain(x, y, here, u, v, there):
    """rmse of the best similarity by offset and direction."""
    n, out = len(x), {}
    for d in (1, -1):
        for o in range(n):
            j = (np.arange(n) * d + o) % n
            met = here & there[j]
            if met.any():
                z, w = (x + 1j * y)[met], (u + 1j * v)[j][met]
                z0, w0 = z - z.mean(), w - w.mean()
                c = (np.conj(z0) * w0).sum() / (abs(z0) ** 2).sum() if abs(z0).any() else 0
                out[o, d] = np.sqrt((abs(w0 - c * z0) ** 2).mean())
    return out


@pytest.mark.parametrize("n, holes", [(24, False), (24, True), (25, True), (720, False)])
def test_best_of_all_offsets(n, holes):
    rng = np.random.default_rng(n + holes)
    t = np.arange(n) * 2 * np.pi / n
    u, v = 1000 * np.cos(t) + 300 * np.cos(2 * t + 1), 700 * np.sin(t) + 90 * np.sin(5 * t)
    for turn, (offset, direction) in enumerate([(0, 1), (n // 3, 1), (5, -1)]):
        j = (np.arange(n) * direction + offset) % n
        z = ((u + 1j * v)[j] + 40 * rng.normal(size=n) * turn) * 0.3 * np.exp(1j * (1 + turn)) + 5000 - 2000j
        here = rng.random(n) > 0.2 if holes else np.ones(n, bool)
        there = rng.random(n) > 0.1 if holes else np.ones(n, bool)
        got = G.best_fit(z.real, z.imag, here, u, v, there)
        want = plain(z.real, z.imag, here, u, v, there)
        assert abs(got["rmse"] - min(want.values())) <= 1e-6 and abs(want[got["offset"], got["direction"]] - got["rmse"]) <= 1e-6
        k = (np.arange(n) * got["direction"] + got["offset"]) % n
        met = here & there[k]
        gap = np.hypot(got["a"] * z.real - got["b"] * z.imag + got["dx"] - u[k], got["b"] * z.real + got["a"] * z.imag + got["dy"] - v[k])[met]
        assert np.allclose([np.sqrt((gap**2).mean()), np.median(gap), gap.max()], [got["rmse"], got["p50"], got["max"]], atol=1e-6)
        if not holes:
            assert (got["offset"], got["direction"]) == (offset, direction) and abs(got["scale"] - 1 / 0.3) < 0.2


def test_lines_of_one_point_and_foreign_lines(spark):
    rows = [("dot", i, 5.0, 5.0) for i in range(8)] + [("half", i, float(i), float(i * i)) for i in range(4)] + [("null", 0, None, 1.0)]
    ref = G.regular_polygon(spark, 8, 10.0)
    laps = spark.createDataFrame(rows, "lap string, i int, x double, y double")
    got = {r["lap"]: r for r in G.fit_shape(laps, ref, ["lap"], 8).collect()}
    assert set(got) == {"dot", "half"} and got["dot"]["scale"] == 0 and abs(got["dot"]["rmse"] - 10) < 1e-9
    assert G.fit_shape(laps, ref.limit(0), ["lap"], 8).isEmpty() and G.fit_shape(laps.limit(0), ref, ["lap"], 8).isEmpty()


def test_many_lines_are_many_groups(spark):
    """500 lines of 720 points: every offset in both directions of each."""
    n = 720
    t = F.col("i") * (2 * np.pi / n)
    lines = spark.range(500).select(F.col("id").alias("lap"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    lines = lines.select("lap", "i", (F.cos(t) * 100 + F.cos(t * 3 + F.col("lap")) * 9).alias("x"), (F.sin(t) * 60).alias("y"))
    ref = lines.where("lap = 7").select("i", "x", "y")
    got = G.fit_shape(lines, ref, ["lap"], n)
    assert got.count() == 500 and abs(got.where("lap = 7").first()["rmse"]) < 1e-6
