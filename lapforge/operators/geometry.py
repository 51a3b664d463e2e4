"""Lap traces: path length, resampling of closed lines, shape fits and differences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _steps(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Points without consecutive repeats, and the length of the step to the next; the last one's closes the loop."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.coalesce((F.col("x") == F.lag("x").over(w)) & (F.col("y") == F.lag("y").over(w)), F.lit(False))
    kept = points.where("x is not null and y is not null").withColumn("_same", same).where("not _same").drop("_same")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xy")
    return kept.withColumns({"nx": nx, "ny": ny, "step": F.sqrt(F.pow(nx - F.col("x"), 2) + F.pow(ny - F.col("y"), 2))})


def lap_path_length(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per line: points and length of the closed loop through them, consecutive repeats removed."""
    return _steps(points, by, order).groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.sum("step").alias("path_length"))


def candidate_laps(lengths: DataFrame, laps: DataFrame, min_points: int = 100, tolerance: float = 0.15) -> DataFrame:
    """Accurate laps off the pit lane with enough points, whose length is near their session's median."""
    good = laps.where("is_accurate and not is_pit_in_lap and not is_pit_out_lap").select("session_id", "driver_code", "lap_number")
    rows = lengths.join(good, ["session_id", "driver_code", "lap_number"]).where(F.col("points") >= min_points)
    middle = rows.groupBy("session_id").agg(F.median("path_length").alias("_m"))
    return rows.join(middle, "session_id").where(F.abs(F.col("path_length") - F.col("_m")) <= tolerance * F.col("_m")).drop("_m")


def resample_closed(points: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` points (i from 0) at equal distances along each closed line. Lines of no length are left out."""
    steps = _steps(points, by, order).where("step > 0")
    w = Window.partitionBy(*by).orderBy(*order)
    run = steps.withColumns({"to": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("step").over(Window.partitionBy(*by))})
    run = run.withColumn("at", F.col("to") - F.col("step"))
    # the marks that fall into a step: at <= i * total / n < to
    first = F.ceil(F.col("at") * n / F.col("total") - 1e-9).cast("int")
    after = F.ceil(F.col("to") * n / F.col("total") - 1e-9).cast("int")
    marks = run.where(after > first).select(*by, "x", "y", "nx", "ny", "at", "step", "total", F.explode(F.sequence(first, F.least(after - 1, F.lit(n - 1)))).alias("i"))
    share = F.greatest(F.lit(0.0), F.col("i") * F.col("total") / n - F.col("at")) / F.col("step")
    return marks.select(*by, "i", (F.col("x") + (F.col("nx") - F.col("x")) * share).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * share).alias("y"))


def _sums(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sums over i of x[i] * u[(i + offset) mod n] and of x[i] * u[(offset - i) mod n], for all offsets: two rows."""
    fx, fu = np.fft.rfft(x), np.fft.rfft(u)
    return np.stack([np.fft.irfft(np.conj(fx) * fu, len(x)), np.fft.irfft(fx * fu, len(x))])


def _similarity(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Scale, rotation and shift with least squares, and their error, from the sums of the matched points."""
    n = np.maximum(s["n"], 1)
    mx, my, mu, mv = (s[c] / n for c in ("x", "y", "u", "v"))
    sx, su = s["xx"] / n - mx**2 - my**2, s["uu"] / n - mu**2 - mv**2
    dot, cross = s["dot"] / n - mx * mu - my * mv, s["cross"] / n - mx * mv + my * mu
    some = sx > 1e-12 * np.maximum(s["xx"] / n, 1e-300)
    a, b = (np.where(some, v / np.where(some, sx, 1), 0.0) for v in (dot, cross))
    rmse = np.sqrt(np.maximum(su - (a * dot + b * cross), 0.0))
    return {"rmse": np.where(s["n"] > 0, rmse, np.inf), "a": a, "b": b, "dx": mu - a * mx + b * my, "dy": mv - b * mx - a * my}


def best_fit(x: np.ndarray, y: np.ndarray, here: np.ndarray, u: np.ndarray, v: np.ndarray, there: np.ndarray) -> dict[str, float]:
    """The best similarity of a line's points (x, y where ``here``) onto a reference's (u, v where ``there``) over all start offsets in both directions.

    Point i meets (i * direction + offset) mod n. Six sums of products decide an offset; Fourier
    transforms give them for all n at once. What comes within rounding of the best is then summed
    point by point, so equal lines give equal fits; ties go to the smallest offset, then direction.
    """
    n, m, k = len(x), here.astype(float), there.astype(float)
    x, y, u, v = (np.where(w > 0, c, 0.0) for c, w in ((x, m), (y, m), (u, k), (v, k)))
    # about their own means, so that less is lost to rounding
    cx, cy, cu, cv = x.sum() / m.sum(), y.sum() / m.sum(), u.sum() / k.sum(), v.sum() / k.sum()
    x, y, u, v = (x - cx) * m, (y - cy) * m, (u - cu) * k, (v - cv) * k
    products = {"n": [(m, k)], "x": [(x, k)], "y": [(y, k)], "u": [(m, u)], "v": [(m, v)], "xx": [(x * x + y * y, k)], "uu": [(m, u * u + v * v)], "dot": [(x, u), (y, v)], "cross": [(x, v), (-y, u)]}
    sums = {c: sum(_sums(p, q) for p, q in pairs) for c, pairs in products.items()}
    sums["n"] = np.rint(sums["n"])
    rough = _similarity(sums)["rmse"]
    limit = rough.min() + 1e-6 * (np.sqrt(max((u * u + v * v).sum() / k.sum(), 0)) + 1e-300)
    direction, offset = np.nonzero(rough <= limit)
    best = None
    for at in range(0, len(offset), 256):
        d, o = np.where(direction[at : at + 256] == 0, 1, -1), offset[at : at + 256]
        j = (np.arange(n)[None, :] * d[:, None] + o[:, None]) % n
        exact = {c: sum((p[None, :] * q[j]).sum(axis=1) for p, q in pairs) for c, pairs in products.items()}
        fits = _similarity(exact)
        first = np.lexsort((d, o, fits["rmse"]))[0]
        found = (fits["rmse"][first], o[first], d[first])
        if best is None or found < best[0]:
            best = (found, {c: w[first] for c, w in fits.items()}, j[first])
    (rmse, o, d), f, j = best
    a, b = f["a"], f["b"]
    out = {"rmse": float(rmse), "offset": int(o), "direction": int(d), "a": float(a), "b": float(b), "dx": float(f["dx"] + cu - a * cx + b * cy), "dy": float(f["dy"] + cv - b * cx - a * cy)}
    met = (m > 0) & (k[j] > 0)
    gap = np.hypot(a * x - b * y + f["dx"] - u[j], b * x + a * y + f["dy"] - v[j])[met]
    p50, p95 = np.percentile(gap, [50, 95])
    return out | {"p50": float(p50), "p95": float(p95), "max": float(gap.max()), "scale": float(np.hypot(a, b)), "angle_rad": float(np.arctan2(b, a))}


FIT = "rmse double, offset int, direction int, a double, b double, dx double, dy double, p50 double, p95 double, max double, scale double, angle_rad double"


def fit_shape(laps: DataFrame, reference: DataFrame, by: list[str], n: int) -> DataFrame:
    """Best scale, rotation and shift of each line onto the reference, over all ``n`` start offsets in both directions.

    Lines and reference have points i of 0 to n - 1, of which some may be missing. Returns rmse,
    offset, direction, the coefficients a, b, dx, dy (u = a x - b y + dx, v = b x + a y + dy), p50, p95
    and max of the distances, scale and angle_rad. A line is one group of n points; lines that share no
    point with the reference are left out. A line without extent fits with scale 0.
    """
    # n rows at most
    points = {r["i"]: (r["x"], r["y"]) for r in reference.where(F.col("i").between(0, n - 1) & F.col("x").isNotNull() & F.col("y").isNotNull()).select("i", "x", "y").collect()}
    there = np.array([i in points for i in range(n)])
    u, v = (np.array([points.get(i, (0.0, 0.0))[c] for i in range(n)]) for c in (0, 1))
    kinds = ", ".join(f"`{c}` {laps.schema[c].dataType.simpleString()}" for c in by)
    names = [f.split()[0] for f in FIT.split(", ")]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, here = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        at = rows["i"].to_numpy()
        x[at], y[at], here[at] = rows["x"].to_numpy(), rows["y"].to_numpy(), True
        if not there.any():
            return pd.DataFrame(columns=[*by, *names])
        found = best_fit(x, y, here, u, v, there)
        return pd.DataFrame([[*rows[by].iloc[0], *(found[c] for c in names)]], columns=[*by, *names])

    own = laps.where(F.col("i").between(0, n - 1) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return own.select(*by, "i", F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*by).applyInPandas(fit, f"{kinds}, {FIT}")


def _apply(laps: DataFrame, fits: DataFrame, by: list[str], n: int) -> DataFrame:
    """Lines moved onto the reference, with the reference's index."""
    rows = laps.join(fits.select(*by, "offset", "direction", "a", "b", "dx", "dy"), by)
    i = F.pmod(F.col("i") * F.col("direction") + F.col("offset"), F.lit(n))
    return rows.select(*by, i.alias("i"), (F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("dx")).alias("x"), (F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("dy")).alias("y"))


def average_fitted_laps(laps: DataFrame, fits: DataFrame, by: list[str], n: int) -> DataFrame:
    """Mean of the fitted lines at each index of the reference."""
    return _apply(laps, fits, by, n).groupBy("i").agg(F.count(F.lit(1)).alias("laps"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def line_difference(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distances of two resampled lines at equal indices: rmse, p50, p95, max."""
    keys = [*by, "i"]
    rows = a.select(*keys, "x", "y").join(b.select(*keys, F.col("x").alias("u"), F.col("y").alias("v")), keys)
    rows = rows.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2)))
    return rows.groupBy(*by).agg(F.sqrt(F.avg(F.pow("d", 2))).alias("rmse"), F.percentile("d", 0.5).alias("p50"), F.percentile("d", 0.95).alias("p95"), F.max("d").alias("max"))


def regular_polygon(spark, n: int, radius: float) -> DataFrame:
    """A reference line: ``n`` points on a circle."""
    t = F.col("id") * (2 * math.pi / n)
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.cos(t) * radius).alias("x"), (F.sin(t) * radius).alias("y"))
