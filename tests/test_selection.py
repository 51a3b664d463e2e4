"""Exact percentiles against Spark's own, with brackets that are narrow and wide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.operators import grids, quality
from lapforge.operators.selection import exact_percentiles
from lapforge.sources.fixtures import Fixtures

SHARES = {"least": 0.0, "p1": 0.01, "p10": 0.1, "mid": 0.5, "p90": 0.9, "p999": 0.999, "most": 1.0}


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_equal_to_percentile(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    rows = [(["a", "b", None][k % 3], float(v)) for k, v in enumerate(rng.normal(size=6000))]
    rows += [("few", float(v)) for v in range(5)] + [("one", 7.0), ("ties", 3.0), ("none", None), ("nan", float("nan"))]
    rows += [("ties", float(v)) for v in rng.integers(0, 4, 3000)] + [("skew", float(v)) for v in np.exp(6 * rng.normal(size=2500))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", SHARES, accuracy).collect()}
    want = df.where("not isnan(v)").groupBy("g").agg(F.percentile("v", list(SHARES.values())).alias("p")).where("p is not null").collect()
    assert len(got) == len(want) == 7
    for r in want:
        assert np.allclose([got[r["g"]][n] for n in SHARES], r["p"], rtol=1e-12, atol=1e-12)


def test_one_group_and_none(spark):
    df = spark.range(100_001).select((F.col("id") * 7 % 100_001).cast("double").alias("v"))
    r = exact_percentiles(df, [], "v", {"q": 0.25, "m": 0.5, "t": 0.99}, 200).first()
    assert (r["q"], r["m"], r["t"]) == (25_000, 50_000, 99_000)
    assert exact_percentiles(df.limit(0), [], "v", {"m": 0.5}).first()["m"] is None
    assert exact_percentiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).isEmpty()


def test_brackets_are_small(spark):
    """Of a million distinct values only the bracket's are told apart."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("v"))
    out = exact_percentiles(df, ["g"], "v", {"m": 0.5, "p95": 0.95}, 1000)
    got, want = out.first(), df.agg(F.percentile("v", [0.5, 0.95])).first()[0]
    assert np.allclose([got["m"], got["p95"]], want, rtol=1e-12)


def test_reports_by_selection(spark, sf_dir):
    """Stream diagnostics and speed baselines are the same either way."""
    fx = Fixtures(spark, sf_dir)
    plain = grids.stream_diagnostics(fx.telemetry)
    assert sorted(map(str, plain.collect())) == sorted(map(str, grids.stream_diagnostics(fx.telemetry, accuracy=20).select(plain.columns).collect()))
    laps = spark.createDataFrame([(f"s{k % 2}", False, 20, *(float((k * b * 37) % 101) for b in range(1, 21))) for k in range(120)], ["session_id", "bad_lap_any_category", "speed_profile_bins_present", *quality.BINS])
    rows = lambda df: {(r["session_id"], r["bin"]): (r["laps"], *(round(r[c], 9) for c in ("q10", "median", "q90"))) for r in df.collect()}
    want = rows(quality.speed_profile_baselines(laps))
    assert len(want) == 40 and rows(quality.speed_profile_baselines(laps, accuracy=10)) == want
