"""Overlap counts by a sweep against counting pair by pair, and on one large session."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.operators.joins import lap_status_overlap, overlap_counts


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("width", [5, 1000])
def test_counts_equal_pairs(spark, closed, width):
    rng = np.random.default_rng(width)
    point = lambda: int(rng.integers(0, 60))
    rows = [("ab"[k % 2], k, a, a + 1 + int(rng.integers(0, 30))) for k in range(60) for a in [point()]]
    if closed:
        rows += [("a", 100 + k, a, a) for k in range(10) for a in [point()]]
    rows += [("a", 200, None, 5), ("a", 201, 9, 2), ("z", 202, 0, 99)]
    periods = [("ab"[k % 2], a, None if k % 9 == 0 else a + 1 + int(rng.integers(0, 20)), "xyz"[k % 3]) for k in range(50) for a in [point()]]
    periods += [("a", None, 3, "x"), ("c", 0, 99, "x"), ("a", 30, 40, None)]
    if closed:
        periods += [("a", a, a, "y") for a in (10, 20, 30)]
    meets = lambda a, b, s, e: s <= b and (e is None or e >= a) if closed else s < b and (e is None or e > a)
    want = {}
    for session, key, a, b in rows:
        own = [c for p, s, e, c in periods if p == session and None not in (a, b, s) and a <= b and meets(a, b, s, e)]
        want[key] = (sum(c == "x" for c in own), sum(c in ("x", "y") for c in own if c), len(own))
    r, p = spark.createDataFrame(rows, "session_id string, k int, f long, t long"), spark.createDataFrame(periods, "session_id string, start_time_ms long, end_time_ms long, c string")
    kinds = {"x": F.col("c") == "x", "xy": F.col("c").isin("x", "y"), "all": F.lit(True)}
    got = overlap_counts(r, ["k"], "f", "t", p, kinds, closed=closed, width=width).collect()
    assert {x["k"]: (x["x"], x["xy"], x["all"]) for x in got} == want and len(got) == len(rows)


def test_empty_sides(spark):
    rows = spark.createDataFrame([("a", 1, 0, 5)], "session_id string, k int, f long, t long")
    periods = spark.createDataFrame([("a", 0, 5)], "session_id string, start_time_ms long, end_time_ms long")
    n = lambda r, p: [x["n"] for x in overlap_counts(r, ["k"], "f", "t", p, {"n": F.lit(True)}).collect()]
    assert n(rows, periods) == [1] and n(rows, periods.limit(0)) == [0] and n(rows.limit(0), periods) == []


def test_one_large_session(spark):
    """200,000 laps that each overlap thousands of 20,000 changes of status: linear, so soon done."""
    laps = spark.range(200_000).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("lap_id"), F.col("id").alias("lap_start_ms"), (F.col("id") + 80_000).alias("lap_end_ms"))
    events = spark.range(20_000).select(F.lit("s").alias("session_id"), (F.col("id") * 10).alias("event_time_ms"), F.element_at(F.array(*map(F.lit, "1245")), (F.col("id") % 4 + 1).cast("int")).alias("status_code"), F.lit(None).cast("string").alias("message"))
    start = time.time()
    got = lap_status_overlap(laps, events, 20_000).agg(F.sum("safety_car_periods").alias("n"), F.min("track_status_codes").alias("c"), F.count("*").alias("rows")).first()
    assert time.time() - start < 60
    k = np.arange(200_000)
    # the periods of code 4 are 20, 60, 100 ... long 10, the last one open
    want = (np.minimum((k + 80_000 - 20) // 40, 4999) - np.ceil((k - 30) / 40).clip(0)).clip(-1) + 1
    assert (got["n"], got["c"], got["rows"]) == (int(want.sum()), "1,2,4,5", 200_000)
