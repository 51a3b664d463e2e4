"""Rows at one time: the same choice in every run, by the earlier time and then the source's order."""

import pytest
from pyspark.sql import functions as F

from lapforge.operators.joins import nearest_position
from lapforge.operators.lookups import replay_chunk_raw
from lapforge.operators.sequences import braking_zones, detect_windows

CAR = "session_id string, driver_code string, source_sample_index long, lap_number int, at string, session_time_ms long, lap_time_ms long, speed_kmh double, throttle_pct double, brake_pct double, drs int"
PLACE = "session_id string, driver_code string, source_sample_index long, at string, x double, y double, z double"
MARKERS = "session_id string, marker_type string, marker_number int, marker_letter string, x double, y double"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("sample_time_utc", F.to_timestamp("at")).drop("at")


def cars(spark, *rows):
    """(source order, time, speed, brake, drs) of one driver."""
    return table(spark, [("s", "A", k, 1, f"2024-05-01 10:00:{t}", int(float(t)) * 1000, int(float(t)) * 1000, v, 50.0, b, d) for k, t, v, b, d in rows], CAR)


def places(spark, *rows):
    return table(spark, [("s", "A", k, f"2024-05-01 10:00:{t}", x, 0.0, 0.0) for k, t, x in rows], PLACE)


@pytest.mark.parametrize("back", [False, True])
def test_nearest_of_two_in_one_millisecond_is_the_earlier(spark, back):
    rows = [(7, "01.200900", -5.0), (3, "01.200100", 9.0), (4, "01.200100", 1.0)]
    at = places(spark, *(rows[::-1] if back else rows))
    own = cars(spark, (1, "01.000000", 10.0, 0.0, 0))
    assert [(r["x"], r["offset_ms"]) for r in nearest_position(own, at).collect()] == [(9.0, 200)]
    assert [r["x"] for r in nearest_position(own, at.drop("source_sample_index").where("x <> 1")).collect()] == [9.0]


@pytest.mark.parametrize("back", [False, True])
def test_chunks_count_samples_at_one_time_by_source_order(spark, back):
    rows = [(k, "01.000000", float(k), 0.0, 0) for k in range(40)]
    own = cars(spark, *(rows[::-1] if back else rows)).repartition(5)
    got = replay_chunk_raw(own, None, 0, 5000, 2)
    assert sorted(r["source_sample_index"] for r in got.collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("back", [False, True])
def test_runs_of_samples_at_one_time_follow_source_order(spark, back):
    rows = [(1, "01.000000", 10.0, 90.0, 1), (2, "01.000000", 20.0, 10.0, 0), (3, "01.000000", 30.0, 95.0, 1), (4, "01.000000", None, 99.0, 1)]
    own = cars(spark, *(rows[::-1] if back else rows))
    # two runs of one millisecond: both are given, once each, though two positions lie at their time
    at = places(spark, (1, "01.000000", 50.0), (2, "01.000000", 5.0))
    corners = spark.createDataFrame([("s", "corner", 1, None, 0.0, 0.0), ("s", "corner", 2, None, 100.0, 0.0)], MARKERS)
    got = detect_windows(own, "drs_active", at, corners, min_ms=0)
    assert [(r["entry_speed_kmh"], r["exit_speed_kmh"], r["max_brake_pct"], r["marker_number"], r["distance_to_corner"]) for r in sorted(got.collect(), key=lambda r: r["entry_speed_kmh"])] == [(10.0, 10.0, 90.0, 1, 5.0), (30.0, None, 99.0, 1, 5.0)]
    assert [r["entry_speed_kmh"] for r in detect_windows(own, "drs_active", at, corners, min_ms=0, limit=1).collect()] == [10.0]
    assert sorted((r["entry_speed_kmh"], r["exit_speed_kmh"]) for r in braking_zones(own, 80, 0).collect()) == [(10.0, 10.0), (30.0, None)]
