"""Streams over files: several micro-batches, restarts from the checkpoint, late rows, and the batch twins."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from lapforge.sources.fixtures import Fixtures
from lapforge.streaming import runs
from lapforge.streaming import streams as ST

SAMPLE = "session_id string, driver_code string, sample_time_utc timestamp, speed_kmh double, throttle_pct double"


def samples(spark, *rows):
    return spark.createDataFrame([(s, d, f"2024-05-01 {t}", v, 5.0) for s, d, t, v in rows], SAMPLE.replace("timestamp", "string")).withColumn("sample_time_utc", F.to_timestamp("sample_time_utc"))


def tumbling(spark, folder):
    return lambda: runs.run_available(ST.stream_tumbling_metrics(runs.arrivals(spark, f"{folder}/in", SAMPLE)), f"{folder}/out", f"{folder}/state")


def windows(spark, folder):
    return {(r["driver_code"], r["window_start"].strftime("%H:%M")): r["samples"] for r in runs.results(spark, f"{folder}/out", "session_id string, driver_code string, window_start timestamp, samples long").collect()}


@pytest.fixture(scope="module")
def fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


@pytest.mark.parametrize("parts", [1, 4])
def test_slices_give_the_batch_rows(spark, fx, tmp_path, parts):
    plans = {"tumble": lambda s: ST.stream_tumbling_metrics(s, "2 hours"), "segments": lambda s: ST.stream_degraded_segments(s.select(fx.aligned.columns), "1 hour")}
    inputs = {"tumble": fx.telemetry, "segments": fx.aligned}
    for name, plan in plans.items():
        got = runs.replay({"rows": inputs[name]}, plan, str(tmp_path / name), parts)
        assert sorted(map(str, got.collect())) == sorted(map(str, plan(inputs[name]).select(got.columns).collect()))


def test_rows_beyond_the_watermark_are_late(spark, tmp_path):
    folder, run = str(tmp_path), tumbling(spark, tmp_path)
    runs.arrive(samples(spark, ("s", "A", "10:01:00", 100.0), ("s", "A", "10:09:00", 120.0), ("s", "B", "10:02:00", 90.0)), f"{folder}/in")
    first = run()
    assert first.rows == 3 and first.state == 2 and windows(spark, folder) == {}
    # within the minute that rows may be late
    runs.arrive(samples(spark, ("s", "A", "10:08:30", 110.0), ("s", "A", "10:12:00", 80.0)), f"{folder}/in")
    run()
    assert windows(spark, folder) == {("A", "10:00"): 3, ("B", "10:00"): 1}
    # the window is closed: this one is left out and counted
    runs.arrive(samples(spark, ("s", "A", "10:09:30", 300.0), ("s", "A", "10:13:00", 70.0)), f"{folder}/in")
    late = run()
    assert late.late == 1 and windows(spark, folder) == {("A", "10:00"): 3, ("B", "10:00"): 1}
    runs.close(spark, f"{folder}/in", SAMPLE)
    end = run()
    assert windows(spark, folder) == {("A", "10:00"): 3, ("B", "10:00"): 1, ("A", "10:10"): 2} and end.state == 1


def test_a_lost_run_is_done_again_once(spark, tmp_path):
    """A run that ends before it lists its results leaves none, and its successor gives each row once."""
    folder, run = str(tmp_path), tumbling(spark, tmp_path)
    runs.arrive(samples(spark, ("s", "A", "10:01:00", 100.0), ("s", "A", "10:31:00", 100.0)), f"{folder}/in")
    run()
    before = windows(spark, folder)
    shutil.copytree(f"{folder}/state", f"{folder}/kept")
    runs.arrive(samples(spark, ("s", "A", "10:32:00", 100.0), ("s", "A", "11:31:00", 100.0)), f"{folder}/in")
    run()
    after = windows(spark, folder)
    assert before == {("A", "10:00"): 1} and after == {**before, ("A", "10:30"): 2}
    # the progress of the second run is lost, its results are there already: they are not doubled
    shutil.rmtree(f"{folder}/state")
    shutil.copytree(f"{folder}/kept", f"{folder}/state")
    run()
    assert windows(spark, folder) == after
    assert runs.results(spark, f"{folder}/out", "samples long").count() == 2
    # nothing new: nothing is given out
    assert run().rows == 0 and windows(spark, folder) == after


def test_files_a_batch_bounds_micro_batches(spark, fx, tmp_path):
    for part in range(5):
        runs.arrive(fx.telemetry.where(F.col("source_sample_index") % 5 == part).coalesce(1), str(tmp_path / "in"))
    schema = ", ".join(f"{c} {k}" for c, k in fx.telemetry.dtypes)
    stream = ST.stream_event_candidates(runs.arrivals(spark, str(tmp_path / "in"), schema, files_a_batch=2))
    done = runs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert done.batches >= 3 and done.rows == fx.telemetry.count()
    assert runs.results(spark, str(tmp_path / "out"), stream.schema).count() == ST.stream_event_candidates(fx.telemetry).count()


def test_dedupe_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    run = lambda: runs.run_available(ST.stream_dedupe(runs.arrivals(spark, f"{folder}/in", SAMPLE), "10 minutes"), f"{folder}/out", f"{folder}/state")
    for rows in ([("s", "A", "10:01:00", 1.0), ("s", "A", "10:01:00", 2.0), ("s", "B", "10:01:00", 3.0)], [("s", "A", "10:01:00", 4.0), ("s", "A", "10:05:00", 5.0)], [("s", "B", "10:01:00", 6.0), ("s", "A", "10:30:00", 7.0)]):
        runs.arrive(samples(spark, *rows), f"{folder}/in")
        run()
    got = sorted((r["driver_code"], r["sample_time_utc"].strftime("%H:%M")) for r in runs.results(spark, f"{folder}/out", SAMPLE).collect())
    assert got == [("A", "10:01"), ("A", "10:05"), ("A", "10:30"), ("B", "10:01")]


def test_pairs_across_batches_and_without_keys(spark, tmp_path):
    """A sample and a position that arrive in different runs still meet; rows without a session meet none."""
    car = "session_id string, driver_code string, sample_time_utc timestamp, source_sample_index long"
    place = f"{car}, x double, y double"
    at = lambda t: F.to_timestamp(F.lit(f"2024-05-01 {t}"))
    a = lambda s, t, k: spark.range(1).select(F.lit(s).cast("string").alias("session_id"), F.lit("A").alias("driver_code"), at(t).alias("sample_time_utc"), F.lit(k).cast("long").alias("source_sample_index"))
    b = lambda s, t, k: a(s, t, k).withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    folder = str(tmp_path)
    for cars, places in ((a("s", "10:00:00.1", 1), b("s", "10:00:09", 8)), (a(None, "10:00:10", 2), b("s", "10:00:00.6", 9)), (a("s", "10:00:20", 3), b(None, "10:00:10", 7))):
        runs.arrive(cars, f"{folder}/a")
        runs.arrive(places, f"{folder}/b")
        stream = ST.stream_pair_positions(runs.arrivals(spark, f"{folder}/a", car), runs.arrivals(spark, f"{folder}/b", place))
        runs.run_available(stream, f"{folder}/out", f"{folder}/state")
    assert [r["car_index"] for r in runs.results(spark, f"{folder}/out", stream.schema).collect()] == [1]


def test_pairs_of_one_long_stream_meet_in_slots(spark):
    """200,000 samples and as many positions of one driver: all pairs of rows would be 4e10."""
    start = time.time()
    at = lambda shift: F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 400 + shift)
    rows = spark.range(200_000).select(F.lit("s").alias("session_id"), F.lit("A").alias("driver_code"), "id")
    cars = rows.select("session_id", "driver_code", at(0).alias("sample_time_utc"), F.col("id").alias("source_sample_index"))
    places = rows.select("session_id", "driver_code", at(100).alias("sample_time_utc"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    # positions lie 300 ms before, 100 and 500 ms after each sample
    assert ST.stream_pair_positions(cars, places).count() == 3 * 200_000 - 2
    assert ST.stream_pair_positions(cars, places, 0).count() == 0
    assert time.time() - start < 60


def test_empty_inputs(spark, tmp_path):
    got = runs.replay({"rows": samples(spark, ("s", "A", "10:00:00", 1.0)).limit(0)}, ST.stream_tumbling_metrics, str(tmp_path / "x"))
    assert got.isEmpty() and "samples" in got.columns
    assert runs.results(spark, str(tmp_path / "none"), SAMPLE).isEmpty()
