"""Windows of events: all of them, however many a session has."""

import os

import duckdb
from pyspark.sql import functions as F

from lapforge.operators.sequences import detect_windows
from lapforge.plans.queries import QUERIES, SQL

CAR = "session_id string, driver_code string, lap_number int, session_time_ms long, lap_time_ms long, speed_kmh double, throttle_pct double, brake_pct double, drs int, sample_time_utc timestamp"


def test_all_windows_unless_a_limit_is_given(spark):
    own = spark.range(2_202).selectExpr("'s'", "'A'", "1", "id * 1000", "id * 1000", "50D", "50D", "0D", "cast(id % 2 as int)", "timestamp_seconds(id)").toDF(*(c.split()[0] for c in CAR.split(", ")))
    assert detect_windows(own, "drs_active", min_ms=0).count() == 1_101
    first = detect_windows(own, "drs_active", min_ms=0, limit=3)
    assert sorted(r["start_session_time_ms"] for r in first.collect()) == [1000, 3000, 5000]


def test_drs_query_has_more_than_5000_windows_of_a_session(spark, sf_dir, tmp_path):
    for t in ("region", "nation"):
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = spark.range(11_000).selectExpr("id as event_id", "timestamp_ntz '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id * 7) as ts", "7L as user_id", "if(id % 2 = 0, 'click', 'view') as event_type", "cast(id % 300 as double) as value", "'{\"k\": 5}' as props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["detect_windows_drs_active"](spark, str(tmp_path))
    with duckdb.connect() as c:
        for t in ("region", "nation", "events"):
            at = f"{tmp_path}/{t}.parquet"
            c.execute(f"create view {t} as select * from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
        want = c.execute(f"select count(*), sum(start_session_time_ms), sum(marker_number) from ({SQL['detect_windows_drs_active']})").fetchone()
    assert tuple(got.agg(F.count(F.lit(1)), F.sum("start_session_time_ms"), F.sum("marker_number")).first()) == tuple(want)
    assert want[0] == 5_500
