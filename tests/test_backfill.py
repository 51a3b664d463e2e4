"""The backfill of distance rows: chosen sessions, positions, and tables that change together."""

import re

import pytest
from pyspark.sql import functions as F

from lapforge.operators import backfill, grids
from lapforge.sources import commits
from lapforge.sources.fixtures import Fixtures

OPTIONS = {"step_m": 5000.0, "max_gap_ms": 14_400_000, "max_position_gap_ms": 14_400_000, "max_age_ms": 14_400_000}
ROWS = "session_id string, driver_code string, lap_number int, distance_m double, speed_kmh double, x double, y double, z double"


@pytest.fixture(scope="module")
def fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def run(fx, root, samples=None, **options):
    return {r["session_id"]: (r["distance_rows"], r["quality_rows"]) for r in backfill.run_backfill(root, fx.sessions, fx.drivers, samples if samples is not None else fx.telemetry, fx.laps, fx.positions, **OPTIONS, **options).collect()}


def seen(spark, root):
    distance = commits.read_committed(spark, root, "lap_distance", ROWS)
    quality = commits.read_committed(spark, root, "lap_quality", "session_id string, driver_code string, lap_number int, quality_status string")
    return sorted(map(str, distance.collect())), sorted(map(str, quality.collect()))


def test_a_lost_write_changes_nothing_and_is_done_again(spark, fx, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    first = run(fx, root, limit=2)
    before = seen(spark, root)
    assert len(first) == 2 and before[0] and before[1]
    whole, calls = commits.stage, []

    def lost(tables, *rest):
        calls.append(list(tables))
        if "lap_quality" in tables:
            raise RuntimeError("executor lost")
        return whole(tables, *rest)

    monkeypatch.setattr(commits, "stage", lost)
    with pytest.raises(RuntimeError):
        run(fx, root, limit=4)
    # the distance rows are there, but no reader sees them
    assert calls == [["lap_distance"], ["lap_quality"]] and seen(spark, root) == before
    monkeypatch.setattr(commits, "stage", whole)
    again = run(fx, root, limit=4)
    assert len(again) == 2 and not set(again) & set(first)
    after = seen(spark, root)
    assert set(before[0]) < set(after[0]) and len(after[1]) == sum(n for _, n in (*first.values(), *again.values()))
    assert commits.remove_unlisted(spark, root, list(backfill.TABLES)) == 1 and seen(spark, root) == after
    # nothing is missing any more
    assert run(fx, root, limit=4) == {}


def test_lost_between_tables_and_commit(spark, fx, tmp_path, monkeypatch):
    root, whole = str(tmp_path / "store"), commits.commit
    monkeypatch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        run(fx, root, limit=1)
    assert seen(spark, root) == ([], [])
    monkeypatch.setattr(commits, "commit", whole)
    assert len(run(fx, root, limit=1)) == 1 and all(seen(spark, root))


def test_replaced_sessions_change_in_both_tables(spark, fx, tmp_path):
    root = str(tmp_path / "store")
    done = run(fx, root, limit=2)
    one = sorted(done)[0]
    old = seen(spark, root)
    faster = fx.telemetry.withColumn("speed_kmh", F.col("speed_kmh") * 2)
    # named sessions are taken whatever their year or type
    new = run(fx, root, samples=faster, only_missing=False, ids=[one], year=1999, session_type="Q")
    assert list(new) == [one] and new[one][1] == done[one][1] and new[one][0] > done[one][0]
    now = seen(spark, root)
    kept = lambda rows: [r for r in rows if f"'{one}'" not in r]
    assert kept(now[0]) == kept(old[0]) and now[0] != old[0] and len(now[0]) == len(old[0]) + new[one][0] - done[one][0]


def test_positions_are_carried(spark, fx, tmp_path):
    root = str(tmp_path / "store")
    done = run(fx, root, limit=1)
    rows = commits.read_committed(spark, root, "lap_distance", ROWS)
    want = grids.project_distance_grid(*(df.where(F.col("session_id").isin(list(done))) for df in (fx.telemetry, fx.laps, fx.positions)), 5000.0, 14_400_000, 14_400_000)
    columns = [c.split()[0] for c in ROWS.split(", ")]
    assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert rows.where("x is not null and z = 0").count() > rows.count() / 2


def test_choice_of_sessions(spark):
    rows = [("a", 2023, "E2", "R"), ("b", 2024, "E2", "R"), ("c", 2024, "E1", "Q"), ("d", 2024, "E1", "R"), ("e", None, "E9", "R")]
    s = spark.createDataFrame(rows, "session_id string, year int, event_name string, session_type string")
    pick = lambda **k: {r["session_id"] for r in grids.choose_sessions(s, **k).collect()}
    assert pick() == set("abcde") and pick(year=2024) == set("bcd") and pick(session_type="r") == set("abde")
    assert pick(limit=2) == {"e", "c"} and pick(limit=3, session_type="R") == {"e", "d", "b"} and pick(ids=["a", "c"], year=2024) == {"a", "c"}


def test_sessions_without_parents_are_an_error(spark, fx, tmp_path):
    with pytest.raises(ValueError, match="2024-day"):
        backfill.run_backfill(str(tmp_path / "s"), fx.sessions, fx.drivers.limit(0), fx.telemetry, fx.laps, fx.positions, limit=1)


def test_rows_are_dealt_out_by_lap_and_ordered_once(spark, fx):
    """A session is no unit of work, and a lap's windows share one exchange and one order."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(grids.lap_distances(fx.telemetry))
    assert text.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", text)) == 1
    few = spark.createDataFrame(fx.sessions.select("session_id").limit(3).collect(), "session_id string")
    for df in grids.backfill_distance(few, fx.telemetry, fx.laps, fx.positions, 5000.0):
        # the list of sessions is made distinct by its key; samples, positions and laps go by lap
        by_session = [line for line in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df)) if re.fullmatch(r"session_id#\d+, \d+", line)]
        assert len(by_session) <= plan(df).count("HashAggregate(keys=[session_id#") // 2


def test_staged_rows_are_derived_once(spark, tmp_path):
    seen, kept = spark.sparkContext.accumulator(0), spark.sparkContext._jsc.getPersistentRDDs().size()

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr("concat('s', cast(id % 3 as string)) as session_id", "id").mapInArrow(count, "session_id string, id long")
    version = commits.stage({"t": rows}, str(tmp_path), {"t": ["id"]})
    assert seen.value == 1000 and spark.read.parquet(f"{tmp_path}/t/version={version}").count() == 1000
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
