"""Stored tables: what a lookup opens, how large sessions are written, and merges with null keys."""

import pytest
from pyspark.sql import functions as F

from lapforge.operators.lookups import lap_telemetry, replay_chunk_raw
from lapforge.sources import tables
from lapforge.sources.fixtures import Fixtures


def scan(df, metric):
    """A metric of the only file scan of a query, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if hasattr(plan, "executedPlan") and "Adaptive" in plan.getClass().getName():
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if "QueryStage" in p.getClass().getName():
            todo.append(p.plan())
        elif p.children().isEmpty() and "FileSourceScan" in p.getClass().getName():
            found.append(p.metrics().apply(metric).value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    assert len(found) == 1
    return found[0]


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    fx, root = Fixtures(spark, sf_dir), str(tmp_path_factory.mktemp("tables"))
    for name, df in (("telemetry_samples", fx.telemetry), ("position_samples", fx.positions)):
        tables.write_session(df.select(spark.createDataFrame([], tables.SCHEMAS[name]).columns), f"{root}/{name}")
    return fx, root


def test_a_lap_opens_few_files(spark, stored):
    fx, root = stored
    every = scan(tables.read_rows(spark, root, "telemetry_samples"), "numFiles")
    one = fx.telemetry.groupBy("session_id", "driver_code", "lap_number").count().orderBy(F.desc("count"), "session_id").first()
    rows = tables.read_rows(spark, root, "telemetry_samples", [one["session_id"]], [one["driver_code"]], [one["lap_number"]])
    opened = scan(rows, "numFiles")
    assert 1 <= opened < 0.05 * every
    assert rows.count() == one["count"] and scan(rows, "numOutputRows") <= scan(tables.read_rows(spark, root, "telemetry_samples", [one["session_id"]]), "numOutputRows") / 2
    # the lookups give what they give on the whole table
    pick = lambda df: sorted(r[0] for r in df.where((F.col("session_id") == one["session_id"]) & (F.col("driver_code") == one["driver_code"]) & (F.col("lap_number") == one["lap_number"])).select("source_sample_index").collect())
    assert pick(lap_telemetry(rows, every=2)) == pick(lap_telemetry(fx.telemetry, every=2)) != []


def test_a_chunk_opens_its_drivers_files(spark, stored):
    fx, root = stored
    one = fx.telemetry.select("session_id").orderBy("session_id").first()[0]
    s, p = (tables.read_rows(spark, root, n, [one], ["D03", "D07"]) for n in ("telemetry_samples", "position_samples"))
    got = replay_chunk_raw(s, p, 0, 86_400_000, 2).select("source_sample_index", "x")
    own = [df.where((F.col("session_id") == one) & F.col("driver_code").isin("D03", "D07")) for df in (fx.telemetry, fx.positions)]
    want = replay_chunk_raw(*own, 0, 86_400_000, 2).select("source_sample_index", "x")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert scan(s, "numFiles") <= 0.25 * scan(tables.read_rows(spark, root, "telemetry_samples", [one]), "numFiles")


def test_a_large_session_is_many_tasks(spark, tmp_path):
    rows = spark.range(400_000).select(F.lit("one").alias("session_id"), F.lit("A").alias("driver_code"), (F.col("id") / 4000).cast("int").alias("lap_number"), F.col("id").alias("session_time_ms"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        tables.write_session(rows, str(tmp_path / "t"))
    finally:
        for k in small:
            spark.conf.unset(k)
    read = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("session_time_ms").alias("a"), F.max("session_time_ms").alias("b")).orderBy("a").collect()
    assert len(read) >= 3 and max(r["n"] for r in read) < 200_000
    # files hold ranges that do not overlap
    assert all(x["b"] < y["a"] for x, y in zip(read, read[1:]))


LAP = "session_id string, driver_code string, lap_number int, v int"


def stored_rows(spark, path):
    return sorted(map(tuple, spark.read.schema(LAP).parquet(path).select("session_id", "driver_code", "lap_number", "v").collect()), key=str)


def test_null_keys_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), LAP)
    tables.write_session(rows(("s", "A", 1, 1), ("s", None, 1, 2), ("s", "A", None, 3), (None, "A", 1, 4), (None, "A", 2, 5)), path)
    for _ in range(2):
        tables.write_session(rows(("s", None, 1, 20), ("s", "A", None, 30), (None, "A", 1, 40)), path, "upsert", ["session_id", "driver_code", "lap_number"])
        assert set(stored_rows(spark, path)) == {("s", "A", 1, 1), ("s", None, 1, 20), ("s", "A", None, 30), (None, "A", 1, 40), (None, "A", 2, 5)}
        assert len(stored_rows(spark, path)) == 5


def test_replace_leaves_no_driver_of_before(spark, tmp_path):
    path = str(tmp_path / "t")
    drivers = [f"D{k}" for k in range(40)]
    tables.write_session(spark.createDataFrame([(s, d, 1, 0) for s in ("a/b", "c") for d in drivers], LAP), path)
    tables.write_session(spark.createDataFrame([("a/b", "D1", 1, 5)], LAP), path, "replace")
    assert [r for r in stored_rows(spark, path) if r[0] == "a/b"] == [("a/b", "D1", 1, 5)] and len(stored_rows(spark, path)) == 41
    # the only row of a driver moves to another one
    tables.write_session(spark.createDataFrame([("a/b", "D2", 1, 6)], LAP), path, "upsert", ["session_id", "lap_number"])
    assert [r for r in stored_rows(spark, path) if r[0] == "a/b"] == [("a/b", "D2", 1, 6)]
