"""Readers and writers of the library's tables: Parquet folders of sessions and drivers."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the stored tables.
SCHEMAS = {
    "sessions": "session_id string, year int, event_name string, circuit_name string, country string, session_type string, session_start_utc timestamp, session_end_utc timestamp",
    "session_drivers": "session_id string, driver_code string, driver_number int, full_name string, team_name string, grid_position int",
    "laps": "session_id string, lap_id string, driver_code string, lap_number int, stint_number int, lap_start_utc timestamp, lap_end_utc timestamp, lap_time_ms int, sector_1_ms int, sector_2_ms int, sector_3_ms int, compound string, tyre_life int, is_pit_out_lap boolean, is_pit_in_lap boolean, is_deleted boolean, is_accurate boolean, pit_in_session_time_ms long, pit_out_session_time_ms long",
    "telemetry_samples": "session_id string, sample_time_utc timestamp, driver_code string, driver_number int, lap_number int, session_time_ms long, lap_time_ms long, speed_kmh double, throttle_pct double, brake_pct double, gear int, rpm double, drs int, source_sample_index long",
    "position_samples": "session_id string, sample_time_utc timestamp, driver_code string, lap_number int, x double, y double, z double, track_status string, source_sample_index long",
    "weather_samples": "session_id string, sample_time_utc timestamp, session_time_ms long, air_temp_c double, track_temp_c double, humidity_pct double, pressure_mbar double, rainfall boolean, wind_direction_deg int, wind_speed_mps double",
    "track_status_events": "session_id string, event_time_ms long, status_code string, message string",
    "session_status_events": "session_id string, event_time_ms long, status string",
    "race_control_messages": "session_id string, race_control_message_id long, message_time_utc timestamp, session_time_ms long, category string, message string, status string, flag string, scope string, sector string, racing_number int, lap_number int",
    "circuit_metadata": "session_id string, rotation_degrees double, source string",
    "circuit_markers": "session_id string, marker_type string, marker_number int, marker_letter string, x double, y double, angle_degrees double, distance_m double",
    "aligned_telemetry": "session_id string, driver_code string, sample_time_utc timestamp, session_time_ms long, lap_number int, lap_time_ms long, speed_kmh double, rpm double, throttle_pct double, gear int, brake_pct double, drs int, x double, y double, z double, track_status string, car_age_ms long, location_age_ms long, quality_flags array<string>",
    "lap_distance": "session_id string, driver_code string, lap_number int, distance_m double, lap_progress double, elapsed_ms double, speed_kmh double, throttle_pct double, brake_pct double, rpm double, gear int, drs int, x double, y double, z double, quality_flags array<string>",
    "lap_quality": "session_id string, driver_code string, lap_number int, lap_time_ms long, covered_ms long, final_distance_m double, quality_status string, quality_messages array<string>",
    "ingestion_diagnostics": "session_id string, driver_code string, stream string, samples long, first_time_utc timestamp, last_time_utc timestamp, median_delta_ms double, max_delta_ms double, frequency_hz double, duplicates long, out_of_order long, warning_flags array<string>",
}
MODES = ("fail", "replace", "upsert")
#: Folders that a session's drivers are dealt to, and the column that names them.
DRIVER_BUCKETS, BUCKET = 16, "driver_bucket"
#: What files are ordered by within a folder, as far as a table has it.
CLUSTERED = ("driver_code", "lap_number", "distance_m", "session_time_ms", "event_time_ms", "sample_time_utc")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a temporary one on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lapforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/lapforge/{name}-{uuid.uuid4().hex}"


def read_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Typed scans of the stored tables; filters on session_id prune partitions."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in names or SCHEMAS}


def driver_bucket(code: Column) -> Column:
    """The folder of a driver's rows within a session; rows without a driver have one as well."""
    return F.pmod(F.xxhash64(code), F.lit(DRIVER_BUCKETS)).cast("int")


def read_rows(spark: SparkSession, path: str, name: str, sessions: list[str] | None = None, drivers: list[str] | None = None, laps: list[int] | None = None) -> DataFrame:
    """A stored table's rows of some sessions, drivers and laps: only folders that can hold them are opened, and row groups skipped by their statistics."""
    columns = spark.createDataFrame([], SCHEMAS[name]).columns
    known = "driver_code" in columns
    rows = spark.read.schema(SCHEMAS[name] + (f", {BUCKET} int" if known else "")).parquet(f"{path}/{name}")
    for column, values in (("session_id", sessions), ("driver_code", drivers), ("lap_number", laps)):
        if values is not None and column in columns:
            rows = rows.where(F.col(column).isin(values))
    if drivers is not None and known:
        # literals, which Spark folds, so that folders are left out before the scan
        rows = rows.where(F.col(BUCKET).isin([driver_bucket(F.lit(d)) for d in drivers]))
    return rows.select(columns)


def _bucket_files(spark: SparkSession, path: str, sessions: list[str | None]) -> dict[str, set[str]]:
    """Files of each driver folder of the sessions."""
    jvm, out = spark._jvm, {}
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in sessions:
        name = "__HIVE_DEFAULT_PARTITION__" if s is None else jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(s)
        top = jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={name}")
        for folder in files.listStatus(top) if files.exists(top) else []:
            if folder.isDirectory():
                out[folder.getPath().toString()] = {f.getPath().getName() for f in files.listStatus(folder.getPath())}
    return out


def write_session(df: DataFrame, path: str, mode: str = "fail", keys: list[str] | None = None) -> None:
    """Write a table's sessions. fail: none may be there. replace: each is overwritten whole. upsert: rows merge by ``keys``, of which nulls are equal.

    Rows are cut by ranges of session, driver, lap and time, so a large session is written by many
    tasks and each file holds a short range of them. Tables with drivers lie in folders of session and
    driver bucket, which :func:`read_rows` picks from. Tables that have to change together go through :mod:`.commits`.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    own = df.select("session_id").distinct()
    if there:
        old = spark.read.schema(df.schema).parquet(path)
        written = own.withColumnRenamed("session_id", "_own")
        old = old.join(written, F.col("session_id").eqNullSafe(F.col("_own")), "left_semi")
        if mode == "fail" and not old.isEmpty():
            raise ValueError("sessions are already stored")
        if mode == "upsert":
            if not keys:
                raise ValueError("upsert needs keys")
            new = df.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
            same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
            df = df.unionByName(old.join(new, same, "left_anti").select(df.columns))
    folders = ["session_id"]
    if "driver_code" in df.columns:
        df, folders = df.withColumn(BUCKET, driver_bucket(F.col("driver_code"))), [*folders, BUCKET]
    # one row a session that is written
    sessions = [r[0] for r in own.collect()] if there and len(folders) > 1 else []
    before = _bucket_files(spark, path, sessions)
    order = [*folders, *(c for c in CLUSTERED if c in df.columns)]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*folders).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    # folders of these sessions that the new rows have none for
    for folder, kept in _bucket_files(spark, path, sessions).items():
        if before.get(folder) == kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save_table(df: DataFrame, path: str) -> None:
    """A report table as Parquet and as CSV with a header; arrays become text there."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    flat = df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
