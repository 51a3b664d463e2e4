"""Telemetry-shaped tables from the driver's ``events``, ``nation`` and ``region``: session = day, driver = user % 20, lap = four hours."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session(ts: str = "ts") -> str:
    return f"concat('2024-day', lpad(cast(day({ts}) as string), 2, '0'), '-r')"


_DRIVER = "concat('D', lpad(cast(user_id % 20 as string), 2, '0'))"
_LAP = "cast(floor(hour(ts) / 4) as int) + 1"
_TIME = "cast((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) as bigint) * 1000"


class Fixtures:
    """The fixture tables of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.events.selectExpr(
            "ts as sample_time_utc",
            f"{_session()} as session_id",
            f"{_DRIVER} as driver_code",
            "cast(user_id % 20 + 1 as int) as driver_number",
            f"{_LAP} as lap_number",
            f"{_TIME} as session_time_ms",
            f"{_TIME} - cast(floor(hour(ts) / 4) as bigint) * 14400000 as lap_time_ms",
            "case when event_id % 97 = 0 then null else value end as speed_kmh",
            "cast(regexp_extract(props, '[0-9]+', 0) as double) as throttle_pct",
            "cast((event_id * 7) % 101 as double) as brake_pct",
            "cast(event_id % 8 + 1 as int) as gear",
            "cast(4000 + (event_id * 13) % 8000 as double) as rpm",
            "cast(case when event_type = 'click' then 10 else 0 end as int) as drs",
            "event_id as source_sample_index",
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.events.where("event_id % 3 <> 0").selectExpr(
            "ts + interval 200 milliseconds as sample_time_utc",
            f"{_session()} as session_id",
            f"{_DRIVER} as driver_code",
            f"{_LAP} as lap_number",
            "cast((event_id * 37) % 2000 - 1000 as double) as x",
            "cast((event_id * 53) % 2000 - 1000 as double) as y",
            "cast(0 as double) as z",
            "case when event_type = 'error' then 'OffTrack' else 'OnTrack' end as track_status",
            "event_id as source_sample_index",
        )

    @cached_property
    def laps(self) -> DataFrame:
        grouped = self.telemetry.groupBy("session_id", "driver_code", "driver_number", "lap_number").agg(
            F.min("sample_time_utc").alias("lap_start_utc"),
            F.max("sample_time_utc").alias("lap_end_utc"),
            F.sum("source_sample_index").alias("s"),
            F.min("session_time_ms").alias("t0"),
            F.max("session_time_ms").alias("t1"),
        )
        stint = "case when lap_number <= 2 + driver_number % 3 then 1 else 2 end"
        return grouped.selectExpr(
            "concat(session_id, '-', lower(driver_code), '-', cast(lap_number as string)) as lap_id",
            "session_id",
            "driver_code",
            "lap_number",
            f"{stint} as stint_number",
            "lap_start_utc",
            "lap_end_utc",
            "cast(case when s % 29 = 0 then null else 14000000 + s % 400000 end as int) as lap_time_ms",
            "cast(4600000 + s % 9000 as int) as sector_1_ms",
            "cast(4700000 + s % 8000 as int) as sector_2_ms",
            "cast(case when s % 11 = 0 then null else 4700000 + s % 7000 end as int) as sector_3_ms",
            f"case (driver_number + {stint}) % 3 when 0 then 'SOFT' when 1 then 'MEDIUM' else 'HARD' end as compound",
            "case when lap_number <= 2 + driver_number % 3 then lap_number else lap_number - 2 - driver_number % 3 end as tyre_life",
            "lap_number = 3 + driver_number % 3 as is_pit_out_lap",
            "lap_number = 2 + driver_number % 3 as is_pit_in_lap",
            "(driver_number + lap_number * 3) % 19 = 0 as is_deleted",
            "case when (driver_number + lap_number) % 17 = 0 then null else (driver_number + lap_number) % 13 <> 0 end as is_accurate",
            "case when lap_number = 2 + driver_number % 3 then t1 end as pit_in_session_time_ms",
            "case when lap_number = 3 + driver_number % 3 then t0 end as pit_out_session_time_ms",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        by = self.telemetry.groupBy("session_id").agg(F.min("sample_time_utc").alias("t"))
        return by.selectExpr(
            "session_id",
            "2024 as year",
            "concat('Event ', substr(session_id, 9, 2)) as event_name",
            "concat('Circuit ', cast(cast(substr(session_id, 9, 2) as int) % 5 as string)) as circuit_name",
            "'Land' as country",
            "'R' as session_type",
            "date_trunc('day', t) as session_start_utc",
            "cast(null as timestamp) as session_end_utc",
        )

    @cached_property
    def drivers(self) -> DataFrame:
        own = self.telemetry.select("session_id", "driver_code", "driver_number").distinct()
        region = self.raw("region").select("r_regionkey", "r_name")
        joined = own.join(region, F.col("r_regionkey") == F.col("driver_number") % 5, "left")
        return joined.selectExpr(
            "session_id",
            "driver_code",
            "driver_number",
            "concat('Driver ', driver_code) as full_name",
            "r_name as team_name",
            "case when driver_number % 7 = 0 then null when driver_number % 9 = 0 then 0 else driver_number end as grid_position",
        )

    @cached_property
    def weather(self) -> DataFrame:
        i = "source_sample_index"
        return self.telemetry.where(f"{i} % 10 = 0").selectExpr(
            "session_id",
            "sample_time_utc",
            "session_time_ms",
            f"case when {i} % 130 = 0 then null else cast(20 + {i} % 15 as double) end as air_temp_c",
            f"cast(30 + {i} % 21 as double) as track_temp_c",
            f"cast(40 + {i} % 50 as double) as humidity_pct",
            f"cast(1000 + {i} % 12 as double) as pressure_mbar",
            f"case when {i} % 110 = 0 then null else {i} % 40 = 0 end as rainfall",
            f"cast({i} % 360 as int) as wind_direction_deg",
            f"cast({i} % 9 as double) as wind_speed_mps",
        )

    @cached_property
    def track_status(self) -> DataFrame:
        return self.telemetry.where("source_sample_index % 25 = 0").selectExpr(
            "session_id",
            "session_time_ms as event_time_ms",
            "case cast(floor(source_sample_index / 25) as int) % 6 when 0 then '1' when 1 then '2' when 2 then '4' when 3 then '5' when 4 then '6' else '7' end as status_code",
            "case when source_sample_index % 50 = 0 then null else 'status change' end as message",
        )

    @cached_property
    def race_control(self) -> DataFrame:
        i = "source_sample_index"
        return self.telemetry.where(f"{i} % 5 = 0").selectExpr(
            f"{i} as race_control_message_id",
            "session_id",
            "sample_time_utc as message_time_utc",
            f"case when {i} % 35 = 0 then null else session_time_ms end as session_time_ms",
            f"case {i} % 4 when 0 then 'Flag' when 1 then 'Drs' when 2 then 'Other' else null end as category",
            f"case {i} % 7 when 0 then 'YELLOW FLAG IN SECTOR 3' when 1 then concat('CAR ', cast(driver_number as string), ' SPIN AT TURN 4') when 2 then 'SAFETY CAR DEPLOYED' when 3 then 'DRS ENABLED' when 4 then concat('INCIDENT INVOLVING CAR ', cast(driver_number as string), ' NOTED') when 5 then concat('5 SECOND TIME PENALTY FOR CAR ', cast(driver_number as string)) else 'PIT EXIT OPEN' end as message",
            "cast(null as string) as status",
            f"case when {i} % 7 = 0 then 'YELLOW' end as flag",
            "'Track' as scope",
            "cast(null as string) as sector",
            f"case when {i} % 7 in (1, 4, 5) then driver_number end as racing_number",
            "lap_number",
        )

    @cached_property
    def markers(self) -> DataFrame:
        # nation has 25 rows, whatever the scale
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        return self.sessions.select("session_id").crossJoin(F.broadcast(nation)).selectExpr(
            "session_id",
            "case n_regionkey when 3 then 'marshal_light' when 4 then 'marshal_sector' else 'corner' end as marker_type",
            "n_nationkey as marker_number",
            "cast(null as string) as marker_letter",
            "cast(n_nationkey * 80 - 1000 as double) as x",
            "cast((n_nationkey * n_nationkey) % 2000 - 1000 as double) as y",
            "cast(n_nationkey * 15 as double) as angle_degrees",
            "case when n_nationkey = 24 then null else cast(n_nationkey * 220 as double) end as distance_m",
        )

    @cached_property
    def session_status(self) -> DataFrame:
        by = self.telemetry.groupBy("session_id").agg(F.min("session_time_ms").alias("t0"), F.max("session_time_ms").alias("t1"))
        return by.selectExpr("session_id", "stack(2, t0, 'Started', t1, 'Finished') as (event_time_ms, status)")

    @cached_property
    def circuits(self) -> DataFrame:
        return self.sessions.selectExpr("session_id", "cast(cast(substr(session_id, 9, 2) as int) as double) as rotation_degrees", "'fixture' as source")

    @cached_property
    def aligned(self) -> DataFrame:
        """Samples shaped like the ten-hertz table, with quality flags."""
        return self.telemetry.selectExpr(
            "session_id",
            "driver_code",
            "driver_number",
            "sample_time_utc",
            "session_time_ms",
            "lap_number",
            "speed_kmh",
            "case when source_sample_index % 6 = 0 then array('CAR_GAP_TOO_LARGE', 'LOCATION_GAP_TOO_LARGE') when source_sample_index % 7 = 0 then array('LOCATION_SAMPLE_TOO_OLD') when source_sample_index % 11 = 0 then array('CAR_SAMPLE_TOO_OLD') when source_sample_index % 13 = 0 then array('MISSING_LOCATION_DATA') else array('OK') end as quality_flags",
        )

    @cached_property
    def distance(self) -> DataFrame:
        """Samples shaped like the distance table: a row for each lap and 100 m."""
        laps = self.laps.select("session_id", "driver_code", "lap_number", F.coalesce("lap_time_ms", F.lit(14000000)).cast("long").alias("total"))
        steps = laps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
        return steps.selectExpr(
            "session_id",
            "driver_code",
            "lap_number",
            "cast(k * 100 as double) as distance_m",
            "cast(k as double) / 10 as lap_progress",
            "cast(total * k / 10 as double) as elapsed_ms",
            "cast((total + k * 37) % 300 as double) as speed_kmh",
            "cast((total + k * 11) % 101 as double) as throttle_pct",
            "cast((total + k * 7) % 101 as double) as brake_pct",
        )
