"""Windows over ordered rows: periods, runs of like samples, segments, ranks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import FAMILIES, quality_family
from .aggregates import check_range
from .joins import nearest_corner, track_status_periods, window_start_position
from .lookups import top_n

#: Conditions of the detectable windows.
EVENTS = {"hard_braking": "brake_pct >= 80", "high_speed": "speed_kmh >= 300", "drs_active": "drs > 0", "throttle_lift": "throttle_pct <= 10 and speed_kmh >= 150"}


def _islands(rows: DataFrame, by: list[str], order: list, condition: Column) -> DataFrame:
    """Rows that meet the condition, with ``island``: the number of the run of neighbours that do. Null: not met."""
    met = F.coalesce(condition, F.lit(False))
    w = Window.partitionBy(*by).orderBy(*order)
    starts = met & ~F.coalesce(F.lag(met).over(w), F.lit(False))
    numbered = rows.withColumn("_met", met).withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_met").drop("_met")


def _source_order(rows: DataFrame) -> list[str]:
    """What orders samples at one time, where the table has it."""
    return [c for c in ["source_sample_index"] if c in rows.columns]


def _run_columns(at: Column) -> list[Column]:
    return [
        F.min_by("speed_kmh", at).alias("entry_speed_kmh"),
        F.min("speed_kmh").alias("minimum_speed_kmh"),
        F.max("speed_kmh").alias("max_speed_kmh"),
        F.max_by("speed_kmh", at).alias("exit_speed_kmh"),
        F.max("brake_pct").alias("max_brake_pct"),
        F.avg("throttle_pct").alias("avg_throttle_pct"),
    ]


def detect_windows(samples: DataFrame, event: str, positions: DataFrame | None = None, markers: DataFrame | None = None, drivers: list[str] | None = None, lap_from: int | None = None, lap_to: int | None = None, min_ms: int = 250, limit: int | None = None) -> DataFrame:
    """Runs of samples of a driver that meet an event's condition, at least ``min_ms`` long; they may span laps. With ``limit`` the first so many of a session.

    Entry and exit speed are the first and last, null or not. With positions and markers, the nearest
    corner of the run's first sample; of several positions at its time the one nearest to a corner. Of
    samples at one time the first by source order comes first, where the table has it.
    """
    if event not in EVENTS:
        raise ValueError(f"event must be one of {list(EVENTS)}")
    check_range("min_ms", min_ms, 0, 10_000)
    if limit is not None:
        check_range("limit", limit, 1, 5000)
    rows = samples.where("session_time_ms is not null")
    if drivers:
        rows = rows.where(F.col("driver_code").isin(drivers))
    if lap_from is not None:
        rows = rows.where(F.col("lap_number") >= lap_from)
    if lap_to is not None:
        rows = rows.where(F.col("lap_number") <= lap_to)
    keys = ["session_id", "driver_code"]
    order = ["session_time_ms", "sample_time_utc", *_source_order(rows)]
    runs = _islands(rows, keys, order, F.expr(EVENTS[event]))
    at = F.struct(*order)
    out = runs.groupBy(*keys, "island").agg(F.min("sample_time_utc").alias("start_sample_time_utc"), F.min("lap_number").alias("lap_number"), F.min("session_time_ms").alias("start_session_time_ms"), F.max("session_time_ms").alias("end_session_time_ms"), F.min("lap_time_ms").alias("start_lap_time_ms"), F.max("lap_time_ms").alias("end_lap_time_ms"), *_run_columns(at))
    out = out.withColumn("duration_ms", F.col("end_session_time_ms") - F.col("start_session_time_ms")).where(F.col("duration_ms") >= min_ms)
    if positions is not None and markers is not None:
        near = Window.partitionBy(*keys, "island").orderBy(*(F.col(c).asc_nulls_last() for c in ("distance_to_corner", "marker_number", "x", "y")))
        out = nearest_corner(window_start_position(out, positions), markers).withColumn("_r", F.row_number().over(near)).where("_r = 1").drop("_r")
    if limit is not None:
        # two runs of a driver may begin in one millisecond
        out = top_n(out, ["session_id"], ["start_session_time_ms", "driver_code", "island"], limit)
    return out.drop("island")


def braking_zones(samples: DataFrame, threshold: float = 80, min_ms: int = 250) -> DataFrame:
    """Runs of a lap's samples with brake at or over ``threshold``, at least ``min_ms`` long, numbered from 1 within the lap."""
    check_range("threshold", int(threshold), 1, 100)
    check_range("min_ms", min_ms, 0, 10_000)
    keys = ["session_id", "driver_code", "lap_number"]
    order = ["lap_time_ms", "sample_time_utc", *_source_order(samples)]
    runs = _islands(samples.where("lap_time_ms is not null"), keys, order, F.col("brake_pct") >= threshold)
    at = F.struct(*order)
    out = runs.groupBy(*keys, "island").agg(F.min("lap_time_ms").alias("start_lap_time_ms"), F.max("lap_time_ms").alias("end_lap_time_ms"), *_run_columns(at))
    out = out.withColumn("duration_ms", F.col("end_lap_time_ms") - F.col("start_lap_time_ms")).where(F.col("duration_ms") >= min_ms)
    return out.withColumn("zone_index", F.row_number().over(Window.partitionBy(*keys).orderBy("start_lap_time_ms"))).drop("island")


def degraded_segments(aligned: DataFrame, gap_ms: int = 150, sample_ms: int = 100) -> DataFrame:
    """Rows whose quality is not OK, joined while neighbours are at most ``gap_ms`` apart.

    Duration is from first to last row and one sample. The dominant family is the most frequent one;
    of equals the first by priority.
    """
    keys = ["session_id", "driver_code"]
    rows = aligned.withColumn("family", quality_family(F.col("quality_flags"))).where("family <> 'OK'")
    w = Window.partitionBy(*keys).orderBy("session_time_ms")
    new = F.coalesce((F.col("session_time_ms") - F.lag("session_time_ms").over(w) > gap_ms).cast("int"), F.lit(1))
    rows = rows.withColumn("segment", F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    names = [v for _, v in FAMILIES if v != "OK"] + ["other_unknown"]
    out = rows.groupBy(*keys, "segment").agg(F.min("session_time_ms").alias("start_ms"), F.max("session_time_ms").alias("end_ms"), F.count(F.lit(1)).alias("samples"), *(F.count_if(F.col("family") == n).alias(n) for n in names))
    best = F.greatest(*names)
    dominant = F.coalesce(*(F.when(F.col(n) == best, n) for n in names))
    return out.withColumns({"duration_ms": F.greatest(F.col("end_ms") - F.col("start_ms") + sample_ms, F.lit(sample_ms)), "dominant_family": dominant}).drop("segment")


def _ranked(laps: DataFrame) -> DataFrame:
    kept = laps.where("not is_deleted and lap_start_utc is not null")
    return kept.withColumn("position", F.rank().over(Window.partitionBy("session_id", "lap_number").orderBy("lap_start_utc")))


def lap_positions(laps: DataFrame, lap_from: int | None = None, lap_to: int | None = None) -> DataFrame:
    """Per driver the positions on laps from..to by lap start (equal starts share one), null where there is no lap."""
    rows = _ranked(laps).select("session_id", "driver_code", "lap_number", "position")
    if lap_from is not None:
        rows = rows.where(F.col("lap_number") >= lap_from)
    if lap_to is not None:
        rows = rows.where(F.col("lap_number") <= lap_to)
    span = rows.groupBy("session_id").agg(F.lit(lap_from if lap_from is not None else 1).alias("from_lap"), F.lit(lap_to).cast("int").alias("t") if lap_to is not None else F.max("lap_number").alias("t"))
    by = rows.groupBy("session_id", "driver_code").agg(F.map_from_entries(F.collect_list(F.struct("lap_number", "position"))).alias("m"))
    joined = by.join(span.withColumnRenamed("t", "to_lap"), "session_id")
    return joined.select("session_id", "driver_code", "from_lap", "to_lap", F.transform(F.sequence("from_lap", "to_lap"), lambda k: F.try_element_at("m", k.cast("int"))).alias("positions"))


def lap_gap_features(samples: DataFrame) -> DataFrame:
    """Per lap, in source order: steps back in time, steps back in lap time, greatest and 95th percentile gap."""
    keys = ["session_id", "driver_code", "lap_number"]
    w = Window.partitionBy(*keys).orderBy("source_sample_index")
    rows = samples.withColumns({"d": (F.unix_micros("sample_time_utc") - F.lag(F.unix_micros("sample_time_utc")).over(w)) / 1000.0, "l": F.col("lap_time_ms") - F.lag("lap_time_ms").over(w)})
    return rows.groupBy(*keys).agg(F.count_if(F.col("d") < 0).alias("car_out_of_order_steps"), F.count_if(F.col("l") < 0).alias("car_lap_time_negative_steps"), F.max(F.when(F.col("d") > 0, F.col("d"))).alias("car_max_gap_ms"), F.percentile(F.when(F.col("d") > 0, F.col("d")), 0.95).alias("car_p95_gap_ms"))


def position_step_features(positions: DataFrame) -> DataFrame:
    """Per lap: samples, path length, greatest and 95th percentile step, and rows without x or y."""
    keys = ["session_id", "driver_code", "lap_number"]
    w = Window.partitionBy(*keys).orderBy("sample_time_utc", "source_sample_index")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return positions.withColumn("s", step).groupBy(*keys).agg(F.count(F.lit(1)).alias("position_samples"), F.sum("s").alias("position_path_length_units"), F.max("s").alias("position_max_segment_units"), F.percentile("s", 0.95).alias("position_p95_segment_units"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("position_xy_nulls"))


def _weather_window():
    return Window.partitionBy("session_id").orderBy("session_time_ms", "sample_time_utc")


def weather_cadence(weather: DataFrame, max_gap_ms: float = 180_000) -> DataFrame:
    """Per session: gaps between samples, greatest jumps (wind around the circle), changes of rain, and whether jumps are large."""
    w = _weather_window()
    jump = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    turn = jump("wind_direction_deg")
    rows = weather.withColumns({"gap": F.col("session_time_ms") - F.lag("session_time_ms").over(w), "air": jump("air_temp_c"), "track": jump("track_temp_c"), "humid": jump("humidity_pct"), "press": jump("pressure_mbar"), "speed": jump("wind_speed_mps"), "wind": F.least(turn, 360 - turn), "rain": _rain_changed(w)})
    out = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), F.percentile("gap", 0.5).alias("median_gap_ms"), F.max("gap").alias("max_gap_ms"), F.max("air").alias("max_air_jump"), F.max("track").alias("max_track_jump"), F.max("humid").alias("max_humidity_jump"), F.max("press").alias("max_pressure_jump"), F.max("speed").alias("max_wind_speed_jump"), F.max("wind").alias("max_wind_turn_deg"), F.count_if("rainfall").alias("rain_samples"), F.count_if("rain").alias("rain_transitions"))
    over = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    return out.withColumns({"large_gap_flag": over("max_gap_ms", max_gap_ms), "temperature_jump_flag": over("max_air_jump", 5) | over("max_track_jump", 8), "pressure_jump_flag": over("max_pressure_jump", 5), "humidity_jump_flag": over("max_humidity_jump", 20), "wind_jump_flag": over("max_wind_speed_jump", 5) | over("max_wind_turn_deg", 90)})


def _rain_changed(w) -> Column:
    """Differs from the sample before; null after a value is a change, anything after null is not."""
    before = F.lag("rainfall").over(w)
    return before.isNotNull() & (F.col("rainfall").isNull() | (F.col("rainfall") != before))


def rain_transitions(weather: DataFrame) -> DataFrame:
    w = _weather_window()
    return weather.withColumns({"changed": _rain_changed(w), "previous_rainfall": F.lag("rainfall").over(w)}).where("changed").select("session_id", "session_time_ms", "previous_rainfall", "rainfall")


def status_intervals(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Status periods whose last ends with the session (session_id, duration_ms); durations are 0 at least."""
    rows = track_status_periods(events).join(durations, "session_id", "left")
    end = F.coalesce("end_time_ms", "duration_ms")
    return rows.select("session_id", "status_code", "status_name", "start_time_ms", end.alias("end_time_ms"), F.greatest(end - F.col("start_time_ms"), F.lit(0)).alias("interval_ms"))


def weather_max_gap(weather: DataFrame) -> DataFrame:
    gap = F.col("session_time_ms") - F.lag("session_time_ms").over(_weather_window())
    return weather.withColumn("gap", gap).groupBy("session_id").agg(F.max("gap").alias("weather_max_gap_ms"))
