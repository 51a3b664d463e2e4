"""Aggregations over samples, laps, stints, weather, messages and quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import quality_family, time_bucket
from .joins import asof_status

GROUPS = {"driver": ["driver_code"], "lap": ["lap_number"], "stint": ["stint_number"], "compound": ["compound"], "track_status": ["track_status"], "time_bucket": ["bucket_start_ms", "bucket_end_ms"]}
METRICS = ["sample_count", "avg_speed_kmh", "max_speed_kmh", "avg_throttle_pct", "avg_brake_pct", "brake_time_ms", "drs_active_time_ms", "throttle_lift_count", "high_speed_time_ms"]


def check_range(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def aggregate_telemetry(samples: DataFrame, laps: DataFrame, events: DataFrame | None = None, group_by: list[str] = ("driver",), metrics: list[str] | None = None, drivers: list[str] | None = None, lap_from: int | None = None, lap_to: int | None = None, compounds: list[str] | None = None, exclude_pit_laps: bool = False, statuses: list[str] | None = None, bucket_ms: int | None = None, duration_cap_ms: int = 2000) -> DataFrame:
    """Metrics of samples per session and chosen groups.

    A sample lasts to the driver's next one, at most ``duration_cap_ms``; the last lasts 0. Filters on
    drivers, laps, compounds and pit laps choose the samples between which durations are taken; the
    one on track status comes after. Without it or grouping by it, no status is joined.
    """
    if unknown := [g for g in group_by if g not in GROUPS]:
        raise ValueError(f"unknown groups: {unknown}")
    if unknown := [m for m in metrics or [] if m not in METRICS]:
        raise ValueError(f"unknown metrics: {unknown}")
    if bucket_ms is not None:
        check_range("bucket_ms", bucket_ms, 1, 7_200_000)
    rows = samples.where("session_time_ms is not null")
    if drivers:
        rows = rows.where(F.col("driver_code").isin(drivers))
    if lap_from is not None:
        rows = rows.where(F.col("lap_number") >= lap_from)
    if lap_to is not None:
        rows = rows.where(F.col("lap_number") <= lap_to)
    keys = ["session_id", "driver_code", "lap_number"]
    rows = rows.join(laps.select(*keys, "stint_number", "compound", "is_pit_in_lap", "is_pit_out_lap"), keys, "left")
    if compounds:
        rows = rows.where(F.col("compound").isin(compounds))
    if exclude_pit_laps:
        rows = rows.where("not coalesce(is_pit_in_lap, false) and not coalesce(is_pit_out_lap, false)")
    after = Window.partitionBy("session_id", "driver_code").orderBy("session_time_ms", "sample_time_utc")
    lasts = F.coalesce(F.lead("session_time_ms").over(after) - F.col("session_time_ms"), F.lit(0))
    rows = rows.withColumn("lasts", F.least(F.greatest(lasts, F.lit(0)), F.lit(duration_cap_ms)).cast("long"))
    if "track_status" in group_by or statuses:
        rows = asof_status(rows, events)
    else:
        rows = rows.withColumn("track_status", F.lit("not_requested"))
    if statuses:
        rows = rows.where(F.col("track_status").isin(statuses))
    columns = [c for g in group_by for c in GROUPS[g]]
    if bucket_ms:
        start = time_bucket(F.col("session_time_ms"), bucket_ms)
        rows = rows.withColumns({"bucket_start_ms": start, "bucket_end_ms": start + bucket_ms})
        columns += [c for c in GROUPS["time_bucket"] if c not in columns]
    time = lambda condition: F.sum(F.when(condition, F.col("lasts")).otherwise(0)).cast("long")
    every = {
        "sample_count": F.count(F.lit(1)),
        "avg_speed_kmh": F.avg("speed_kmh"),
        "max_speed_kmh": F.max("speed_kmh"),
        "avg_throttle_pct": F.avg("throttle_pct"),
        "avg_brake_pct": F.avg("brake_pct"),
        "brake_time_ms": time(F.col("brake_pct") >= 80),
        "drs_active_time_ms": time(F.col("drs") > 0),
        "throttle_lift_count": F.count_if((F.col("throttle_pct") <= 10) & (F.col("speed_kmh") >= 150)),
        "high_speed_time_ms": time(F.col("speed_kmh") >= 300),
    }
    return rows.groupBy("session_id", *columns).agg(*(every[m].alias(m) for m in metrics or METRICS))


def lap_summaries(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Laps with peak and mean speed, mean throttle and brake, and their number of samples (0 kept)."""
    keys = ["session_id", "driver_code", "lap_number"]
    by = samples.groupBy(*keys).agg(F.max("speed_kmh").alias("max_speed_kmh"), F.avg("speed_kmh").alias("avg_speed_kmh"), F.avg("throttle_pct").alias("avg_throttle_pct"), F.avg("brake_pct").alias("avg_brake_pct"), F.count(F.lit(1)).alias("telemetry_samples"))
    return laps.join(by, keys, "left").fillna(0, ["telemetry_samples"])


def stint_summaries(laps: DataFrame) -> DataFrame:
    """Per driver, stint and compound: lap range, laps, tyre life and lap times. Deleted laps count."""
    return laps.where("stint_number is not null").groupBy("session_id", "driver_code", "stint_number", "compound").agg(F.min("lap_number").alias("first_lap"), F.max("lap_number").alias("last_lap"), F.count(F.lit(1)).alias("laps"), F.min("tyre_life").alias("min_tyre_life"), F.max("tyre_life").alias("max_tyre_life"), F.avg("lap_time_ms").alias("avg_lap_time_ms"), F.min("lap_time_ms").alias("best_lap_time_ms"), F.max("lap_time_ms").alias("worst_lap_time_ms"))


def weather_summary(weather: DataFrame) -> DataFrame:
    """Per session: ranges and means of the channels, mean wind, and whether it rained (null counts as dry)."""
    parts = [f(c).alias(f"{n}_{c}") for c in ("air_temp_c", "track_temp_c", "humidity_pct", "pressure_mbar") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return weather.groupBy("session_id").agg(*parts, F.avg("wind_speed_mps").alias("avg_wind_speed_mps"), F.bool_or(F.coalesce("rainfall", F.lit(False))).alias("any_rain"))


def analyze_stints(laps: DataFrame, min_laps: int = 3, include_pit_laps: bool = False) -> DataFrame:
    """Stints of timed, kept laps with at least ``min_laps``, and the least-squares slope of lap time over laps."""
    check_range("min_laps", min_laps, 1, 100)
    rows = laps.where("not is_deleted and lap_time_ms is not null and stint_number is not null")
    if not include_pit_laps:
        rows = rows.where("not is_pit_in_lap and not is_pit_out_lap")
    out = stint_summaries(rows).where(F.col("laps") >= min_laps)
    slope = rows.groupBy("session_id", "driver_code", "stint_number", "compound").agg(F.regr_slope("lap_time_ms", "lap_number").alias("slope_ms_per_lap"))
    return out.join(slope, ["session_id", "driver_code", "stint_number", "compound"])


def session_facts(sessions: DataFrame, drivers: DataFrame, laps: DataFrame, samples: DataFrame, events: DataFrame, weather: DataFrame) -> DataFrame:
    """One row a session: drivers, race length, safety periods, fastest lap, top speed, peak track temperature and rain. Ties by driver, then lap."""
    kept = laps.where("not is_deleted")
    n = drivers.groupBy("session_id").agg(F.count(F.lit(1)).alias("driver_count"))
    length = kept.groupBy("session_id").agg(F.max("lap_number").alias("race_laps"))
    codes = events.groupBy("session_id").agg(F.count_if(F.col("status_code") == "4").alias("safety_cars"), F.count_if(F.col("status_code") == "5").alias("red_flags"), F.count_if(F.col("status_code") == "6").alias("virtual_safety_cars"))
    fast = kept.where("lap_time_ms is not null").groupBy("session_id").agg(F.min(F.struct("lap_time_ms", "driver_code", "lap_number")).alias("f"))
    top = samples.where("speed_kmh is not null").groupBy("session_id", "driver_code").agg(F.max("speed_kmh").alias("v")).groupBy("session_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "driver_code")).alias("t"))
    wet = weather.groupBy("session_id").agg(F.max("track_temp_c").alias("peak_track_temp_c"), F.bool_or(F.coalesce("rainfall", F.lit(False))).alias("any_rain"))
    out = sessions.select("session_id")
    for part in (n, length, codes, fast, top, wet):
        out = out.join(part, "session_id", "left")
    out = out.fillna(0, ["driver_count", "safety_cars", "red_flags", "virtual_safety_cars"])
    return out.select("session_id", "driver_count", "race_laps", "safety_cars", "red_flags", "virtual_safety_cars", F.col("f.driver_code").alias("fastest_driver"), F.col("f.lap_number").alias("fastest_lap"), F.col("f.lap_time_ms").alias("fastest_lap_ms"), F.col("t.driver_code").alias("top_speed_driver"), (-F.col("t.v")).alias("top_speed_kmh"), "peak_track_temp_c", "any_rain")


WEATHER_CHANNELS = ("air_temp_c", "track_temp_c", "humidity_pct", "pressure_mbar", "wind_speed_mps")


def weather_trend(weather: DataFrame, start_ms: int | None = None, duration_ms: int | None = None) -> DataFrame:
    """Per session and channel: first, last, least, greatest and mean value and last - first. First and last may be null."""
    rows = weather
    if start_ms is not None:
        rows = rows.where(F.col("session_time_ms") >= start_ms)
        if duration_ms is not None:
            rows = rows.where(F.col("session_time_ms") < start_ms + duration_ms)
    at = F.struct("session_time_ms", "sample_time_utc")
    long = rows.select("session_id", at.alias("at"), F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in WEATHER_CHANNELS))).alias("x")).select("session_id", "at", "x.*")
    return long.groupBy("session_id", "channel").agg(F.count(F.lit(1)).alias("samples"), F.min_by("v", "at").alias("first_value"), F.max_by("v", "at").alias("last_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg("v").alias("avg_value")).withColumn("delta", F.col("last_value") - F.col("first_value"))


def message_buckets(messages: DataFrame) -> DataFrame:
    """Counts of messages by category, flag and status, per session. Values differ in more than case; blanks are left out."""
    long = messages.select("session_id", F.explode(F.array(*(F.struct(F.lit(c).alias("bucket"), F.col(c).alias("value")) for c in ("category", "flag", "status")))).alias("x")).select("session_id", "x.*")
    return long.where("trim(value) <> ''").groupBy("session_id", "bucket", F.lower("value").alias("k")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("messages")).drop("k")


CHANNELS = ("speed_kmh", "throttle_pct", "brake_pct", "rpm")


def lap_channel_features(samples: DataFrame) -> DataFrame:
    """Per lap: samples, first and last lap time, range and nulls of each channel, range of gears."""
    ranges = [f(c).alias(f"{n}_{c}") for c in (*CHANNELS, "gear") for n, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c.split('_')[0]}_nulls") for c in CHANNELS]
    return samples.groupBy("session_id", "driver_code", "lap_number").agg(F.count(F.lit(1)).alias("car_samples"), F.min("lap_time_ms").alias("car_lap_time_min_ms"), F.max("lap_time_ms").alias("car_lap_time_max_ms"), *ranges, *nulls)


def message_categories(messages: DataFrame) -> DataFrame:
    missing = [F.coalesce(c, F.lit("missing")).alias(c) for c in ("category", "flag", "scope")]
    return messages.select("session_id", *missing).groupBy("session_id", "category", "flag", "scope").agg(F.count(F.lit(1)).alias("messages"))


def aligned_flag_counts(aligned: DataFrame) -> DataFrame:
    return aligned.select("session_id", F.explode("quality_flags").alias("flag")).groupBy("session_id", "flag").agg(F.count(F.lit(1)).alias("samples"))


GRAINS = {"race": ["session_id"], "driver": ["session_id", "driver_code"], "lap": ["session_id", "driver_code", "lap_number"]}


def aligned_quality_by(aligned: DataFrame, grain: str = "driver", laps: DataFrame | None = None) -> DataFrame:
    """Quality of aligned samples per race, driver or lap: rows, rows not OK, the families and their shares; laps carry their flags."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {list(GRAINS)}")
    rows = aligned.withColumn("family", quality_family(F.col("quality_flags")))
    if grain == "lap":
        rows = rows.where("lap_number is not null")
    families = ["car_gap_too_large", "car_sample_too_old", "location_gap_too_large", "location_sample_too_old", "other_unknown"]
    out = rows.groupBy(*GRAINS[grain]).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("family") != "OK").alias("not_ok"), *(F.count_if(F.col("family") == f).alias(f) for f in families), F.count_if(F.col("family").startswith("car_")).alias("car_related"), F.count_if(F.col("family").startswith("location_")).alias("location_related"))
    out = out.withColumns({f"{c}_pct": 100.0 * F.col(c) / F.col("samples") for c in ("not_ok", "car_related", "location_related")})
    if grain == "lap" and laps is not None:
        out = out.join(laps.select(*GRAINS["lap"], "is_pit_in_lap", "is_pit_out_lap", "is_deleted", "is_accurate"), GRAINS["lap"], "left")
    return out


def marker_bounds(markers: DataFrame) -> DataFrame:
    """Per session: markers, range and exact 1st and 99th percentiles of x and y."""
    parts = [f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max), ("p01", lambda c: F.percentile(c, 0.01)), ("p99", lambda c: F.percentile(c, 0.99)))]
    return markers.groupBy("session_id").agg(F.count(F.lit(1)).alias("markers"), *parts)


def speed_profile(samples: DataFrame, laps: DataFrame, bins: int = 20) -> DataFrame:
    """Mean speed in ``bins`` equal parts of each lap's time, one column a bin; times outside go to the first or last."""
    keys = ["session_id", "driver_code", "lap_number"]
    rows = samples.join(laps.where("lap_time_ms > 0").select(*keys, F.col("lap_time_ms").alias("total")), keys)
    number = F.least(F.greatest(F.width_bucket(F.col("lap_time_ms").cast("double"), F.lit(0.0), F.col("total").cast("double"), F.lit(bins)), F.lit(1)), F.lit(bins))
    names = [f"speed_bin_{k:02d}" for k in range(1, bins + 1)]
    at = F.concat(F.lit("speed_bin_"), F.lpad(number.cast("string"), 2, "0"))
    return rows.where("lap_time_ms is not null").withColumn("bin", at).groupBy(*keys).pivot("bin", names).agg(F.avg("speed_kmh"))


def ingestion_diagnostics(diagnostics: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stream diagnostics with their session's event; warnings as text."""
    return diagnostics.join(sessions.select("session_id", "year", "event_name"), "session_id").withColumn("warning_flags", F.array_join("warning_flags", ","))


def session_surface_features(sessions: DataFrame, drivers: DataFrame, laps: DataFrame, samples: DataFrame, positions: DataFrame, aligned: DataFrame, weather: DataFrame, events: DataFrame, messages: DataFrame, markers: DataFrame, circuits: DataFrame) -> DataFrame:
    """One wide row a session from all tables, each aggregated before the joins; missing counts are 0.

    circuit_metadata_rows counts metadata times markers, as the report that this reproduces does.
    """
    one = F.count(F.lit(1))
    nulls = lambda *columns: [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    parts = [
        drivers.groupBy("session_id").agg(one.alias("drivers")),
        laps.groupBy("session_id").agg(one.alias("laps"), F.count_if("is_deleted").alias("deleted_laps"), F.count_if(F.col("is_accurate") == F.lit(False)).alias("inaccurate_laps"), F.count_if(F.col("is_pit_in_lap") | F.col("is_pit_out_lap")).alias("pit_laps"), F.max("lap_number").alias("max_lap"), *nulls("lap_time_ms", "sector_1_ms", "sector_2_ms", "sector_3_ms")),
        samples.groupBy("session_id").agg(one.alias("car_samples"), F.min("session_time_ms").alias("car_start_ms"), F.max("session_time_ms").alias("car_end_ms"), F.count_distinct("driver_code").alias("car_drivers"), *nulls("speed_kmh", "throttle_pct", "brake_pct", "rpm", "gear", "drs")),
        positions.groupBy("session_id").agg(one.alias("position_samples"), F.count_distinct("driver_code").alias("position_drivers"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count_if(F.col("track_status") == "OffTrack").alias("off_track_samples"), *nulls("x", "y", "z")),
        aligned.groupBy("session_id").agg(one.alias("aligned_samples"), F.count_if(~F.array_contains("quality_flags", "OK")).alias("aligned_not_ok")),
        weather.groupBy("session_id").agg(one.alias("weather_samples"), F.count_if("rainfall").alias("rain_samples"), *nulls("air_temp_c", "track_temp_c", "rainfall")),
        events.groupBy("session_id").agg(one.alias("status_events"), *(F.count_if(F.col("status_code") == c).alias(f"status_{c}") for c in ("1", "2", "4", "5", "6", "7"))),
        messages.groupBy("session_id").agg(one.alias("messages"), F.count_if(F.col("session_time_ms").isNull()).alias("messages_without_time"), F.count_if(F.col("category").isNull()).alias("messages_without_category")),
        markers.groupBy("session_id").agg(one.alias("markers"), F.count_if(F.col("marker_type") == "corner").alias("corners")),
    ]
    out = sessions.select("session_id", "year", "event_name")
    for part in parts:
        out = out.join(part, "session_id", "left")
    meta = circuits.groupBy("session_id").agg(one.alias("m"))
    counts = [c for part in parts for c, kind in part.dtypes if kind == "bigint" and not c.endswith("_ms")]
    out = out.join(meta, "session_id", "left").fillna(0, [c for c in counts if c != "session_id"])
    return out.withColumn("circuit_metadata_rows", F.coalesce("m", F.lit(0)) * F.greatest("markers", F.lit(1))).drop("m")
