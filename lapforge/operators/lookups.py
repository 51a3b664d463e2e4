"""Projections, filters, samples of rows, replay chunks and lookups. Every operator works on all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import event_label
from .aggregates import check_range, weather_summary
from .joins import nearest_position, track_status_periods


def list_sessions(sessions: DataFrame, drivers: DataFrame, laps: DataFrame, year: int | None = None, event: str | None = None, session_type: str | None = None) -> DataFrame:
    """Sessions with driver_count and lap_count, the greatest number of a kept lap."""
    rows = sessions
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if event:
        rows = rows.where(F.lower("event_name").contains(event.lower()))
    if session_type:
        rows = rows.where(F.col("session_type") == session_type.upper())
    n = drivers.groupBy("session_id").agg(F.count(F.lit(1)).alias("driver_count"))
    top = laps.where("not is_deleted").groupBy("session_id").agg(F.max("lap_number").alias("lap_count"))
    return rows.join(n, "session_id", "left").join(top, "session_id", "left").fillna(0, ["driver_count", "lap_count"])


def session_drivers(drivers: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers with their number of kept laps, zero included."""
    n = laps.where("not is_deleted").groupBy("session_id", "driver_code").agg(F.count(F.lit(1)).alias("laps"))
    return drivers.join(n, ["session_id", "driver_code"], "left").fillna(0, ["laps"])


def driver_laps(laps: DataFrame) -> DataFrame:
    """Kept laps; their position is not known here."""
    return laps.where("not is_deleted").withColumn("position", F.lit(None).cast("int"))


CHANNELS = ("speed_kmh", "throttle_pct", "brake_pct", "gear", "rpm", "drs")


def _chosen(df: DataFrame, channels: list[str] | None) -> DataFrame:
    """Channels that were not asked for become nulls, so the schema stays."""
    if channels is None:
        return df
    if unknown := set(channels) - set(CHANNELS):
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in CHANNELS if c in df.columns and c not in channels})


def lap_telemetry(samples: DataFrame, channels: list[str] | None = None, every: int = 1, most: int = 5000) -> DataFrame:
    """Each lap's samples by lap time (nulls last) and time: every k-th row, at most ``most`` of a lap."""
    check_range("every", every, 1, 100)
    check_range("most", most, 1, 50_000)
    order = Window.partitionBy("session_id", "driver_code", "lap_number").orderBy(F.col("lap_time_ms").asc_nulls_last(), "sample_time_utc", "source_sample_index")
    rows = samples.withColumn("_r", F.row_number().over(order)).where(f"(_r - 1) % {every} = 0 and _r <= {every} * {most}")
    return _chosen(rows.drop("_r"), channels)


def _chunk(rows: DataFrame, start_ms: int, duration_ms: int, every: int) -> DataFrame:
    check_range("duration_ms", duration_ms, 1, 120_000_000)
    check_range("every", every, 1, 100)
    # of samples at one time the first by source order, where the table has it
    order = Window.partitionBy("session_id", "driver_code").orderBy("session_time_ms", "sample_time_utc", *(c for c in ["source_sample_index"] if c in rows.columns))
    inside = rows.where((F.col("session_time_ms") >= start_ms) & (F.col("session_time_ms") < start_ms + duration_ms))
    return inside.withColumn("_r", F.row_number().over(order)).where(f"(_r - 1) % {every} = 0").drop("_r")


def replay_chunk_raw(samples: DataFrame, positions: DataFrame | None, start_ms: int, duration_ms: int, every: int = 1, channels: list[str] | None = None) -> DataFrame:
    """Samples in [start, start + duration): every k-th of a driver, with the nearest position if positions are given."""
    rows = _chosen(_chunk(samples, start_ms, duration_ms, every), channels)
    if positions is not None:
        rows = nearest_position(rows, positions)
    return rows


def replay_chunk_aligned(aligned: DataFrame, drivers: DataFrame, start_ms: int, duration_ms: int, every: int = 1) -> DataFrame:
    """The same of the aligned table; a missing driver code is looked up by number."""
    named = drivers.select("session_id", "driver_number", F.col("driver_code").alias("_code"))
    rows = aligned.join(named, ["session_id", "driver_number"], "left").withColumn("driver_code", F.coalesce("driver_code", "_code")).drop("_code")
    return _chunk(rows, start_ms, duration_ms, every)


def replay_chunk(samples: DataFrame, aligned: DataFrame | None, drivers: DataFrame, start_ms: int, duration_ms: int, every: int = 1) -> DataFrame:
    """Aligned rows of sessions that have any in the range, raw rows of all others; ``source`` says which."""
    columns = ["session_id", "driver_code", "session_time_ms", "lap_number", "speed_kmh"]
    raw = replay_chunk_raw(samples, None, start_ms, duration_ms, every).select(*columns, F.lit("raw").alias("source"))
    if aligned is None:
        return raw
    own = replay_chunk_aligned(aligned, drivers, start_ms, duration_ms, every).select(*columns, F.lit("aligned").alias("source"))
    return own.unionByName(raw.join(own.select("session_id").distinct(), "session_id", "left_anti"))


def replay_context(weather: DataFrame | None, events: DataFrame | None, messages: DataFrame | None, start_ms: int, duration_ms: int) -> DataFrame:
    """Weather, status and message rows with a time in [start, start + duration), tagged; sections may be left out."""
    check_range("duration_ms", duration_ms, 1, 600_000_000)
    parts = []
    if weather is not None:
        parts.append(weather.select("session_id", F.lit("weather").alias("section"), F.col("session_time_ms").alias("time_ms"), F.concat_ws("|", "air_temp_c", "track_temp_c", "rainfall").alias("detail")))
    if events is not None:
        parts.append(events.select("session_id", F.lit("track_status").alias("section"), F.col("event_time_ms").alias("time_ms"), F.col("status_code").alias("detail")))
    if messages is not None:
        parts.append(messages.select("session_id", F.lit("race_control").alias("section"), F.col("session_time_ms").alias("time_ms"), F.col("message").alias("detail")))
    if not parts:
        raise ValueError("at least one section is needed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < start_ms + duration_ms))


def union_samples(samples: DataFrame, positions: DataFrame) -> DataFrame:
    """Times of car and position samples; positions have no session clock."""
    return samples.select("session_id", "driver_code", "sample_time_utc", "session_time_ms").unionByName(positions.select("session_id", "driver_code", "sample_time_utc", F.lit(None).cast("long").alias("session_time_ms")))


def replay_bounds(samples: DataFrame, positions: DataFrame) -> DataFrame:
    """First and last time of any sample and of the session clock, and the duration in between (0 at least)."""
    by = union_samples(samples, positions).groupBy("session_id").agg(F.min("sample_time_utc").alias("start_utc"), F.max("sample_time_utc").alias("end_utc"), F.coalesce(F.min("session_time_ms"), F.lit(0)).alias("start_ms"), F.coalesce(F.max("session_time_ms"), F.lit(0)).alias("end_ms"))
    return by.withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))


def distinct_drivers(samples: DataFrame) -> DataFrame:
    return samples.select("session_id", "driver_code").distinct()


def replay_metadata(samples: DataFrame, positions: DataFrame, circuits: DataFrame, markers: DataFrame, weather: DataFrame, events: DataFrame, messages: DataFrame, aligned: DataFrame | None) -> DataFrame:
    """One row a session: bounds, drivers, rotation, markers, which overlays exist, weather, and constants of a replay."""
    out = replay_bounds(samples, positions)
    codes = distinct_drivers(samples).groupBy("session_id").agg(F.array_sort(F.collect_list("driver_code")).alias("drivers"))
    marks = markers.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("marker_type", "marker_number", "x", "y"))).alias("markers"))
    out = out.join(codes, "session_id", "left").join(circuits.select("session_id", "rotation_degrees"), "session_id", "left").join(marks, "session_id", "left")
    for name, df in (("has_weather", weather), ("has_track_status", events), ("has_race_control", messages), ("has_aligned", aligned)):
        flags = df.select("session_id").distinct().withColumn(name, F.lit(True)) if df is not None else samples.select("session_id").where("false").withColumn(name, F.lit(True))
        out = out.join(flags, "session_id", "left").fillna(False, [name])
    return out.join(weather_summary(weather).select("session_id", "avg_track_temp_c", "any_rain"), "session_id", "left").withColumns({"default_hz": F.lit(10), "max_chunk_ms": F.lit(120_000)})


def event_candidates(samples: DataFrame) -> DataFrame:
    """Samples that the first matching rule labels: hard braking, high speed, DRS, throttle lift."""
    label = event_label(F.col("speed_kmh"), F.col("throttle_pct"), F.col("brake_pct"), F.col("drs"))
    return samples.withColumn("event_type", label).where("event_type is not null")


def search_events(samples: DataFrame, types: list[str] | None = None, drivers: list[str] | None = None, start_ms: int | None = None, duration_ms: int | None = None, limit: int = 500) -> DataFrame:
    """Labelled samples by time and driver, at most ``limit`` of a session. The upper bound needs both start and duration."""
    check_range("limit", limit, 1, 5000)
    rows = event_candidates(samples)
    if types:
        rows = rows.where(F.col("event_type").isin(types))
    if drivers:
        rows = rows.where(F.col("driver_code").isin(drivers))
    if start_ms is not None:
        rows = rows.where(F.col("session_time_ms") >= start_ms)
        if duration_ms is not None:
            rows = rows.where(F.col("session_time_ms") < start_ms + duration_ms)
    return top_n(rows, ["session_id"], ["session_time_ms", "driver_code", "source_sample_index"], limit)


def top_n(rows: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ascending keys have nulls last."""
    keys = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("_r") <= n).drop("_r")


def race_control_index(messages: DataFrame) -> DataFrame:
    """Messages with one lower-case text of all their parts; nulls are skipped."""
    return messages.withColumn("search_text", F.lower(F.concat_ws(" ", "category", "flag", "status", "scope", "sector", "message")))


def race_control_timeline(messages: DataFrame, categories: list[str] | None = None, flags: list[str] | None = None, numbers: list[int] | None = None, lap_from: int | None = None, lap_to: int | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    """Messages that pass all filters, by time (nulls last) and id, at most ``limit`` of a session. % and _ in ``search`` are wildcards."""
    check_range("limit", limit, 1, 5000)
    rows = race_control_index(messages)
    for column, allowed in (("category", categories), ("flag", flags), ("racing_number", numbers)):
        if allowed:
            rows = rows.where(F.col(column).isin(allowed))
    if lap_from is not None:
        rows = rows.where(F.col("lap_number") >= lap_from)
    if lap_to is not None:
        rows = rows.where(F.col("lap_number") <= lap_to)
    if search:
        rows = rows.where(F.col("search_text").like(f"%{search.lower()}%"))
    return top_n(rows, ["session_id"], ["session_time_ms", "race_control_message_id"], limit)


def circuit_context(markers: DataFrame, circuits: DataFrame) -> DataFrame:
    """One row a session: its markers in three lists by number, their counts, and the rotation."""
    own = F.struct("marker_number", "x", "y")
    lists = [F.array_sort(F.collect_list(F.when(F.col("marker_type") == k, own))).alias(f"{k}s") for k in ("corner", "marshal_light", "marshal_sector")]
    by = markers.groupBy("session_id").agg(*lists)
    out = circuits.select("session_id", "rotation_degrees").join(by, "session_id", "left")
    return out.withColumns({f"{k}_count": F.size(f"{k}s") for k in ("corner", "marshal_light", "marshal_sector")})


def lap_quality(quality: DataFrame, drivers: DataFrame) -> DataFrame:
    """Quality rows, which name a driver by number, with the driver's code."""
    return quality.join(drivers.select("session_id", "driver_number", "driver_code"), ["session_id", "driver_number"])


def requested_laps_exist(pairs: DataFrame, laps: DataFrame) -> DataFrame:
    """Pairs of laps (session_id, driver_a, lap_a, driver_b, lap_b) that both exist and are kept."""
    kept = laps.where("not is_deleted")
    for k in "ab":
        pairs = pairs.join(kept.select("session_id", F.col("driver_code").alias(f"driver_{k}"), F.col("lap_number").alias(f"lap_{k}")), ["session_id", f"driver_{k}", f"lap_{k}"], "left_semi")
    return pairs


def session_inventory(sessions: DataFrame) -> DataFrame:
    """Sessions numbered by start (nulls last) and event."""
    return sessions.withColumn("session_rank", F.dense_rank().over(Window.partitionBy("year").orderBy(F.col("session_start_utc").asc_nulls_last(), "event_name")))


def downsample_trace(positions: DataFrame, most: int = 2500) -> DataFrame:
    """Each session's driver with most positions (then the first by code): first, last and every ceil(n / most)-th row."""
    n = positions.groupBy("session_id", "driver_code").agg(F.count(F.lit(1)).alias("n"))
    busy = top_n(n, ["session_id"], [F.desc("n"), "driver_code"], 1)
    own = Window.partitionBy("session_id").orderBy("sample_time_utc", "source_sample_index")
    rows = positions.join(busy, ["session_id", "driver_code"]).withColumn("r", F.row_number().over(own))
    return rows.where(f"r = 1 or r = n or (r - 1) % greatest(1, cast(ceil(n / {float(most)}) as int)) = 0").drop("r", "n")


def drivers_exist(requests: DataFrame, drivers: DataFrame) -> DataFrame:
    """Requested (session_id, driver_code) rows that name no driver of their session; none: all exist."""
    return requests.join(drivers.select("session_id", "driver_code"), ["session_id", "driver_code"], "left_anti")


def latest_row_per_driver(laps: DataFrame) -> DataFrame:
    return top_n(laps, ["session_id", "driver_code"], [F.desc("lap_number")], 1)


def recent_laps(laps: DataFrame, n: int = 5) -> DataFrame:
    """Each driver's last ``n`` timed laps' times, oldest first."""
    newest = top_n(laps.where("lap_time_ms is not null"), ["session_id", "driver_code"], [F.desc("lap_number")], n)
    listed = newest.groupBy("session_id", "driver_code").agg(F.array_sort(F.collect_list(F.struct("lap_number", "lap_time_ms"))).alias("l"))
    return listed.select("session_id", "driver_code", F.col("l.lap_time_ms").alias("recent_laps"))


def ordered_limit(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of all; ascending, nulls last."""
    return rows.orderBy(*(F.col(o).asc_nulls_last() for o in order)).limit(n)


def status_periods(events: DataFrame) -> DataFrame:
    return track_status_periods(events)
