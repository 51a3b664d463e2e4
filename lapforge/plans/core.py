"""Queries and SQL of lookups, joins, aggregates, sequences and columns over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lookups as P
from ..operators import sequences as W
from ..operators.selection import exact_percentiles
from ..sources.fixtures import Fixtures


def pairs(fx: Fixtures) -> DataFrame:
    """Each driver's kept laps with the next driver's of the same number."""
    kept = fx.laps.where("not is_deleted")
    other = F.concat(F.lit("D"), F.lpad(((F.substring("driver_code", 2, 9).cast("int") + 1) % 20).cast("string"), 2, "0"))
    return kept.select("session_id", F.col("driver_code").alias("driver_a"), F.col("lap_number").alias("lap_a"), other.alias("driver_b"), F.col("lap_number").alias("lap_b"))


def lap_windows(fx: Fixtures) -> DataFrame:
    """Laps with their window on the session clock."""
    day = F.unix_millis(F.date_trunc("day", "lap_start_utc"))
    return fx.laps.select("lap_id", "session_id", "driver_code", "lap_number", (F.unix_millis("lap_start_utc") - day).alias("lap_start_ms"), (F.unix_millis("lap_end_utc") - day).alias("lap_end_ms"))


LAP_MS = "SELECT lap_id, session_id, driver_code, lap_number, epoch_ms(lap_start_utc) - epoch_ms(date_trunc('day', lap_start_utc)) AS lap_start_ms, epoch_ms(lap_end_utc) - epoch_ms(date_trunc('day', lap_start_utc)) AS lap_end_ms FROM fx_laps"
TEL = "session_id, driver_code, session_time_ms, lap_number, speed_kmh"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _windows(fx: Fixtures, event: str, limit: int | None = None) -> DataFrame:
    out = W.detect_windows(fx.telemetry, event, fx.positions, fx.markers, min_ms=0, limit=limit)
    return r6(out.drop("start_sample_time_utc", "x", "y", "marker_letter"), "avg_throttle_pct", "distance_to_corner")


def _windows_sql(condition: str, limit: int | None = None) -> str:
    chosen = "c WHERE k = 1" if limit is None else f"n WHERE r <= {limit}"
    numbered = "" if limit is None else """,
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_session_time_ms, driver_code) AS r FROM c WHERE k = 1)"""
    return f"""
WITH o AS (SELECT *, coalesce({condition}, false) AS met, row_number() OVER (PARTITION BY session_id, driver_code ORDER BY session_time_ms, sample_time_utc) - row_number() OVER (PARTITION BY session_id, driver_code, coalesce({condition}, false) ORDER BY session_time_ms, sample_time_utc) AS g FROM fx_telemetry),
w AS (SELECT session_id, driver_code, min(sample_time_utc) AS t0, min(lap_number) AS lap_number, min(session_time_ms) AS start_session_time_ms, max(session_time_ms) AS end_session_time_ms, min(lap_time_ms) AS start_lap_time_ms, max(lap_time_ms) AS end_lap_time_ms,
 max(session_time_ms) - min(session_time_ms) AS duration_ms, first(speed_kmh ORDER BY session_time_ms, sample_time_utc) AS entry_speed_kmh, min(speed_kmh) AS minimum_speed_kmh, max(speed_kmh) AS max_speed_kmh, last(speed_kmh ORDER BY session_time_ms, sample_time_utc) AS exit_speed_kmh, max(brake_pct) AS max_brake_pct, round(avg(throttle_pct), 6) AS avg_throttle_pct FROM o WHERE met GROUP BY session_id, driver_code, g),
p AS (SELECT w.*, p.x, p.y FROM w LEFT JOIN fx_positions p ON p.session_id = w.session_id AND p.driver_code = w.driver_code AND p.sample_time_utc = w.t0),
c AS (SELECT p.*, m.marker_number, round(sqrt(power(m.x - p.x, 2) + power(m.y - p.y, 2)), 6) AS distance_to_corner, row_number() OVER (PARTITION BY p.session_id, p.driver_code, p.start_session_time_ms ORDER BY sqrt(power(m.x - p.x, 2) + power(m.y - p.y, 2)), m.marker_number) AS k FROM p LEFT JOIN fx_markers m ON m.session_id = p.session_id AND m.marker_type = 'corner' AND p.x IS NOT NULL){numbered}
SELECT session_id, driver_code, lap_number, start_session_time_ms, end_session_time_ms, start_lap_time_ms, end_lap_time_ms, duration_ms, entry_speed_kmh, minimum_speed_kmh, max_speed_kmh, exit_speed_kmh, max_brake_pct, avg_throttle_pct, marker_number, distance_to_corner FROM {chosen}"""


AGG_SQL = """count(*) AS sample_count, round(avg(speed_kmh), 6) AS avg_speed_kmh, max(speed_kmh) AS max_speed_kmh, round(avg(throttle_pct), 6) AS avg_throttle_pct, round(avg(brake_pct), 6) AS avg_brake_pct,
 CAST(sum(CASE WHEN brake_pct >= 80 THEN lasts ELSE 0 END) AS BIGINT) AS brake_time_ms, CAST(sum(CASE WHEN drs > 0 THEN lasts ELSE 0 END) AS BIGINT) AS drs_active_time_ms, count(*) FILTER (WHERE throttle_pct <= 10 AND speed_kmh >= 150) AS throttle_lift_count, CAST(sum(CASE WHEN speed_kmh >= 300 THEN lasts ELSE 0 END) AS BIGINT) AS high_speed_time_ms"""
LASTS = "least(greatest(coalesce(lead(t.session_time_ms) OVER (PARTITION BY t.session_id, t.driver_code ORDER BY t.session_time_ms, t.sample_time_utc) - t.session_time_ms, 0), 0), 7200000) AS lasts"
FAMILY = "CASE WHEN list_contains(quality_flags, 'CAR_GAP_TOO_LARGE') THEN 'car_gap_too_large' WHEN list_contains(quality_flags, 'CAR_SAMPLE_TOO_OLD') THEN 'car_sample_too_old' WHEN list_contains(quality_flags, 'LOCATION_GAP_TOO_LARGE') THEN 'location_gap_too_large' WHEN list_contains(quality_flags, 'LOCATION_SAMPLE_TOO_OLD') THEN 'location_sample_too_old' WHEN list_contains(quality_flags, 'OK') THEN 'OK' ELSE 'other_unknown' END"
EVENT = "CASE WHEN brake_pct >= 80 THEN 'hard_braking' WHEN speed_kmh >= 300 THEN 'high_speed' WHEN drs > 0 THEN 'drs_active' WHEN throttle_pct <= 10 AND speed_kmh >= 150 THEN 'throttle_lift' END"
ASOF = """SELECT t.*, coalesce((SELECT p.status_name FROM v_periods p WHERE p.session_id = t.session_id AND t.session_time_ms >= p.start_time_ms AND (p.end_time_ms IS NULL OR t.session_time_ms < p.end_time_ms) ORDER BY p.start_time_ms DESC LIMIT 1), 'unknown') AS track_status"""
TAXONOMY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{t}')" for t in tokens) + f" THEN '{label}'" for label, tokens in X.TAXONOMY) + " ELSE 'other' END"
NORMAL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\bcar\s+\d+\b', 'car #', 'g'), '\bdriver\s+\d+\b', 'driver #', 'g'), '\blap\s+\d+\b', 'lap #', 'g'), '\bturn\s+\d+\b', 'turn #', 'g'), '\b\d+\b', '#', 'g'), '\s+', ' ', 'g'))"


def _quality_by_sql(keys: str) -> str:
    fams = ["car_gap_too_large", "car_sample_too_old", "location_gap_too_large", "location_sample_too_old", "other_unknown"]
    parts = ", ".join(f"count(*) FILTER (WHERE family = '{f}') AS {f}" for f in fams)
    return f"""WITH f AS (SELECT *, {FAMILY} AS family FROM fx_aligned), g AS (SELECT {keys}, count(*) AS samples, count(*) FILTER (WHERE family <> 'OK') AS not_ok, {parts}, count(*) FILTER (WHERE family LIKE 'car%') AS car_related, count(*) FILTER (WHERE family LIKE 'location%') AS location_related FROM f GROUP BY {keys})
SELECT *, round(100.0 * not_ok / samples, 6) AS not_ok_pct, round(100.0 * car_related / samples, 6) AS car_related_pct, round(100.0 * location_related / samples, 6) AS location_related_pct FROM g"""


def _r3(df: DataFrame) -> DataFrame:
    return r6(df, "not_ok_pct", "car_related_pct", "location_related_pct")


AGG6 = ("avg_speed_kmh", "avg_throttle_pct", "avg_brake_pct")

#: name -> (query over fixtures, SQL or None)
CORE = {
    "aggregate_telemetry": (lambda fx: r6(A.aggregate_telemetry(fx.telemetry, fx.laps, fx.track_status, ["driver", "track_status"], duration_cap_ms=7_200_000), *AGG6), f"WITH b AS (SELECT t.*, {LASTS} FROM fx_telemetry t), s AS ({ASOF} FROM b t) SELECT session_id, driver_code, track_status, {AGG_SQL} FROM s GROUP BY ALL"),
    "aggregate_telemetry_buckets": (lambda fx: r6(A.aggregate_telemetry(fx.telemetry, fx.laps, None, ["stint", "compound", "lap"], exclude_pit_laps=True, bucket_ms=7_200_000, duration_cap_ms=7_200_000), *AGG6), f"WITH b AS (SELECT t.*, l.stint_number, l.compound, {LASTS} FROM fx_telemetry t LEFT JOIN fx_laps l USING (session_id, driver_code, lap_number) WHERE NOT coalesce(l.is_pit_in_lap, false) AND NOT coalesce(l.is_pit_out_lap, false)) SELECT session_id, stint_number, compound, lap_number, CAST(floor(session_time_ms / 7200000) * 7200000 AS BIGINT) AS bucket_start_ms, CAST(floor(session_time_ms / 7200000) * 7200000 + 7200000 AS BIGINT) AS bucket_end_ms, {AGG_SQL} FROM b GROUP BY ALL"),
    "lap_summaries": (lambda fx: r6(A.lap_summaries(fx.laps, fx.telemetry).select("lap_id", "max_speed_kmh", "avg_speed_kmh", "avg_throttle_pct", "avg_brake_pct", "telemetry_samples"), *AGG6), "SELECT l.lap_id, max(speed_kmh) AS max_speed_kmh, round(avg(speed_kmh), 6) AS avg_speed_kmh, round(avg(throttle_pct), 6) AS avg_throttle_pct, round(avg(brake_pct), 6) AS avg_brake_pct, count(t.session_id) AS telemetry_samples FROM fx_laps l LEFT JOIN fx_telemetry t USING (session_id, driver_code, lap_number) GROUP BY l.lap_id"),
    "stint_summaries": (lambda fx: r6(A.stint_summaries(fx.laps), "avg_lap_time_ms"), "SELECT session_id, driver_code, stint_number, compound, min(lap_number) AS first_lap, max(lap_number) AS last_lap, count(*) AS laps, min(tyre_life) AS min_tyre_life, max(tyre_life) AS max_tyre_life, round(avg(lap_time_ms), 6) AS avg_lap_time_ms, min(lap_time_ms) AS best_lap_time_ms, max(lap_time_ms) AS worst_lap_time_ms FROM fx_laps WHERE stint_number IS NOT NULL GROUP BY ALL"),
    "weather_summary": (lambda fx: r6(A.weather_summary(fx.weather), "avg_air_temp_c", "avg_track_temp_c", "avg_humidity_pct", "avg_pressure_mbar", "avg_wind_speed_mps"), "SELECT session_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS avg_{c}" for c in ("air_temp_c", "track_temp_c", "humidity_pct", "pressure_mbar")) + ", round(avg(wind_speed_mps), 6) AS avg_wind_speed_mps, bool_or(coalesce(rainfall, false)) AS any_rain FROM fx_weather GROUP BY session_id"),
    "analyze_stints": (lambda fx: A.analyze_stints(fx.laps, 2).select("session_id", "driver_code", "stint_number", "compound", "laps", F.round("avg_lap_time_ms", 4).alias("avg_lap_time_ms"), F.round("slope_ms_per_lap", 4).alias("slope_ms_per_lap")), "SELECT session_id, driver_code, stint_number, compound, count(*) AS laps, round(avg(lap_time_ms), 4) AS avg_lap_time_ms, CASE WHEN count(DISTINCT lap_number) > 1 THEN round(regr_slope(lap_time_ms, lap_number), 4) END AS slope_ms_per_lap FROM fx_laps WHERE NOT is_deleted AND lap_time_ms IS NOT NULL AND NOT is_pit_in_lap AND NOT is_pit_out_lap GROUP BY ALL HAVING count(*) >= 2"),
    "session_facts": (lambda fx: A.session_facts(fx.sessions, fx.drivers, fx.laps, fx.telemetry, fx.track_status, fx.weather), """
WITH k AS (SELECT * FROM fx_laps WHERE NOT is_deleted), f AS (SELECT * FROM k WHERE lap_time_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY lap_time_ms, driver_code, lap_number) = 1), t AS (SELECT * FROM fx_telemetry WHERE speed_kmh IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY speed_kmh DESC, driver_code) = 1)
SELECT s.session_id, (SELECT count(*) FROM fx_drivers d WHERE d.session_id = s.session_id) AS driver_count, (SELECT max(lap_number) FROM k WHERE k.session_id = s.session_id) AS race_laps, (SELECT count(*) FROM fx_track_status e WHERE e.session_id = s.session_id AND status_code = '4') AS safety_cars, (SELECT count(*) FROM fx_track_status e WHERE e.session_id = s.session_id AND status_code = '5') AS red_flags, (SELECT count(*) FROM fx_track_status e WHERE e.session_id = s.session_id AND status_code = '6') AS virtual_safety_cars,
 f.driver_code AS fastest_driver, f.lap_number AS fastest_lap, f.lap_time_ms AS fastest_lap_ms, t.driver_code AS top_speed_driver, t.speed_kmh AS top_speed_kmh, (SELECT max(track_temp_c) FROM fx_weather w WHERE w.session_id = s.session_id) AS peak_track_temp_c, (SELECT bool_or(coalesce(rainfall, false)) FROM fx_weather w WHERE w.session_id = s.session_id) AS any_rain FROM fx_sessions s LEFT JOIN f USING (session_id) LEFT JOIN t USING (session_id)"""),
    "weather_trend": (lambda fx: r6(A.weather_trend(fx.weather), "avg_value"), "WITH l AS (" + " UNION ALL ".join(f"SELECT session_id, session_time_ms, sample_time_utc, '{c}' AS channel, {c} AS v FROM fx_weather" for c in A.WEATHER_CHANNELS) + "), g AS (SELECT session_id, channel, count(*) AS samples, first(v ORDER BY session_time_ms, sample_time_utc) AS first_value, last(v ORDER BY session_time_ms, sample_time_utc) AS last_value, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS avg_value FROM l GROUP BY ALL) SELECT *, last_value - first_value AS delta FROM g"),
    "race_control_buckets": (lambda fx: A.message_buckets(fx.race_control), "WITH l AS (SELECT session_id, 'category' AS bucket, category AS v FROM fx_race_control UNION ALL SELECT session_id, 'flag', flag FROM fx_race_control UNION ALL SELECT session_id, 'status', status FROM fx_race_control) SELECT session_id, bucket, min(v) AS value, count(*) AS messages FROM l WHERE trim(v) <> '' GROUP BY session_id, bucket, lower(v)"),
    "lap_channel_features": (lambda fx: A.lap_channel_features(fx.telemetry), "SELECT session_id, driver_code, lap_number, count(*) AS car_samples, min(lap_time_ms) AS car_lap_time_min_ms, max(lap_time_ms) AS car_lap_time_max_ms, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in (*A.CHANNELS, "gear")) + ", " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c.split('_')[0]}_nulls" for c in A.CHANNELS) + " FROM fx_telemetry GROUP BY ALL"),
    "message_categories": (lambda fx: A.message_categories(fx.race_control), "SELECT session_id, coalesce(category, 'missing') AS category, coalesce(flag, 'missing') AS flag, coalesce(scope, 'missing') AS scope, count(*) AS messages FROM fx_race_control GROUP BY ALL"),
    "aligned_flag_counts": (lambda fx: A.aligned_flag_counts(fx.aligned), "SELECT session_id, flag, count(*) AS samples FROM (SELECT session_id, unnest(quality_flags) AS flag FROM fx_aligned) GROUP BY ALL"),
    "aligned_quality_by_race": (lambda fx: _r3(A.aligned_quality_by(fx.aligned, "race")), _quality_by_sql("session_id")),
    "aligned_quality_by_driver": (lambda fx: _r3(A.aligned_quality_by(fx.aligned, "driver")), _quality_by_sql("session_id, driver_code")),
    "aligned_quality_by_lap": (lambda fx: _r3(A.aligned_quality_by(fx.aligned, "lap")), _quality_by_sql("session_id, driver_code, lap_number")),
    "marker_bounds": (lambda fx: r6(A.marker_bounds(fx.markers), "p01_x", "p99_x", "p01_y", "p99_y"), "SELECT session_id, count(*) AS markers, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(quantile_cont({c}, 0.01), 6) AS p01_{c}, round(quantile_cont({c}, 0.99), 6) AS p99_{c}" for c in "xy") + " FROM fx_markers GROUP BY session_id"),
    "speed_profile": (lambda fx: r6(A.speed_profile(fx.telemetry, fx.laps), *(f"speed_bin_{k:02d}" for k in range(1, 21))), "WITH b AS (SELECT t.session_id, t.driver_code, t.lap_number, t.speed_kmh, least(20, greatest(1, CASE WHEN t.lap_time_ms >= l.lap_time_ms THEN 21 ELSE CAST(floor(20.0 * t.lap_time_ms / l.lap_time_ms) AS INT) + 1 END)) AS bin FROM fx_telemetry t JOIN fx_laps l USING (session_id, driver_code, lap_number) WHERE l.lap_time_ms > 0) SELECT session_id, driver_code, lap_number, " + ", ".join(f"round(avg(speed_kmh) FILTER (WHERE bin = {k}), 6) AS speed_bin_{k:02d}" for k in range(1, 21)) + " FROM b GROUP BY ALL"),
    "list_sessions": (lambda fx: P.list_sessions(fx.sessions, fx.drivers, fx.laps, 2024, "event", "r").select("session_id", "event_name", "driver_count", "lap_count"), "SELECT s.session_id, s.event_name, (SELECT count(*) FROM fx_drivers d WHERE d.session_id = s.session_id) AS driver_count, coalesce((SELECT max(lap_number) FROM fx_laps l WHERE l.session_id = s.session_id AND NOT is_deleted), 0) AS lap_count FROM fx_sessions s"),
    "session_drivers": (lambda fx: P.session_drivers(fx.drivers, fx.laps), "SELECT d.*, (SELECT count(*) FROM fx_laps l WHERE l.session_id = d.session_id AND l.driver_code = d.driver_code AND NOT is_deleted) AS laps FROM fx_drivers d"),
    "driver_laps": (lambda fx: P.driver_laps(fx.laps).select("lap_id", "lap_number", "lap_time_ms", "position"), "SELECT lap_id, lap_number, lap_time_ms, CAST(NULL AS INT) AS position FROM fx_laps WHERE NOT is_deleted"),
    "lap_telemetry": (lambda fx: P.lap_telemetry(fx.telemetry, ["speed_kmh", "rpm"], every=2).select("source_sample_index", "speed_kmh", "rpm", "gear"), "SELECT source_sample_index, speed_kmh, rpm, CAST(NULL AS INT) AS gear FROM fx_telemetry QUALIFY (row_number() OVER (PARTITION BY session_id, driver_code, lap_number ORDER BY lap_time_ms NULLS LAST, sample_time_utc, source_sample_index) - 1) % 2 = 0"),
    "replay_chunk_raw": (lambda fx: P.replay_chunk_raw(fx.telemetry, fx.positions, 20_000_000, 30_000_000, 2).select("source_sample_index", "x", "y", "offset_ms"), "WITH c AS (SELECT * FROM fx_telemetry WHERE session_time_ms >= 20000000 AND session_time_ms < 50000000 QUALIFY (row_number() OVER (PARTITION BY session_id, driver_code ORDER BY session_time_ms, sample_time_utc) - 1) % 2 = 0), n AS (SELECT c.source_sample_index, p.x, p.y, epoch_ms(p.sample_time_utc) - epoch_ms(c.sample_time_utc) AS offset_ms FROM c LEFT JOIN fx_positions p ON p.session_id = c.session_id AND p.driver_code = c.driver_code AND abs(epoch_ms(p.sample_time_utc) - epoch_ms(c.sample_time_utc)) <= 500) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source_sample_index ORDER BY abs(offset_ms), offset_ms) = 1"),
    "replay_chunk_aligned": (lambda fx: P.replay_chunk_aligned(fx.aligned, fx.drivers, 20_000_000, 30_000_000, 2).select(*TEL.split(", ")), f"SELECT {TEL} FROM fx_aligned WHERE session_time_ms >= 20000000 AND session_time_ms < 50000000 QUALIFY (row_number() OVER (PARTITION BY session_id, driver_code ORDER BY session_time_ms, sample_time_utc) - 1) % 2 = 0"),
    "replay_chunk": (lambda fx: P.replay_chunk(fx.telemetry, fx.aligned.where("session_id < '2024-day15-r'"), fx.drivers, 20_000_000, 30_000_000), f"SELECT {TEL}, CASE WHEN session_id < '2024-day15-r' THEN 'aligned' ELSE 'raw' END AS source FROM fx_telemetry WHERE session_time_ms >= 20000000 AND session_time_ms < 50000000"),
    "replay_context": (lambda fx: P.replay_context(None, fx.track_status, fx.race_control, 20_000_000, 30_000_000), "SELECT * FROM (SELECT session_id, 'track_status' AS section, event_time_ms AS time_ms, status_code AS detail FROM fx_track_status UNION ALL SELECT session_id, 'race_control', session_time_ms, message FROM fx_race_control) WHERE time_ms >= 20000000 AND time_ms < 50000000"),
    "replay_bounds": (lambda fx: P.replay_bounds(fx.telemetry, fx.positions), "WITH u AS (SELECT session_id, sample_time_utc, session_time_ms FROM fx_telemetry UNION ALL SELECT session_id, sample_time_utc, NULL FROM fx_positions) SELECT session_id, min(sample_time_utc) AS start_utc, max(sample_time_utc) AS end_utc, coalesce(min(session_time_ms), 0) AS start_ms, coalesce(max(session_time_ms), 0) AS end_ms, max(session_time_ms) - min(session_time_ms) AS duration_ms FROM u GROUP BY session_id"),
    "replay_metadata": (lambda fx: P.replay_metadata(fx.telemetry, fx.positions, fx.circuits, fx.markers, fx.weather, fx.track_status, fx.race_control, fx.aligned).select("session_id", "duration_ms", F.array_join("drivers", ",").alias("drivers"), "rotation_degrees", F.size("markers").alias("markers"), "has_weather", "has_track_status", "has_race_control", "has_aligned", F.round("avg_track_temp_c", 6).alias("avg_track_temp_c"), "any_rain"), "SELECT c.session_id, (SELECT max(session_time_ms) - min(session_time_ms) FROM fx_telemetry t WHERE t.session_id = c.session_id) AS duration_ms, (SELECT string_agg(DISTINCT driver_code, ',' ORDER BY driver_code) FROM fx_telemetry t WHERE t.session_id = c.session_id) AS drivers, c.rotation_degrees, (SELECT CAST(count(*) AS INT) FROM fx_markers m WHERE m.session_id = c.session_id) AS markers, EXISTS (SELECT 1 FROM fx_weather w WHERE w.session_id = c.session_id) AS has_weather, EXISTS (SELECT 1 FROM fx_track_status w WHERE w.session_id = c.session_id) AS has_track_status, EXISTS (SELECT 1 FROM fx_race_control w WHERE w.session_id = c.session_id) AS has_race_control, true AS has_aligned, (SELECT round(avg(track_temp_c), 6) FROM fx_weather w WHERE w.session_id = c.session_id) AS avg_track_temp_c, (SELECT bool_or(coalesce(rainfall, false)) FROM fx_weather w WHERE w.session_id = c.session_id) AS any_rain FROM fx_circuits c"),
    "event_candidates": (lambda fx: P.event_candidates(fx.telemetry).select("source_sample_index", "event_type"), f"SELECT source_sample_index, {EVENT} AS event_type FROM fx_telemetry WHERE {EVENT} IS NOT NULL"),
    "search_events": (lambda fx: P.search_events(fx.telemetry, ["hard_braking", "drs_active"], None, 10_000_000, 40_000_000, 50).select("source_sample_index", "event_type"), f"SELECT source_sample_index, {EVENT} AS event_type FROM fx_telemetry WHERE {EVENT} IN ('hard_braking', 'drs_active') AND session_time_ms >= 10000000 AND session_time_ms < 50000000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms, driver_code, source_sample_index) <= 50"),
    "race_control_index": (lambda fx: P.race_control_index(fx.race_control).select("race_control_message_id", "search_text"), "SELECT race_control_message_id, lower(concat_ws(' ', category, flag, status, scope, sector, message)) AS search_text FROM fx_race_control"),
    "race_control_timeline": (lambda fx: P.race_control_timeline(fx.race_control, ["Flag", "Other"], None, None, 1, 5, "car", 40).select("race_control_message_id", "search_text"), "SELECT race_control_message_id, lower(concat_ws(' ', category, flag, status, scope, sector, message)) AS search_text FROM fx_race_control WHERE category IN ('Flag', 'Other') AND lap_number BETWEEN 1 AND 5 AND lower(concat_ws(' ', category, flag, status, scope, sector, message)) LIKE '%car%' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms NULLS LAST, race_control_message_id) <= 40"),
    "circuit_context": (lambda fx: P.circuit_context(fx.markers, fx.circuits).select("session_id", "rotation_degrees", "corner_count", "marshal_light_count", "marshal_sector_count", F.array_join(F.col("corners.marker_number").cast("array<string>"), ",").alias("corners")), "SELECT c.session_id, c.rotation_degrees, CAST(count(*) FILTER (WHERE marker_type = 'corner') AS INT) AS corner_count, CAST(count(*) FILTER (WHERE marker_type = 'marshal_light') AS INT) AS marshal_light_count, CAST(count(*) FILTER (WHERE marker_type = 'marshal_sector') AS INT) AS marshal_sector_count, string_agg(CASE WHEN marker_type = 'corner' THEN CAST(marker_number AS VARCHAR) END, ',' ORDER BY marker_number) AS corners FROM fx_circuits c JOIN fx_markers m USING (session_id) GROUP BY ALL"),
    "lap_quality": (lambda fx: P.lap_quality(fx.telemetry.groupBy("session_id", "driver_number", "lap_number").agg(F.count(F.lit(1)).alias("samples")), fx.drivers), "SELECT t.session_id, t.driver_number, t.lap_number, count(*) AS samples, d.driver_code FROM fx_telemetry t JOIN fx_drivers d USING (session_id, driver_number) GROUP BY ALL"),
    "requested_laps_exist": (lambda fx: P.requested_laps_exist(pairs(fx), fx.laps), "SELECT * FROM v_pairs p WHERE EXISTS (SELECT 1 FROM fx_laps l WHERE l.session_id = p.session_id AND l.driver_code = p.driver_b AND l.lap_number = p.lap_b AND NOT l.is_deleted)"),
    "session_inventory": (lambda fx: P.session_inventory(fx.sessions).select("session_id", "session_rank"), "SELECT session_id, dense_rank() OVER (PARTITION BY year ORDER BY session_start_utc NULLS LAST, event_name) AS session_rank FROM fx_sessions"),
    "downsample_trace": (lambda fx: P.downsample_trace(fx.positions, 10).select("session_id", "driver_code", "source_sample_index"), "WITH n AS (SELECT session_id, driver_code, count(*) AS n FROM fx_positions GROUP BY session_id, driver_code QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, driver_code) = 1), r AS (SELECT p.session_id, p.driver_code, p.source_sample_index, n.n, row_number() OVER (PARTITION BY p.session_id ORDER BY sample_time_utc, source_sample_index) AS r FROM fx_positions p JOIN n USING (session_id, driver_code)) SELECT session_id, driver_code, source_sample_index FROM r WHERE r = 1 OR r = n OR (r - 1) % greatest(1, CAST(ceil(n / 10.0) AS INT)) = 0"),
    "drivers_exist": (lambda fx: P.drivers_exist(fx.drivers.select("session_id", F.concat("driver_code", F.when(F.col("driver_number") % 4 == 0, "X").otherwise("")).alias("driver_code")), fx.drivers), "SELECT session_id, concat(driver_code, 'X') AS driver_code FROM fx_drivers WHERE driver_number % 4 = 0"),
    "asof_status": (lambda fx: J.asof_status(fx.telemetry, fx.track_status).select("source_sample_index", "track_status"), f"SELECT source_sample_index, track_status FROM ({ASOF} FROM fx_telemetry t)"),
    "join_window_start_position": (lambda fx: J.window_start_position(fx.telemetry.select("session_id", "driver_code", (F.col("sample_time_utc") + F.expr("interval 200 milliseconds")).alias("start_sample_time_utc"), "source_sample_index"), fx.positions).select("source_sample_index", "x", "y"), "SELECT t.source_sample_index, p.x, p.y FROM fx_telemetry t LEFT JOIN fx_positions p ON p.session_id = t.session_id AND p.driver_code = t.driver_code AND p.sample_time_utc = t.sample_time_utc + INTERVAL '200' MILLISECOND"),
    "nearest_position": (lambda fx: J.nearest_position(fx.telemetry, fx.positions).select("source_sample_index", "x", "y", "offset_ms"), "WITH n AS (SELECT c.source_sample_index, p.x, p.y, epoch_ms(p.sample_time_utc) - epoch_ms(c.sample_time_utc) AS offset_ms FROM fx_telemetry c LEFT JOIN fx_positions p ON p.session_id = c.session_id AND p.driver_code = c.driver_code AND abs(epoch_ms(p.sample_time_utc) - epoch_ms(c.sample_time_utc)) <= 500) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source_sample_index ORDER BY abs(offset_ms), offset_ms) = 1"),
    "nearest_corner": (lambda fx: r6(J.nearest_corner(fx.positions, fx.markers).select("source_sample_index", "marker_number", "distance_to_corner"), "distance_to_corner"), "SELECT p.source_sample_index, m.marker_number, round(sqrt(power(m.x - p.x, 2) + power(m.y - p.y, 2)), 6) AS distance_to_corner FROM fx_positions p JOIN fx_markers m ON m.session_id = p.session_id AND m.marker_type = 'corner' QUALIFY row_number() OVER (PARTITION BY p.source_sample_index ORDER BY sqrt(power(m.x - p.x, 2) + power(m.y - p.y, 2)), m.marker_number) = 1"),
    "lap_status_overlap": (lambda fx: J.lap_status_overlap(lap_windows(fx), fx.track_status), f"WITH l AS ({LAP_MS}) SELECT l.lap_id, count(*) FILTER (WHERE status_code = '4') AS safety_car_periods, count(*) FILTER (WHERE status_code IN ('6', '7')) AS virtual_safety_car_periods, count(*) FILTER (WHERE status_code = '5') AS red_flag_periods, string_agg(DISTINCT status_code, ',' ORDER BY status_code) AS track_status_codes FROM l LEFT JOIN v_periods p ON p.session_id = l.session_id AND p.start_time_ms <= l.lap_end_ms AND (p.end_time_ms IS NULL OR p.end_time_ms >= l.lap_start_ms) GROUP BY l.lap_id"),
    "lap_race_control": (lambda fx: J.lap_race_control(fx.laps, fx.drivers, fx.race_control), "SELECT l.lap_id, count(m.session_id) AS race_control_messages, count(*) FILTER (WHERE m.category ILIKE '%flag%' OR m.message ILIKE '%yellow%' OR m.message ILIKE '%safety car%' OR m.message ILIKE '%red flag%') AS race_control_flag_messages FROM fx_laps l LEFT JOIN fx_drivers d USING (session_id, driver_code) LEFT JOIN fx_race_control m ON m.session_id = l.session_id AND m.lap_number = l.lap_number AND (m.racing_number IS NULL OR m.racing_number = d.driver_number) GROUP BY l.lap_id"),
    "messages_with_driver": (lambda fx: J.messages_with_driver(fx.race_control, fx.drivers).select("race_control_message_id", "driver_code"), "SELECT m.race_control_message_id, d.driver_code FROM fx_race_control m LEFT JOIN fx_drivers d ON d.session_id = m.session_id AND d.driver_number = m.racing_number"),
    "window_context": (lambda fx: J.window_context(fx.telemetry.select("session_id", X.time_bucket(F.col("session_time_ms"), 600_000).alias("window_start_ms")).distinct().withColumn("window_end_ms", F.col("window_start_ms") + 600_000), fx.race_control, fx.track_status, 600_000), "WITH w AS (SELECT DISTINCT session_id, CAST(floor(session_time_ms / 600000) * 600000 AS BIGINT) AS window_start_ms, CAST(floor(session_time_ms / 600000) * 600000 + 600000 AS BIGINT) AS window_end_ms FROM fx_telemetry), p AS (SELECT w.session_id, w.window_start_ms, bool_or(status_code = '4') AS safety_car, bool_or(status_code IN ('6', '7')) AS vsc, bool_or(status_code = '5') AS red_flag, bool_or(status_code = '2') AS yellow FROM w JOIN v_periods p ON p.session_id = w.session_id AND p.start_time_ms < w.window_end_ms AND (p.end_time_ms IS NULL OR p.end_time_ms > w.window_start_ms) GROUP BY ALL) SELECT w.*, (SELECT count(*) FROM fx_race_control m WHERE m.session_id = w.session_id AND m.session_time_ms >= w.window_start_ms AND m.session_time_ms < w.window_end_ms) AS messages, coalesce(safety_car, false) AS safety_car, coalesce(vsc, false) AS vsc, coalesce(red_flag, false) AS red_flag, coalesce(yellow, false) AS yellow FROM w LEFT JOIN p USING (session_id, window_start_ms)"),
    "positions_vs_sessions_bounds": (lambda fx: J.markers_against_bounds(fx.markers, fx.positions.groupBy("session_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))).select("session_id", "marker_number", "inside"), "WITH b AS (SELECT session_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_positions GROUP BY ALL) SELECT m.session_id, m.marker_number, m.x BETWEEN x0 AND x1 AND m.y BETWEEN y0 AND y1 AS inside FROM fx_markers m LEFT JOIN b USING (session_id)"),
    "track_status_periods": (lambda fx: P.status_periods(fx.track_status), "SELECT session_id, status_code, status_name, start_time_ms, end_time_ms, message FROM v_periods"),
    "detect_windows_hard_braking": (lambda fx: _windows(fx, "hard_braking", 5000), _windows_sql("brake_pct >= 80", 5000)),
    "detect_windows_drs_active": (lambda fx: _windows(fx, "drs_active"), _windows_sql("drs > 0")),
    "braking_zones": (lambda fx: r6(W.braking_zones(fx.telemetry, 80, 0), "avg_throttle_pct"), "WITH o AS (SELECT *, brake_pct >= 80 AS met, row_number() OVER (PARTITION BY session_id, driver_code, lap_number ORDER BY lap_time_ms, sample_time_utc) - row_number() OVER (PARTITION BY session_id, driver_code, lap_number, brake_pct >= 80 ORDER BY lap_time_ms, sample_time_utc) AS g FROM fx_telemetry), z AS (SELECT session_id, driver_code, lap_number, min(lap_time_ms) AS start_lap_time_ms, max(lap_time_ms) AS end_lap_time_ms, first(speed_kmh ORDER BY lap_time_ms, sample_time_utc) AS entry_speed_kmh, min(speed_kmh) AS minimum_speed_kmh, max(speed_kmh) AS max_speed_kmh, last(speed_kmh ORDER BY lap_time_ms, sample_time_utc) AS exit_speed_kmh, max(brake_pct) AS max_brake_pct, round(avg(throttle_pct), 6) AS avg_throttle_pct, max(lap_time_ms) - min(lap_time_ms) AS duration_ms FROM o WHERE met GROUP BY session_id, driver_code, lap_number, g) SELECT *, row_number() OVER (PARTITION BY session_id, driver_code, lap_number ORDER BY start_lap_time_ms) AS zone_index FROM z"),
    "degraded_segments": (lambda fx: W.degraded_segments(fx.aligned, 3_600_000), f"WITH f AS (SELECT *, {FAMILY} AS family FROM fx_aligned), n AS (SELECT * FROM f WHERE family <> 'OK'), s AS (SELECT *, CASE WHEN session_time_ms - lag(session_time_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY session_id, driver_code ORDER BY session_time_ms)), t AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, driver_code ORDER BY session_time_ms) AS seg FROM s), g AS (SELECT session_id, driver_code, min(session_time_ms) AS start_ms, max(session_time_ms) AS end_ms, count(*) AS samples, " + ", ".join(f"count(*) FILTER (WHERE family = '{f}') AS {f}" for f in ("car_gap_too_large", "car_sample_too_old", "location_gap_too_large", "location_sample_too_old", "other_unknown")) + " FROM t GROUP BY session_id, driver_code, seg), h AS (SELECT *, greatest(car_gap_too_large, car_sample_too_old, location_gap_too_large, location_sample_too_old, other_unknown) AS top FROM g) SELECT * EXCLUDE (top), greatest(end_ms - start_ms + 100, 100) AS duration_ms, CASE top WHEN car_gap_too_large THEN 'car_gap_too_large' WHEN car_sample_too_old THEN 'car_sample_too_old' WHEN location_gap_too_large THEN 'location_gap_too_large' WHEN location_sample_too_old THEN 'location_sample_too_old' ELSE 'other_unknown' END AS dominant_family FROM h"),
    "lap_positions": (lambda fx: W.lap_positions(fx.laps).select("session_id", "driver_code", "from_lap", "to_lap", F.array_join(F.col("positions").cast("array<string>"), ",", "-").alias("positions")), "WITH s AS (SELECT session_id, 1 AS from_lap, max(lap_number) AS to_lap FROM v_pos GROUP BY ALL), d AS (SELECT DISTINCT session_id, driver_code FROM v_pos), l AS (SELECT s.*, unnest(range(1, to_lap + 1)) AS k FROM s) SELECT d.session_id, d.driver_code, l.from_lap, l.to_lap, string_agg(coalesce(CAST(p.position AS VARCHAR), '-'), ',' ORDER BY l.k) AS positions FROM d JOIN l USING (session_id) LEFT JOIN v_pos p ON p.session_id = d.session_id AND p.driver_code = d.driver_code AND p.lap_number = l.k GROUP BY ALL"),
    "lap_gap_features": (lambda fx: r6(W.lap_gap_features(fx.telemetry), "car_p95_gap_ms", "car_max_gap_ms"), "WITH d AS (SELECT session_id, driver_code, lap_number, (epoch_us(sample_time_utc) - lag(epoch_us(sample_time_utc)) OVER w) / 1000.0 AS d, lap_time_ms - lag(lap_time_ms) OVER w AS l FROM fx_telemetry WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY source_sample_index)) SELECT session_id, driver_code, lap_number, count(*) FILTER (WHERE d < 0) AS car_out_of_order_steps, count(*) FILTER (WHERE l < 0) AS car_lap_time_negative_steps, round(max(d) FILTER (WHERE d > 0), 6) AS car_max_gap_ms, round(quantile_cont(CASE WHEN d > 0 THEN d END, 0.95), 6) AS car_p95_gap_ms FROM d GROUP BY ALL"),
    "position_step_features": (lambda fx: r6(W.position_step_features(fx.positions), "position_path_length_units", "position_max_segment_units", "position_p95_segment_units"), "WITH d AS (SELECT session_id, driver_code, lap_number, x, y, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS s FROM fx_positions WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY sample_time_utc, source_sample_index)) SELECT session_id, driver_code, lap_number, count(*) AS position_samples, round(sum(s), 6) AS position_path_length_units, round(max(s), 6) AS position_max_segment_units, round(quantile_cont(s, 0.95), 6) AS position_p95_segment_units, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS position_xy_nulls FROM d GROUP BY ALL"),
    "weather_cadence": (lambda fx: W.weather_cadence(fx.weather).drop("wind"), "WITH d AS (SELECT session_id, rainfall, session_time_ms - lag(session_time_ms) OVER w AS gap, abs(air_temp_c - lag(air_temp_c) OVER w) AS air, abs(track_temp_c - lag(track_temp_c) OVER w) AS track, abs(humidity_pct - lag(humidity_pct) OVER w) AS humid, abs(pressure_mbar - lag(pressure_mbar) OVER w) AS press, abs(wind_speed_mps - lag(wind_speed_mps) OVER w) AS speed, abs(wind_direction_deg - lag(wind_direction_deg) OVER w) AS turn, lag(rainfall) OVER w IS NOT NULL AND (rainfall IS NULL OR rainfall <> lag(rainfall) OVER w) AS rain FROM fx_weather WINDOW w AS (PARTITION BY session_id ORDER BY session_time_ms, sample_time_utc)), g AS (SELECT session_id, count(*) AS samples, median(gap) AS median_gap_ms, max(gap) AS max_gap_ms, max(air) AS max_air_jump, max(track) AS max_track_jump, max(humid) AS max_humidity_jump, max(press) AS max_pressure_jump, max(speed) AS max_wind_speed_jump, max(least(turn, 360 - turn)) AS max_wind_turn_deg, count(*) FILTER (WHERE rainfall) AS rain_samples, count(*) FILTER (WHERE rain) AS rain_transitions FROM d GROUP BY ALL) SELECT *, coalesce(max_gap_ms > 180000, false) AS large_gap_flag, coalesce(max_air_jump > 5, false) OR coalesce(max_track_jump > 8, false) AS temperature_jump_flag, coalesce(max_pressure_jump > 5, false) AS pressure_jump_flag, coalesce(max_humidity_jump > 20, false) AS humidity_jump_flag, coalesce(max_wind_speed_jump > 5, false) OR coalesce(max_wind_turn_deg > 90, false) AS wind_jump_flag FROM g"),
    "rain_transitions": (lambda fx: W.rain_transitions(fx.weather), "WITH d AS (SELECT session_id, session_time_ms, rainfall, lag(rainfall) OVER (PARTITION BY session_id ORDER BY session_time_ms, sample_time_utc) AS previous_rainfall FROM fx_weather) SELECT session_id, session_time_ms, previous_rainfall, rainfall FROM d WHERE previous_rainfall IS NOT NULL AND (rainfall IS NULL OR rainfall <> previous_rainfall)"),
    "status_intervals": (lambda fx: W.status_intervals(fx.track_status, fx.telemetry.groupBy("session_id").agg(F.max("session_time_ms").alias("duration_ms"))), "WITH d AS (SELECT session_id, max(session_time_ms) AS m FROM fx_telemetry GROUP BY ALL) SELECT session_id, status_code, status_name, start_time_ms, coalesce(end_time_ms, m) AS end_time_ms, greatest(coalesce(end_time_ms, m) - start_time_ms, 0) AS interval_ms FROM v_periods LEFT JOIN d USING (session_id)"),
    "weather_max_gap": (lambda fx: W.weather_max_gap(fx.weather), "WITH d AS (SELECT session_id, session_time_ms - lag(session_time_ms) OVER (PARTITION BY session_id ORDER BY session_time_ms, sample_time_utc) AS gap FROM fx_weather) SELECT session_id, max(gap) AS weather_max_gap_ms FROM d GROUP BY session_id"),
    "latest_row_per_driver": (lambda fx: P.latest_row_per_driver(fx.laps).select("session_id", "driver_code", "lap_number", "compound"), "SELECT session_id, driver_code, lap_number, compound FROM fx_laps QUALIFY row_number() OVER (PARTITION BY session_id, driver_code ORDER BY lap_number DESC) = 1"),
    "recent_laps": (lambda fx: P.recent_laps(fx.laps).select("session_id", "driver_code", F.array_join(F.col("recent_laps").cast("array<string>"), ",").alias("recent_laps")), "WITH r AS (SELECT * FROM fx_laps WHERE lap_time_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, driver_code ORDER BY lap_number DESC) <= 5) SELECT session_id, driver_code, string_agg(CAST(lap_time_ms AS VARCHAR), ',' ORDER BY lap_number) AS recent_laps FROM r GROUP BY ALL"),
    "top_n_per_group": (lambda fx: P.top_n(fx.race_control.withColumn("taxonomy", X.message_taxonomy(*map(F.col, ("category", "flag", "scope", "status", "message")))), ["taxonomy"], ["session_time_ms", "race_control_message_id"], 12).select("taxonomy", "race_control_message_id"), f"WITH t AS (SELECT *, lower(concat(coalesce(category, ''), ' ', coalesce(flag, ''), ' ', coalesce(scope, ''), ' ', coalesce(status, ''), ' ', coalesce(message, ''))) AS x FROM fx_race_control), u AS (SELECT *, {TAXONOMY_SQL} AS taxonomy FROM t) SELECT taxonomy, race_control_message_id FROM u QUALIFY row_number() OVER (PARTITION BY taxonomy ORDER BY session_time_ms NULLS LAST, race_control_message_id) <= 12"),
    "ordered_limit": (lambda fx: P.ordered_limit(fx.race_control.select("session_time_ms", "race_control_message_id"), ["session_time_ms", "race_control_message_id"], 100), "SELECT session_time_ms, race_control_message_id FROM fx_race_control ORDER BY session_time_ms NULLS LAST, race_control_message_id LIMIT 100"),
    "union_samples": (lambda fx: P.union_samples(fx.telemetry, fx.positions).groupBy("session_id", "driver_code").agg(F.count(F.lit(1)).alias("n"), F.sum("session_time_ms").alias("s")), "SELECT session_id, driver_code, count(*) AS n, CAST(sum(session_time_ms) AS BIGINT) AS s FROM (SELECT session_id, driver_code, session_time_ms FROM fx_telemetry UNION ALL SELECT session_id, driver_code, NULL FROM fx_positions) GROUP BY ALL"),
    "nulls_last_order": (lambda fx: P.top_n(fx.race_control, ["session_id"], ["session_time_ms", "race_control_message_id"], 1_000_000).withColumn("missing", F.col("session_time_ms").isNull()).groupBy("session_id", "missing").agg(F.count(F.lit(1)).alias("n")), "SELECT session_id, session_time_ms IS NULL AS missing, count(*) AS n FROM fx_race_control GROUP BY ALL"),
    "distinct_drivers": (lambda fx: P.distinct_drivers(fx.telemetry), "SELECT DISTINCT session_id, driver_code FROM fx_telemetry"),
    "normalize_message_text": (lambda fx: fx.race_control.select("race_control_message_id", X.normalize_message_text(F.col("message")).alias("text")), f"SELECT race_control_message_id, {NORMAL_SQL.format('message')} AS text FROM fx_race_control"),
    "normalize_turn_text": (lambda fx: fx.raw("conversations").select("conv_id", "turn", X.normalize_message_text(F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")).alias("text")), f"SELECT conv_id, turn, {NORMAL_SQL.format(chr(114) + 'egexp_replace(text, ' + chr(39) + '[^A-Za-z0-9 ]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM conversations"),
    "message_taxonomy": (lambda fx: fx.race_control.select("race_control_message_id", X.message_taxonomy(*map(F.col, ("category", "flag", "scope", "status", "message"))).alias("taxonomy")), f"WITH t AS (SELECT *, lower(concat(coalesce(category, ''), ' ', coalesce(flag, ''), ' ', coalesce(scope, ''), ' ', coalesce(status, ''), ' ', coalesce(message, ''))) AS x FROM fx_race_control) SELECT race_control_message_id, {TAXONOMY_SQL} AS taxonomy FROM t"),
    "format_duration_ms": (lambda fx: fx.telemetry.select("source_sample_index", X.format_duration_ms(F.col("lap_time_ms") % 150_001).alias("text")), "WITH t AS (SELECT source_sample_index, lap_time_ms % 150001 AS d FROM fx_telemetry) SELECT source_sample_index, CASE WHEN d >= 60000 THEN concat(d // 60000, ':', lpad(CAST(d % 60000 // 1000 AS VARCHAR), 2, '0'), '.', lpad(CAST(d % 1000 AS VARCHAR), 3, '0')) ELSE concat(d // 1000, '.', lpad(CAST(d % 1000 AS VARCHAR), 3, '0'), 's') END AS text FROM t"),
    "corner_label": (lambda fx: fx.markers.select("session_id", "marker_number", X.corner_label(F.when(F.col("marker_number") % 2 == 0, F.concat("session_id", F.lit("-Monza"))).otherwise(F.col("session_id")), F.col("marker_number"), F.when(F.col("marker_number") % 5 == 0, "A")).alias("label")), "SELECT session_id, marker_number, CASE WHEN marker_number % 2 = 0 AND marker_number IN (2) THEN 'Turn 1/2, Variante del Rettifilo' WHEN marker_number = 4 THEN 'Turn 4/5, Variante della Roggia' WHEN marker_number = 6 THEN 'Turn 6, Lesmo 1' WHEN marker_number IN (8, 10) THEN 'Turn 8/9/10, Variante Ascari' ELSE concat('Turn ', marker_number, CASE WHEN marker_number % 5 = 0 THEN 'A' ELSE '' END) END AS label FROM fx_markers"),
    "status_name": (lambda fx: fx.track_status.select("session_id", "event_time_ms", X.status_sentence(X.status_name(F.col("status_code"))).alias("text")), "SELECT session_id, event_time_ms, CASE status_code WHEN '1' THEN 'track_clear' WHEN '2' THEN 'Yellow flag' WHEN '4' THEN 'Safety car deployed' WHEN '5' THEN 'Red flag' WHEN '6' THEN 'Virtual safety car deployed' ELSE 'Virtual safety car ending' END AS text FROM fx_track_status"),
    "exact_percentiles": (lambda fx: r6(exact_percentiles(fx.telemetry, ["session_id", "gear"], "speed_kmh", {"p05": 0.05, "p50": 0.5, "p99": 0.99}, 20), "p05", "p50", "p99"), "SELECT session_id, gear, round(quantile_cont(speed_kmh, 0.05), 6) AS p05, round(quantile_cont(speed_kmh, 0.5), 6) AS p50, round(quantile_cont(speed_kmh, 0.99), 6) AS p99 FROM fx_telemetry WHERE speed_kmh IS NOT NULL GROUP BY ALL"),
    "null_safe_difference": (lambda fx: fx.laps.select("lap_id", (F.col("sector_1_ms") - F.col("sector_3_ms")).alias("d")), "SELECT lap_id, sector_1_ms - sector_3_ms AS d FROM fx_laps"),
    "time_bucket": (lambda fx: fx.telemetry.select("source_sample_index", X.time_bucket(F.col("session_time_ms"), 300_000).alias("b")), "SELECT source_sample_index, CAST(floor(session_time_ms / 300000) * 300000 AS BIGINT) AS b FROM fx_telemetry"),
    "quality_family": (lambda fx: fx.aligned.groupBy("session_id", X.quality_family(F.col("quality_flags")).alias("family")).agg(F.count(F.lit(1)).alias("n")), f"SELECT session_id, {FAMILY} AS family, count(*) AS n FROM fx_aligned GROUP BY ALL"),
    "quality_status_from_messages": (lambda fx: fx.laps.select("lap_id", X.quality_status(F.array_compact(F.array(F.when(F.col("lap_time_ms").isNull(), "INVALID_NO_TIME"), F.when(F.col("sector_3_ms").isNull(), "INCOMPLETE_SECTOR"), F.when(F.col("is_deleted"), "NOTE")))).alias("status")), "SELECT lap_id, CASE WHEN lap_time_ms IS NULL THEN 'invalid' WHEN sector_3_ms IS NULL THEN 'incomplete' WHEN is_deleted THEN 'valid_with_warnings' ELSE 'valid' END AS status FROM fx_laps"),
    "project_latlon_xy": (lambda fx: (lambda d: d.select("source_sample_index", *(F.round(c, 4).alias(n) for c, n in zip(X.project_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")), ("px", "py")))))((lambda p: p.join(p.groupBy("session_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")), "session_id"))(fx.positions.select("session_id", "source_sample_index", (F.col("x") / 100).alias("lon"), (F.col("y") / 100).alias("lat")))), "WITH p AS (SELECT session_id, source_sample_index, x / 100 AS lon, y / 100 AS lat FROM fx_positions), o AS (SELECT session_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM p GROUP BY ALL) SELECT source_sample_index, round(radians(lon - lon0) * 6371000 * cos(radians(lat0)), 4) AS px, round(radians(lat - lat0) * 6371000, 4) AS py FROM p JOIN o USING (session_id)"),
}
