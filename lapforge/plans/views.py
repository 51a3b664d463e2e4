"""The fixture tables as DuckDB SQL, put before a query that names them."""

from __future__ import annotations

import re

_SESSION = "concat('2024-day', lpad(CAST(day(ts) AS VARCHAR), 2, '0'), '-r')"
_DRIVER = "concat('D', lpad(CAST(user_id % 20 AS VARCHAR), 2, '0'))"
_LAP = "CAST(floor(hour(ts) / 4) AS INT) + 1"
_TIME = "CAST((hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT)) * 1000 AS BIGINT)"
_STINT = "CASE WHEN lap_number <= 2 + driver_number % 3 THEN 1 ELSE 2 END"

VIEWS = {
    "fx_telemetry": f"""
SELECT ts AS sample_time_utc, {_SESSION} AS session_id, {_DRIVER} AS driver_code, CAST(user_id % 20 + 1 AS INT) AS driver_number,
 {_LAP} AS lap_number, {_TIME} AS session_time_ms, {_TIME} - CAST(floor(hour(ts) / 4) AS BIGINT) * 14400000 AS lap_time_ms,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS speed_kmh, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS throttle_pct,
 CAST((event_id * 7) % 101 AS DOUBLE) AS brake_pct, CAST(event_id % 8 + 1 AS INT) AS gear, CAST(4000 + (event_id * 13) % 8000 AS DOUBLE) AS rpm,
 CAST(CASE WHEN event_type = 'click' THEN 10 ELSE 0 END AS INT) AS drs, event_id AS source_sample_index
FROM events""",
    "fx_positions": f"""
SELECT ts + INTERVAL '200' MILLISECOND AS sample_time_utc, {_SESSION} AS session_id, {_DRIVER} AS driver_code, {_LAP} AS lap_number,
 CAST((event_id * 37) % 2000 - 1000 AS DOUBLE) AS x, CAST((event_id * 53) % 2000 - 1000 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z,
 CASE WHEN event_type = 'error' THEN 'OffTrack' ELSE 'OnTrack' END AS track_status, event_id AS source_sample_index
FROM events WHERE event_id % 3 <> 0""",
    "fx_laps": f"""
SELECT concat(session_id, '-', lower(driver_code), '-', CAST(lap_number AS VARCHAR)) AS lap_id, session_id, driver_code, lap_number, {_STINT} AS stint_number,
 min(sample_time_utc) AS lap_start_utc, max(sample_time_utc) AS lap_end_utc,
 CAST(CASE WHEN sum(source_sample_index) % 29 = 0 THEN NULL ELSE 14000000 + (sum(source_sample_index) % 400000) END AS INT) AS lap_time_ms,
 CAST(4600000 + (sum(source_sample_index) % 9000) AS INT) AS sector_1_ms, CAST(4700000 + (sum(source_sample_index) % 8000) AS INT) AS sector_2_ms,
 CAST(CASE WHEN sum(source_sample_index) % 11 = 0 THEN NULL ELSE 4700000 + (sum(source_sample_index) % 7000) END AS INT) AS sector_3_ms,
 CASE (driver_number + {_STINT}) % 3 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
 CASE WHEN lap_number <= 2 + driver_number % 3 THEN lap_number ELSE lap_number - 2 - driver_number % 3 END AS tyre_life,
 (lap_number = 3 + driver_number % 3) AS is_pit_out_lap, (lap_number = 2 + driver_number % 3) AS is_pit_in_lap,
 ((driver_number + lap_number * 3) % 19 = 0) AS is_deleted,
 CASE WHEN (driver_number + lap_number) % 17 = 0 THEN NULL ELSE ((driver_number + lap_number) % 13 <> 0) END AS is_accurate,
 CASE WHEN lap_number = 2 + driver_number % 3 THEN max(session_time_ms) END AS pit_in_session_time_ms,
 CASE WHEN lap_number = 3 + driver_number % 3 THEN min(session_time_ms) END AS pit_out_session_time_ms
FROM fx_telemetry GROUP BY session_id, driver_code, driver_number, lap_number""",
    "fx_sessions": """
SELECT session_id, 2024 AS year, concat('Event ', substr(session_id, 9, 2)) AS event_name, concat('Circuit ', CAST(min(CAST(substr(session_id, 9, 2) AS INT)) % 5 AS VARCHAR)) AS circuit_name,
 'Land' AS country, 'R' AS session_type, CAST(date_trunc('day', min(sample_time_utc)) AS TIMESTAMP) AS session_start_utc, CAST(NULL AS TIMESTAMP) AS session_end_utc
FROM fx_telemetry GROUP BY session_id""",
    "fx_drivers": """
SELECT DISTINCT t.session_id, t.driver_code, t.driver_number, concat('Driver ', t.driver_code) AS full_name, r.r_name AS team_name,
 CASE WHEN t.driver_number % 7 = 0 THEN NULL WHEN t.driver_number % 9 = 0 THEN 0 ELSE t.driver_number END AS grid_position
FROM fx_telemetry t LEFT JOIN region r ON r.r_regionkey = t.driver_number % 5""",
    "fx_weather": """
SELECT session_id, sample_time_utc, session_time_ms, CASE WHEN source_sample_index % 130 = 0 THEN NULL ELSE CAST(20 + source_sample_index % 15 AS DOUBLE) END AS air_temp_c,
 CAST(30 + source_sample_index % 21 AS DOUBLE) AS track_temp_c, CAST(40 + source_sample_index % 50 AS DOUBLE) AS humidity_pct, CAST(1000 + source_sample_index % 12 AS DOUBLE) AS pressure_mbar,
 CASE WHEN source_sample_index % 110 = 0 THEN NULL ELSE (source_sample_index % 40 = 0) END AS rainfall, CAST(source_sample_index % 360 AS INT) AS wind_direction_deg, CAST(source_sample_index % 9 AS DOUBLE) AS wind_speed_mps
FROM fx_telemetry WHERE source_sample_index % 10 = 0""",
    "fx_track_status": """
SELECT session_id, session_time_ms AS event_time_ms,
 CASE CAST(floor(source_sample_index / 25) AS INT) % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '5' WHEN 4 THEN '6' ELSE '7' END AS status_code, CASE WHEN source_sample_index % 50 = 0 THEN NULL ELSE 'status change' END AS message
FROM fx_telemetry WHERE source_sample_index % 25 = 0""",
    "fx_race_control": """
SELECT source_sample_index AS race_control_message_id, session_id, sample_time_utc AS message_time_utc, CASE WHEN source_sample_index % 35 = 0 THEN NULL ELSE session_time_ms END AS session_time_ms,
 CASE source_sample_index % 4 WHEN 0 THEN 'Flag' WHEN 1 THEN 'Drs' WHEN 2 THEN 'Other' ELSE NULL END AS category,
 CASE source_sample_index % 7 WHEN 0 THEN 'YELLOW FLAG IN SECTOR 3' WHEN 1 THEN concat('CAR ', CAST(driver_number AS VARCHAR), ' SPIN AT TURN 4') WHEN 2 THEN 'SAFETY CAR DEPLOYED' WHEN 3 THEN 'DRS ENABLED' WHEN 4 THEN concat('INCIDENT INVOLVING CAR ', CAST(driver_number AS VARCHAR), ' NOTED') WHEN 5 THEN concat('5 SECOND TIME PENALTY FOR CAR ', CAST(driver_number AS VARCHAR)) ELSE 'PIT EXIT OPEN' END AS message,
 CAST(NULL AS VARCHAR) AS status, CASE WHEN source_sample_index % 7 = 0 THEN 'YELLOW' END AS flag, 'Track' AS scope, CAST(NULL AS VARCHAR) AS sector,
 CASE WHEN source_sample_index % 7 IN (1, 4, 5) THEN driver_number END AS racing_number, lap_number
FROM fx_telemetry WHERE source_sample_index % 5 = 0""",
    "fx_markers": """
SELECT s.session_id, CASE n.n_regionkey WHEN 3 THEN 'marshal_light' WHEN 4 THEN 'marshal_sector' ELSE 'corner' END AS marker_type, n.n_nationkey AS marker_number, CAST(NULL AS VARCHAR) AS marker_letter,
 CAST(n.n_nationkey * 80 - 1000 AS DOUBLE) AS x, CAST((n.n_nationkey * n.n_nationkey) % 2000 - 1000 AS DOUBLE) AS y, CAST(n.n_nationkey * 15 AS DOUBLE) AS angle_degrees, CASE WHEN n.n_nationkey = 24 THEN NULL ELSE CAST(n.n_nationkey * 220 AS DOUBLE) END AS distance_m
FROM fx_sessions s CROSS JOIN nation n""",
    "fx_session_status": """
SELECT session_id, min(session_time_ms) AS event_time_ms, 'Started' AS status FROM fx_telemetry GROUP BY session_id
UNION ALL SELECT session_id, max(session_time_ms) AS event_time_ms, 'Finished' AS status FROM fx_telemetry GROUP BY session_id""",
    "fx_circuits": "SELECT session_id, CAST(CAST(substr(session_id, 9, 2) AS INT) AS DOUBLE) AS rotation_degrees, 'fixture' AS source FROM fx_sessions",
    "fx_aligned": """
SELECT session_id, driver_code, driver_number, sample_time_utc, session_time_ms, lap_number, speed_kmh,
 CASE WHEN source_sample_index % 6 = 0 THEN ['CAR_GAP_TOO_LARGE', 'LOCATION_GAP_TOO_LARGE'] WHEN source_sample_index % 7 = 0 THEN ['LOCATION_SAMPLE_TOO_OLD'] WHEN source_sample_index % 11 = 0 THEN ['CAR_SAMPLE_TOO_OLD'] WHEN source_sample_index % 13 = 0 THEN ['MISSING_LOCATION_DATA'] ELSE ['OK'] END AS quality_flags
FROM fx_telemetry""",
    "fx_distance": """
SELECT session_id, driver_code, lap_number, CAST(k * 100 AS DOUBLE) AS distance_m, CAST(k AS DOUBLE) / 10 AS lap_progress, CAST(total * k / 10 AS DOUBLE) AS elapsed_ms,
 CAST((total + k * 37) % 300 AS DOUBLE) AS speed_kmh, CAST((total + k * 11) % 101 AS DOUBLE) AS throttle_pct, CAST((total + k * 7) % 101 AS DOUBLE) AS brake_pct
FROM (SELECT session_id, driver_code, lap_number, CAST(coalesce(lap_time_ms, 14000000) AS BIGINT) AS total FROM fx_laps), range(0, 11) r(k)""",
    # periods between status events, as views of other queries use them
    "v_periods": """
SELECT session_id, status_code, CASE status_code WHEN '1' THEN 'track_clear' WHEN '2' THEN 'yellow_flag' WHEN '4' THEN 'safety_car' WHEN '5' THEN 'red_flag' WHEN '6' THEN 'virtual_safety_car_deployed' WHEN '7' THEN 'virtual_safety_car_ending' ELSE 'unknown' END AS status_name,
 event_time_ms AS start_time_ms, lead(event_time_ms) OVER (PARTITION BY session_id ORDER BY event_time_ms, status_code) AS end_time_ms, message
FROM fx_track_status""",
    "v_pit": """
SELECT session_id, driver_code, lap_number, CASE WHEN is_pit_in_lap AND is_pit_out_lap THEN 'pit_in_out' WHEN is_pit_in_lap THEN 'pit_in' ELSE 'pit_out' END AS pit_type, lap_time_ms, compound, stint_number
FROM fx_laps WHERE NOT is_deleted AND (is_pit_in_lap OR is_pit_out_lap)""",
    "v_pos": """
SELECT session_id, driver_code, lap_number, rank() OVER (PARTITION BY session_id, lap_number ORDER BY lap_start_utc) AS position FROM fx_laps WHERE NOT is_deleted AND lap_start_utc IS NOT NULL""",
    # pairs of laps to compare: each driver's laps with the next driver's
    "v_pairs": """
SELECT session_id, driver_code AS driver_a, lap_number AS lap_a, concat('D', lpad(CAST((CAST(substr(driver_code, 2) AS INT) + 1) % 20 AS VARCHAR), 2, '0')) AS driver_b, lap_number AS lap_b FROM fx_laps WHERE NOT is_deleted""",
}


def with_views(sql: str) -> str:
    """``sql`` after the views that it uses, and those that these use."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    # epoch_ms rounds; milliseconds here are whole ones
    sql = re.sub(r"epoch_ms\(((?:[^()]|\([^()]*\))*)\)", r"(epoch_us(\1) // 1000)", sql)
    body = sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in wanted)
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
