"""Queries and SQL of ingest and materialisations over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import grids as T
from ..operators import ingest as S
from ..operators.backfill import run_backfill
from ..sources.commits import read_committed
from ..sources.tables import save_table, shared_path, write_session
from .core import LAP_MS, lap_windows, r6

RAW_LAPS = "session_id, driver_code, lap_number"
DELTA = "(epoch_us(sample_time_utc) - lag(epoch_us(sample_time_utc)) OVER (PARTITION BY session_id, driver_code ORDER BY source_sample_index)) / 1000.0"


def _windows(fx):
    return lap_windows(fx).select("session_id", "driver_code", "lap_number", F.col("lap_start_ms").alias("start_ms"), F.col("lap_end_ms").alias("end_ms"))


def _aligned(fx):
    return T.align_time_grid(fx.telemetry, fx.positions, _windows(fx), 600_000, 14_400_000, 14_400_000)


def _shared(fx, name: str) -> str:
    """A new folder where driver and executors share files."""
    return shared_path(fx.spark, name)


def _written_sessions(fx):
    """Laps stored in three steps: the first three laps of all sessions, all later ones merged over them, one session replaced by its first lap."""
    path, laps = _shared(fx, "laps"), fx.laps.select("session_id", "driver_code", "lap_number", "lap_time_ms")
    late = laps.where("lap_number >= 3").withColumn("lap_time_ms", F.col("lap_time_ms") + 1)
    write_session(laps.where("lap_number <= 3"), path)
    write_session(late, path, "upsert", ["session_id", "driver_code", "lap_number"])
    write_session(laps.where("session_id = '2024-day05-r' and lap_number = 1"), path, "replace")
    stored = fx.spark.read.schema(laps.schema).parquet(path)
    return stored.groupBy("session_id").agg(F.count(F.lit(1)).alias("laps"), F.sum("lap_time_ms").alias("lap_time_ms"))


def _saved_table(fx):
    """A report table, read back from both of its files."""
    path, rows = _shared(fx, "report"), fx.laps.groupBy("session_id").agg(F.count(F.lit(1)).alias("laps"), F.array_sort(F.collect_set("compound")).alias("compounds"))
    save_table(rows, path)
    text = fx.spark.read.option("header", True).csv(f"{path}.csv").select("session_id", F.col("laps").cast("long").alias("laps_csv"), F.from_json("compounds", "array<string>").alias("c"))
    both = fx.spark.read.parquet(f"{path}.parquet").join(text, "session_id")
    return both.select("session_id", "laps", "laps_csv", F.array_join("compounds", ",").alias("compounds"), F.array_join("c", ",").alias("compounds_csv"))


DISTANCE = "session_id string, driver_code string, lap_number int, distance_m double, x double, y double, z double, quality_flags array<string>"


def _backfilled(fx):
    """Sessions stored in two runs, the second of which finds the first's done; distance rows with the number of quality rows that were committed with them."""
    root = _shared(fx, "backfill")
    tables = (fx.sessions, fx.drivers, fx.telemetry, fx.laps, fx.positions)
    options = {"step_m": 5000.0, "max_gap_ms": 14_400_000, "max_position_gap_ms": 14_400_000, "max_age_ms": 14_400_000}
    run_backfill(root, *tables, limit=10, **options)
    run_backfill(root, *tables, year=2024, session_type="r", **options)
    quality = read_committed(fx.spark, root, "lap_quality", "session_id string").groupBy("session_id").agg(F.count(F.lit(1)).alias("laps"))
    rows = read_committed(fx.spark, root, "lap_distance", DISTANCE).join(quality, "session_id", "left")
    return rows.select("session_id", "driver_code", "lap_number", F.floor(F.col("distance_m") * 100 + 1e-6).alias("distance_cm"), *(F.round(c, 3).alias(c) for c in "xyz"), F.array_join("quality_flags", ",").alias("flags"), "laps")


TIME_SQL = f"""
WITH car AS (SELECT *, epoch_ms(sample_time_utc) AS t FROM fx_telemetry), loc AS (SELECT *, epoch_ms(sample_time_utc) AS t FROM fx_positions),
e AS (SELECT session_id, driver_code, max(lo) AS lo, min(hi) AS hi FROM (SELECT session_id, driver_code, min(t) AS lo, max(t) AS hi FROM car GROUP BY ALL UNION ALL SELECT session_id, driver_code, min(t), max(t) FROM loc GROUP BY ALL) GROUP BY ALL HAVING count(*) = 2),
g AS (SELECT session_id, driver_code, unnest(range(CAST(ceil(lo / 600000) * 600000 AS BIGINT), CAST(floor(hi / 600000) * 600000 AS BIGINT) + 1, 600000)) AS t FROM e),
sp AS (SELECT session_id, driver_code, t, speed_kmh AS v FROM car WHERE speed_kmh IS NOT NULL),
n1 AS (SELECT g.*, a.t AS ca, a.gear, a.session_time_ms AS sa, a.t AS ta FROM g ASOF LEFT JOIN car a ON a.session_id = g.session_id AND a.driver_code = g.driver_code AND a.t <= g.t),
n2 AS (SELECT n1.*, b.t AS cb, b.session_time_ms AS sb FROM n1 ASOF LEFT JOIN car b ON b.session_id = n1.session_id AND b.driver_code = n1.driver_code AND b.t >= n1.t),
n3 AS (SELECT n2.*, p.t AS pt, p.v AS pv FROM n2 ASOF LEFT JOIN sp p ON p.session_id = n2.session_id AND p.driver_code = n2.driver_code AND p.t <= n2.t),
n4 AS (SELECT n3.*, q.t AS qt, q.v AS qv FROM n3 ASOF LEFT JOIN sp q ON q.session_id = n3.session_id AND q.driver_code = n3.driver_code AND q.t >= n3.t),
n5 AS (SELECT n4.*, l.t AS la, l.x AS xa, l.track_status FROM n4 ASOF LEFT JOIN loc l ON l.session_id = n4.session_id AND l.driver_code = n4.driver_code AND l.t <= n4.t),
n6 AS (SELECT n5.*, l.t AS lb, l.x AS xb FROM n5 ASOF LEFT JOIN loc l ON l.session_id = n5.session_id AND l.driver_code = n5.driver_code AND l.t >= n5.t),
v AS (SELECT *, coalesce(t - ca <= 14400000 AND NOT coalesce(cb - ca > 14400000, false), false) AS cv, coalesce(t - la <= 14400000 AND NOT coalesce(lb - la > 14400000, false), false) AS lv,
 CAST(round_even(CASE WHEN sb IS NULL OR cb = ca THEN sa ELSE sa + (sb - sa) * CAST(t - ca AS DOUBLE) / (cb - ca) END, 0) AS BIGINT) AS session_time_ms FROM n6),
w AS ({LAP_MS})
SELECT v.session_id, v.driver_code, v.session_time_ms, CASE WHEN cv THEN round(CASE WHEN pv IS NULL THEN NULL WHEN qv IS NULL OR qt = pt THEN pv ELSE pv + (qv - pv) * (v.t - pt) / (qt - pt) END, 6) END AS speed_kmh, CASE WHEN cv THEN gear END AS gear,
 CASE WHEN lv THEN round(CASE WHEN xb IS NULL OR lb = la THEN xa ELSE xa + (xb - xa) * (v.t - la) / (lb - la) END, 6) END AS x, CASE WHEN lv THEN v.track_status END AS track_status, v.t - ca AS car_age_ms, v.t - la AS location_age_ms,
 CASE WHEN len(f) = 0 THEN 'OK' ELSE array_to_string(f, ',') END AS flags, (SELECT min(lap_number) FROM w WHERE w.session_id = v.session_id AND w.driver_code = v.driver_code AND v.session_time_ms BETWEEN w.lap_start_ms AND w.lap_end_ms) AS lap_number
FROM (SELECT *, list_filter([CASE WHEN ca IS NULL THEN 'MISSING_CAR_DATA' WHEN t - ca > 14400000 THEN 'CAR_SAMPLE_TOO_OLD' END, CASE WHEN la IS NULL THEN 'MISSING_LOCATION_DATA' WHEN t - la > 14400000 THEN 'LOCATION_SAMPLE_TOO_OLD' END, CASE WHEN cb - ca > 14400000 THEN 'CAR_GAP_TOO_LARGE' END, CASE WHEN lb - la > 14400000 THEN 'LOCATION_GAP_TOO_LARGE' END], lambda z: z IS NOT NULL) AS f FROM v) v"""

DIST = """ded AS (SELECT * FROM fx_telemetry WHERE speed_kmh IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, driver_code, lap_number, lap_time_ms ORDER BY sample_time_utc DESC, source_sample_index DESC) = 1),
dd AS (SELECT *, coalesce((lag(speed_kmh) OVER w + speed_kmh) / 2 / 3.6 * (lap_time_ms - lag(lap_time_ms) OVER w) / 1000, 0) AS step, lap_time_ms - lag(lap_time_ms) OVER w AS gap FROM ded WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY lap_time_ms)),
r AS (SELECT *, sum(step) OVER (PARTITION BY session_id, driver_code, lap_number ORDER BY lap_time_ms) AS d FROM dd),
ends AS (SELECT r.session_id, r.driver_code, r.lap_number, max(d) AS end_m, count(*) AS n FROM r JOIN fx_laps l USING (session_id, driver_code, lap_number) WHERE l.lap_time_ms IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND max(d) > 0),
pts AS (SELECT session_id, driver_code, lap_number, end_m, unnest(range(0, CAST(floor(end_m / 5000) AS INT) + 1)) * 5000.0 AS g FROM ends UNION ALL SELECT session_id, driver_code, lap_number, end_m, end_m FROM ends WHERE abs(end_m - floor(end_m / 5000) * 5000) > 1e-8 + 1e-5 * end_m)"""
GRID = f"""{DIST},
j AS (SELECT p.session_id, p.driver_code, p.lap_number, p.end_m, p.g,
 max_by({{'d': r.d, 't': r.lap_time_ms, 's': r.speed_kmh}}, r.lap_time_ms) FILTER (WHERE r.d <= p.g) AS l,
 min_by({{'d': r.d, 't': r.lap_time_ms, 's': r.speed_kmh, 'b': r.brake_pct}}, r.lap_time_ms) FILTER (WHERE r.d >= p.g) AS h,
 max_by({{'d': r.d, 't': r.lap_time_ms, 'b': r.brake_pct}}, r.lap_time_ms) FILTER (WHERE r.d < p.g) AS u
 FROM pts p JOIN r USING (session_id, driver_code, lap_number) GROUP BY ALL),
k AS (SELECT *, CASE WHEN l.d = g OR h.d <= l.d THEN l.t ELSE l.t + (h.t - l.t) * (g - l.d) / (h.d - l.d) END AS e, CASE WHEN l.d = g OR h.d <= l.d THEN l.s ELSE l.s + (h.s - l.s) * (g - l.d) / (h.d - l.d) END AS s,
 CASE WHEN u IS NULL THEN h.b WHEN g - u.d <= h.d - g THEN u.b ELSE h.b END AS b, coalesce(u.t, h.t) AS lt FROM j)"""
DIST_SQL = f"""
WITH {GRID}
SELECT session_id, driver_code, lap_number, CAST(floor(round(g, 3) * 100 + 1e-6) AS BIGINT) AS distance_cm, round(least(1.0, g / end_m), 6) AS lap_progress, CAST(round_even(e, 0) AS BIGINT) AS elapsed_ms, round(s, 4) AS speed_kmh, b AS brake_pct, NOT (l.d = g OR h.d = g) AS interpolated FROM k"""
PLACE = f"""{GRID},
pe AS (SELECT p.session_id, p.driver_code, p.lap_number, (epoch_us(p.sample_time_utc) - epoch_us(l.lap_start_utc)) / 1000.0 AS e, x, y, z FROM fx_positions p JOIN fx_laps l USING (session_id, driver_code, lap_number) WHERE l.lap_time_ms IS NOT NULL AND l.lap_start_utc IS NOT NULL AND (epoch_us(p.sample_time_utc) - epoch_us(l.lap_start_utc)) / 1000.0 BETWEEN 0 AND l.lap_time_ms + 14400000
 QUALIFY row_number() OVER (PARTITION BY p.session_id, p.driver_code, p.lap_number, epoch_us(p.sample_time_utc) ORDER BY source_sample_index DESC) = 1),
m AS (SELECT k.session_id, k.driver_code, k.lap_number, k.g, k.e, max_by({{'e': pe.e, 'x': x, 'y': y, 'z': z}}, pe.e) FILTER (WHERE pe.e <= k.e) AS b, min_by({{'e': pe.e, 'x': x, 'y': y, 'z': z}}, pe.e) FILTER (WHERE pe.e >= k.e) AS a FROM k LEFT JOIN pe USING (session_id, driver_code, lap_number) GROUP BY ALL),
n AS (SELECT *, coalesce(b, a) AS l, coalesce(a, b) AS r FROM m),
o AS (SELECT *, CASE WHEN l IS NULL THEN 'MISSING_POSITION_DATA' WHEN abs(r.e - l.e) > 14400000 THEN 'POSITION_GAP_TOO_LARGE' WHEN round_even(least(abs(e - l.e), abs(r.e - e)), 0) > 14400000 THEN 'POSITION_SAMPLE_TOO_OLD' END AS flag FROM n)"""


def _placed(columns: str) -> str:
    values = ", ".join(f"round(CASE WHEN flag IS NULL AND a IS NOT NULL AND (b IS NOT NULL OR a.e = e) THEN CASE WHEN r.e = e THEN r.{c} ELSE l.{c} + (r.{c} - l.{c}) * (e - l.e) / (r.e - l.e) END END, 3) AS {c}" for c in columns)
    return f"SELECT session_id, driver_code, lap_number, CAST(floor(round(g, 3) * 100 + 1e-6) AS BIGINT) AS distance_cm, coalesce(flag, 'OK') AS flags, {values} FROM o"


PLACE_SQL = f"WITH {PLACE} {_placed('xy')}"
BACKFILL_SQL = f"WITH {PLACE}, q AS (SELECT session_id, count(*) AS laps FROM fx_laps GROUP BY ALL) SELECT d.*, q.laps FROM ({_placed('xyz')}) d JOIN q USING (session_id)"

INGEST = {
    "read_tables": (lambda fx: fx.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s")), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type"),
    "normalize_sessions": (lambda fx: S.normalize_sessions(fx.sessions.select("year", F.concat("event_name", F.lit(" – Ünit/"), "circuit_name").alias("event_name"), "session_type")).select("event_name", "session_id"), r"SELECT concat(event_name, ' – Ünit/', circuit_name) AS event_name, concat(year, '-', regexp_replace(regexp_replace(lower(concat(event_name, ' – Ünit/', circuit_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', lower(session_type)) AS session_id FROM fx_sessions"),
    "normalize_drivers": (lambda fx: S.normalize_drivers(fx.drivers.select("session_id", F.when(F.col("driver_number") % 3 == 0, F.lit(" ")).otherwise(F.lower("driver_code")).alias("code"), F.lower("full_name").alias("reference"), "driver_number"), fx.drivers.where("driver_number > 4").select("driver_code").union(fx.drivers.where("driver_number % 3 = 0").select("full_name"))), "SELECT session_id, driver_number, CASE WHEN driver_number % 3 = 0 THEN upper(full_name) ELSE driver_code END AS driver_code FROM fx_drivers WHERE driver_number > 4 OR driver_number % 3 = 0"),
    "normalize_laps": (lambda fx: S.normalize_laps(fx.laps.drop("lap_id", "lap_end_utc", "is_pit_in_lap", "is_pit_out_lap")).select("lap_id", "is_pit_in_lap", "is_pit_out_lap", "is_deleted", "is_accurate", (F.unix_millis("lap_end_utc") - F.unix_millis("lap_start_utc")).alias("ms")), "SELECT lap_id, pit_in_session_time_ms IS NOT NULL AS is_pit_in_lap, pit_out_session_time_ms IS NOT NULL AS is_pit_out_lap, is_deleted, is_accurate, lap_time_ms AS ms FROM fx_laps"),
    "assign_samples_to_laps": (lambda fx: S.assign_samples_to_laps(fx.telemetry.where("source_sample_index % 3 = 0 or source_sample_index % 5 = 0"), _windows(fx)).select("source_sample_index", "lap_number", "lap_time_ms"), f"WITH w AS ({LAP_MS}) SELECT t.source_sample_index, w.lap_number, t.session_time_ms - w.lap_start_ms AS lap_time_ms FROM fx_telemetry t JOIN w ON w.session_id = t.session_id AND w.driver_code = t.driver_code AND t.session_time_ms BETWEEN w.lap_start_ms AND w.lap_end_ms WHERE t.source_sample_index % 3 = 0 OR t.source_sample_index % 5 = 0 QUALIFY row_number() OVER (PARTITION BY t.source_sample_index ORDER BY w.lap_number) = 1"),
    "normalize_telemetry": (lambda fx: S.normalize_telemetry(fx.telemetry.withColumns({"brake": F.col("brake_pct") * 1.2 - 10, "throttle_pct": F.col("throttle_pct") * 1.1, "speed_kmh": F.when(F.col("gear") == 3, F.lit(float("nan"))).otherwise(F.col("speed_kmh")), "sample_time_utc": F.when(F.col("gear") == 5, None).otherwise(F.col("sample_time_utc"))})).select("source_sample_index", F.round("brake_pct", 6).alias("brake_pct"), F.round("throttle_pct", 6).alias("throttle_pct"), "speed_kmh"), "SELECT source_sample_index, round(least(greatest(brake_pct * 1.2 - 10, 0), 100), 6) AS brake_pct, round(least(greatest(throttle_pct * 1.1, 0), 100), 6) AS throttle_pct, CASE WHEN gear <> 3 THEN speed_kmh END AS speed_kmh FROM fx_telemetry WHERE gear <> 5"),
    "normalize_positions": (lambda fx: S.normalize_positions(fx.positions.withColumn("x", F.when(F.col("x") > 900, F.lit(float("nan"))).otherwise(F.col("x")))).select("source_sample_index", "x", "y"), "SELECT source_sample_index, CASE WHEN x <= 900 THEN x END AS x, y FROM fx_positions"),
    "normalize_weather": (lambda fx: S.normalize_weather(fx.weather.drop("sample_time_utc"), fx.sessions).select("session_id", "session_time_ms", (F.unix_millis("sample_time_utc") % 86_400_000).alias("ms")), "SELECT session_id, session_time_ms, session_time_ms AS ms FROM fx_weather"),
    "normalize_status_events": (lambda fx: S.normalize_status_events(fx.track_status.withColumn("status_code", F.when(F.col("status_code") != "7", F.col("status_code")))).select("session_id", "event_time_ms", "status_code"), "SELECT session_id, event_time_ms, status_code FROM fx_track_status WHERE status_code <> '7'"),
    "normalize_race_control": (lambda fx: S.normalize_race_control(fx.race_control.withColumns({"message": F.when(F.col("race_control_message_id") % 3 > 0, F.col("message")).otherwise(" "), "lap_number": F.col("lap_number") - 1}), fx.sessions.withColumn("session_start_utc", F.col("session_start_utc") + F.expr("interval 2 hours"))).select("race_control_message_id", F.floor(F.col("session_time_ms") / 1000).alias("s"), "lap_number"), "SELECT race_control_message_id, CASE WHEN epoch(message_time_utc) % 86400 >= 7200 THEN CAST(floor(epoch(message_time_utc) % 86400 - 7200) AS BIGINT) END AS s, CASE WHEN lap_number > 1 THEN lap_number - 1 END AS lap_number FROM fx_race_control WHERE race_control_message_id % 3 > 0"),
    "normalize_circuit_markers": (lambda fx: S.normalize_circuit_markers(*(fx.markers.where(F.col("marker_type") == t).drop("marker_type").withColumn("x", F.when(F.col("marker_number") != 7, F.col("x"))) for t in ("corner", "marshal_light", "marshal_sector"))).select("session_id", "marker_type", "marker_number"), "SELECT session_id, marker_type, marker_number FROM fx_markers WHERE marker_number <> 7"),
    "enrich_grid_position": (lambda fx: S.enrich_grid_position(fx.drivers, fx.drivers.select("session_id", "driver_code", F.when(F.col("driver_number") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("driver_number") - 3.0).alias("grid"))).select("session_id", "driver_code", "grid_position"), "SELECT session_id, driver_code, CASE WHEN driver_number % 4 <> 0 AND driver_number >= 3 THEN driver_number - 3 ELSE grid_position END AS grid_position FROM fx_drivers"),
    "dedupe_first_by_key": (lambda fx: S.dedupe_first_by_key(fx.telemetry, ["session_id", "driver_code", "gear"]).select("session_id", "driver_code", "gear", "source_sample_index", "duplicates"), "SELECT session_id, driver_code, gear, min(source_sample_index) AS source_sample_index, count(*) - 1 AS duplicates FROM fx_telemetry GROUP BY ALL"),
    "check_constraints": (lambda fx: S.check_constraints({"sessions": fx.sessions, "drivers": fx.drivers.withColumn("grid_position", F.col("grid_position") - 2), "laps": fx.laps, "telemetry": fx.telemetry.withColumn("throttle_pct", F.col("throttle_pct") + 5), "markers": fx.markers.withColumn("session_id", F.when(F.col("marker_number") == 3, "none").otherwise(F.col("session_id")))}), "SELECT * FROM (SELECT 'drivers' AS table_name, 'grid_not_negative' AS rule, count(*) AS violations FROM fx_drivers WHERE grid_position < 2 UNION ALL SELECT 'telemetry', 'throttle_range', count(*) FROM fx_telemetry WHERE throttle_pct > 95 UNION ALL SELECT 'telemetry', 'speed_not_negative', count(*) FROM fx_telemetry WHERE speed_kmh < 0 UNION ALL SELECT 'markers', 'session_reference', count(*) FROM fx_markers WHERE marker_number = 3) WHERE violations > 0"),
    "ingest_manifest": (lambda fx: S.ingest_manifest(fx.laps, fx.telemetry.where("gear > 2"), fx.positions).select("session_id", "driver_code", "laps", "telemetry_samples", "position_samples", F.array_join(F.col("laps_without_telemetry").cast("array<string>"), ",").alias("no_car"), F.array_join(F.col("laps_without_positions").cast("array<string>"), ",").alias("no_place"), "session_empty"), "WITH l AS (SELECT l.session_id, l.driver_code, l.lap_number, (SELECT count(*) FROM fx_telemetry t WHERE t.session_id = l.session_id AND t.driver_code = l.driver_code AND t.lap_number = l.lap_number AND gear > 2) AS t, (SELECT count(*) FROM fx_positions t WHERE t.session_id = l.session_id AND t.driver_code = l.driver_code AND t.lap_number = l.lap_number) AS p FROM fx_laps l) SELECT session_id, driver_code, count(*) AS laps, CAST(sum(t) AS BIGINT) AS telemetry_samples, CAST(sum(p) AS BIGINT) AS position_samples, coalesce(string_agg(CASE WHEN t = 0 THEN CAST(lap_number AS VARCHAR) END, ',' ORDER BY lap_number), '') AS no_car, coalesce(string_agg(CASE WHEN p = 0 THEN CAST(lap_number AS VARCHAR) END, ',' ORDER BY lap_number), '') AS no_place, false AS session_empty FROM l GROUP BY ALL"),
    "first_laps": (lambda fx: S.first_laps(fx.laps, 2).select("lap_id"), "SELECT lap_id FROM fx_laps QUALIFY row_number() OVER (PARTITION BY session_id, driver_code ORDER BY lap_number) <= 2"),
    "dedupe_stream": (lambda fx: T.dedupe_stream(fx.telemetry.withColumn("sample_time_utc", F.date_trunc("hour", "sample_time_utc"))).select("source_sample_index"), "SELECT source_sample_index FROM fx_telemetry QUALIFY row_number() OVER (PARTITION BY session_id, driver_code, date_trunc('hour', sample_time_utc) ORDER BY source_sample_index DESC) = 1"),
    "stream_diagnostics": (lambda fx: r6(T.stream_diagnostics(fx.telemetry, 3_600_000), "min_delta_ms", "median_delta_ms", "p90_delta_ms", "p99_delta_ms", "max_delta_ms").select("session_id", "driver_code", "samples", "min_delta_ms", "median_delta_ms", "p90_delta_ms", "p99_delta_ms", "max_delta_ms", "duplicates", "out_of_order", F.array_join("warning_flags", ",").alias("warnings")), f"WITH d AS (SELECT *, {DELTA} AS d FROM fx_telemetry), g AS (SELECT session_id, driver_code, count(*) AS samples, round(min(d) FILTER (WHERE d > 0), 6) AS min_delta_ms, " + ", ".join(f"round(quantile_cont(CASE WHEN d > 0 THEN d END, {q}), 6) AS {n}_delta_ms" for q, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))) + ", round(max(d) FILTER (WHERE d > 0), 6) AS max_delta_ms, count(*) - count(DISTINCT sample_time_utc) AS duplicates, count(*) FILTER (WHERE d < 0) AS out_of_order FROM d GROUP BY ALL) SELECT *, concat_ws(',', CASE WHEN duplicates > 0 THEN 'DUPLICATE_SOURCE_TIMESTAMP' END, CASE WHEN out_of_order > 0 THEN 'OUT_OF_ORDER_SOURCE_DATA' END, CASE WHEN max_delta_ms > 3600000 THEN 'SOURCE_GAP_TOO_LARGE' END) AS warnings FROM g"),
    "ingestion_diagnostics": (lambda fx: A.ingestion_diagnostics(T.stream_diagnostics(fx.telemetry, 3_600_000), fx.sessions).select("session_id", "driver_code", "event_name", "warning_flags"), f"WITH d AS (SELECT *, {DELTA} AS d FROM fx_telemetry), g AS (SELECT session_id, driver_code, max(d) AS m, count(*) FILTER (WHERE d < 0) AS o, count(*) - count(DISTINCT sample_time_utc) AS u FROM d GROUP BY ALL) SELECT session_id, driver_code, event_name, concat_ws(',', CASE WHEN u > 0 THEN 'DUPLICATE_SOURCE_TIMESTAMP' END, CASE WHEN o > 0 THEN 'OUT_OF_ORDER_SOURCE_DATA' END, CASE WHEN m > 3600000 THEN 'SOURCE_GAP_TOO_LARGE' END) AS warning_flags FROM g JOIN fx_sessions USING (session_id)"),
    "align_time_grid": (lambda fx: r6(_aligned(fx), "speed_kmh", "x").select("session_id", "driver_code", "session_time_ms", "speed_kmh", "gear", "x", "track_status", "car_age_ms", "location_age_ms", F.array_join("quality_flags", ",").alias("flags"), "lap_number"), TIME_SQL),
    "project_distance_grid": (lambda fx: T.project_distance_grid(fx.telemetry, fx.laps, None, 5000.0, 14_400_000, 14_400_000).select("session_id", "driver_code", "lap_number", F.floor(F.col("distance_m") * 100 + 1e-6).alias("distance_cm"), "lap_progress", "elapsed_ms", F.round(F.round("speed_kmh", 12), 4).alias("speed_kmh"), "brake_pct", "interpolated"), DIST_SQL),
    "project_distance_positions": (lambda fx: T.project_distance_grid(fx.telemetry, fx.laps, fx.positions, 5000.0, 14_400_000, 14_400_000).select("session_id", "driver_code", "lap_number", F.floor(F.col("distance_m") * 100 + 1e-6).alias("distance_cm"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.array_join("quality_flags", ",").alias("flags")), PLACE_SQL),
    "lap_quality_report": (lambda fx: T.lap_quality_report(fx.telemetry, fx.laps, T.project_distance_grid(fx.telemetry, fx.laps, None, 5000.0, 14_400_000, 14_400_000), 14_400_000, 14_400_000, 100).select("session_id", "driver_code", "lap_number", "covered_ms", "first_offset_ms", "last_offset_ms", F.floor(F.col("final_distance_m") * 100 + 1e-6).alias("final_cm"), "finish_mismatch_ms", F.array_join("quality_messages", ",").alias("messages"), "quality_status"), f"WITH {DIST}, c AS (SELECT session_id, driver_code, lap_number, count(*) AS n, min(lap_time_ms) AS t0, max(lap_time_ms) AS t1, max(gap) AS gap, max(d) AS dist FROM r GROUP BY ALL), b AS (SELECT l.*, (SELECT count(*) FROM fx_telemetry t WHERE t.session_id = l.session_id AND t.driver_code = l.driver_code AND t.lap_number = l.lap_number) AS raw, coalesce(c.n, 0) AS n, c.t0, c.t1, c.gap, c.dist FROM fx_laps l LEFT JOIN c USING (session_id, driver_code, lap_number)), u AS (SELECT *, raw >= 2 AND n >= 2 AND lap_time_ms IS NOT NULL AS ok FROM b), m AS (SELECT *, concat_ws(',', CASE WHEN is_pit_in_lap THEN 'WARNING_PIT_IN_LAP' END, CASE WHEN is_pit_out_lap THEN 'WARNING_PIT_OUT_LAP' END, CASE WHEN is_deleted THEN 'WARNING_DELETED_LAP' END, CASE WHEN NOT is_accurate THEN 'WARNING_INACCURATE_LAP' END, CASE WHEN lap_time_ms IS NULL THEN 'INVALID_MISSING_OFFICIAL_LAP_DURATION' END, CASE WHEN raw < 2 THEN 'INVALID_MISSING_CAR_TELEMETRY' END, CASE WHEN raw >= 2 AND n < 2 THEN 'INVALID_INSUFFICIENT_CAR_TELEMETRY' END, CASE WHEN ok AND NOT dist > 0 THEN 'INVALID_NON_POSITIVE_FINAL_DISTANCE' END, CASE WHEN ok AND gap > 14400000 THEN 'INCOMPLETE_CAR_GAP_TOO_LARGE' END, CASE WHEN ok AND t0 > 14400000 THEN 'INCOMPLETE_LATE_LAP_START_COVERAGE' END, CASE WHEN ok AND lap_time_ms - t1 > 14400000 THEN 'INCOMPLETE_EARLY_LAP_END_COVERAGE' END, CASE WHEN ok AND dist > 0 AND abs(t1 - lap_time_ms) > 100 THEN 'INCOMPLETE_PROJECTED_FINISH_MISMATCH' END) AS messages FROM u) SELECT session_id, driver_code, lap_number, CASE WHEN ok THEN t1 - t0 END AS covered_ms, CASE WHEN ok THEN t0 END AS first_offset_ms, CASE WHEN ok THEN greatest(0, lap_time_ms - t1) END AS last_offset_ms, CASE WHEN ok THEN CAST(floor(dist * 100 + 1e-6) AS BIGINT) END AS final_cm, CASE WHEN ok AND dist > 0 THEN abs(t1 - lap_time_ms) END AS finish_mismatch_ms, messages, CASE WHEN contains(messages, 'INVALID_') THEN 'invalid' WHEN contains(messages, 'INCOMPLETE_') THEN 'incomplete' WHEN messages <> '' THEN 'valid_with_warnings' ELSE 'valid' END AS quality_status FROM m"),
    "write_session": (_written_sessions, "SELECT session_id, count(*) AS laps, sum(lap_time_ms + CASE WHEN lap_number >= 3 THEN 1 ELSE 0 END) AS lap_time_ms FROM fx_laps WHERE session_id <> '2024-day05-r' OR lap_number = 1 GROUP BY ALL"),
    "save_table": (_saved_table, "SELECT session_id, count(*) AS laps, count(*) AS laps_csv, string_agg(DISTINCT compound, ',' ORDER BY compound) AS compounds, string_agg(DISTINCT compound, ',' ORDER BY compound) AS compounds_csv FROM fx_laps GROUP BY session_id"),
    "backfill_distance": (_backfilled, BACKFILL_SQL),
}
