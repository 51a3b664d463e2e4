"""Queries and SQL of the data-quality analytics over the fixture tables. Lap limits are scaled to the sparse fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import grids as T
from ..operators import quality as D
from ..operators import sequences as W
from .core import FAMILY, LAP_MS, TAXONOMY_SQL, lap_windows, r6

LIMITS = D.LapThresholds(min_car_samples=2, min_position_samples=2, min_lap_coverage_ratio=0.2, path_length_tolerance_pct=0.6, telemetry_p95_gap_ms=9_000_000, telemetry_max_gap_ms=9_500_000, shape_rms_min_kmh=40, shape_required_bins=2, position_segment_mad_multiplier=2)
WIDTH = 1_800_000


def features(fx):
    return D.lap_quality_features(fx.laps, lap_windows(fx), fx.telemetry, fx.positions, fx.drivers, fx.track_status, fx.race_control)


def derived(fx):
    return D.derived_lap_features(features(fx), A.speed_profile(fx.telemetry, fx.laps), LIMITS)


def classified(fx):
    return D.classify_laps(derived(fx), LIMITS)


def windows(fx):
    return D.quality_windows(fx.aligned, fx.laps, fx.race_control, fx.track_status, WIDTH)


def surfaces(fx):
    wide = A.session_surface_features(fx.sessions, fx.drivers, fx.laps, fx.telemetry, fx.positions, fx.aligned, fx.weather, fx.track_status, fx.race_control, fx.markers, fx.circuits)
    return D.surface_flags(fx.sessions, wide, fx.drivers, fx.markers, W.weather_max_gap(fx.weather), fx.session_status, T.stream_diagnostics(fx.telemetry, 14_400_000))


def coverage(fx):
    t = lambda df, c="session_time_ms": df.select("session_id", F.col(c).alias("t"))
    place = fx.positions.select("session_id", (F.unix_millis("sample_time_utc") % 86_400_000).alias("t"))
    return D.session_duration_coverage(fx.sessions, {"telemetry": t(fx.telemetry), "position": place, "aligned": t(fx.aligned), "weather": t(fx.weather), "track_status": t(fx.track_status, "event_time_ms"), "session_status": t(fx.session_status, "event_time_ms"), "race_control": t(fx.race_control)})


def intervals(fx):
    return W.status_intervals(fx.track_status, fx.telemetry.groupBy("session_id").agg(F.max("session_time_ms").alias("duration_ms")))


def bins(fx):
    return D.context_timeline(windows(fx), fx.race_control, W.rain_transitions(fx.weather), intervals(fx), 3_600_000)


def watch(fx):
    return D.replay_watchlist(A.aligned_quality_by(fx.aligned, "driver"), W.degraded_segments(fx.aligned, 3_600_000), windows(fx))


def markers(fx):
    return D.marker_summary(fx.sessions, D.marker_quality(fx.markers, fx.positions), fx.circuits)


BIN = ", ".join(f"round(avg(speed_kmh) FILTER (WHERE bin = {k}), 12) AS b{k}" for k in range(1, 21))
RMS = " + ".join(f"coalesce(power(b{k} - m{k}, 2), 0)" for k in range(1, 21))
NRES = " + ".join(f"CASE WHEN b{k} - m{k} IS NOT NULL THEN 1 ELSE 0 END" for k in range(1, 21))
def features_sql(t: D.LapThresholds) -> str:
    """Lap features and their classes under limits, as CTEs: lw, ... d2, c0, cl."""
    return f"""lw AS ({LAP_MS}),
car AS (SELECT session_id, driver_code, lap_number, count(*) AS car_samples, min(lap_time_ms) AS t0, max(lap_time_ms) AS t1, min(speed_kmh) AS s0, max(speed_kmh) AS s1, min(rpm) AS r0, max(rpm) AS r1, min(throttle_pct) AS th0, max(throttle_pct) AS th1, min(gear) AS g0, max(gear) AS g1, count(*) FILTER (WHERE speed_kmh IS NULL) AS nulls FROM fx_telemetry GROUP BY ALL),
gd AS (SELECT session_id, driver_code, lap_number, (epoch_us(sample_time_utc) - lag(epoch_us(sample_time_utc)) OVER w) / 1000.0 AS d, lap_time_ms - lag(lap_time_ms) OVER w AS l FROM fx_telemetry WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY source_sample_index)),
gap AS (SELECT session_id, driver_code, lap_number, count(*) FILTER (WHERE d < 0) AS back, count(*) FILTER (WHERE l < 0) AS lback, max(d) FILTER (WHERE d > 0) AS gmax, quantile_cont(CASE WHEN d > 0 THEN d END, 0.95) AS gp95 FROM gd GROUP BY ALL),
pd AS (SELECT session_id, driver_code, lap_number, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS s FROM fx_positions WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY sample_time_utc, source_sample_index)),
pos AS (SELECT session_id, driver_code, lap_number, count(*) AS position_samples, sum(s) AS path, max(s) AS seg FROM pd GROUP BY ALL),
st AS (SELECT l.lap_id, count(*) FILTER (WHERE status_code = '4') AS sc, count(*) FILTER (WHERE status_code IN ('6', '7')) AS vsc, count(*) FILTER (WHERE status_code = '5') AS red FROM lw l JOIN v_periods p ON p.session_id = l.session_id AND p.start_time_ms <= l.lap_end_ms AND (p.end_time_ms IS NULL OR p.end_time_ms >= l.lap_start_ms) GROUP BY l.lap_id),
tb AS (SELECT t.session_id, t.driver_code, t.lap_number, t.speed_kmh, least(20, greatest(1, CASE WHEN t.lap_time_ms >= l.lap_time_ms THEN 21 ELSE CAST(floor(20.0 * t.lap_time_ms / l.lap_time_ms) AS INT) + 1 END)) AS bin FROM fx_telemetry t JOIN fx_laps l USING (session_id, driver_code, lap_number) WHERE l.lap_time_ms > 0),
prof AS (SELECT session_id, driver_code, lap_number, {BIN} FROM tb GROUP BY ALL),
f AS (SELECT l.*, coalesce(car_samples, 0) AS car_samples, t0, t1, s0, s1, r0, r1, g0, g1, th0, th1, nulls, back, lback, gmax, gp95, coalesce(position_samples, 0) AS position_samples, path, seg, coalesce(sc, 0) AS sc, coalesce(vsc, 0) AS vsc, coalesce(red, 0) AS red, {', '.join(f'b{k}' for k in range(1, 21))}, CAST(t1 - t0 AS DOUBLE) / lap_time_ms AS cov
 FROM fx_laps l LEFT JOIN car USING (session_id, driver_code, lap_number) LEFT JOIN gap USING (session_id, driver_code, lap_number) LEFT JOIN pos USING (session_id, driver_code, lap_number) LEFT JOIN prof USING (session_id, driver_code, lap_number) LEFT JOIN st USING (lap_id)),
fr AS (SELECT *, coalesce(is_accurate, false) AND NOT is_pit_in_lap AND NOT is_pit_out_lap AND position_samples >= {t.min_position_samples} AND path IS NOT NULL AND coalesce(cov >= {t.min_lap_coverage_ratio}, false) AS ref FROM f),
m1 AS (SELECT session_id, median(path) AS mpath, median(seg) AS mseg, {', '.join(f'median(b{k}) AS m{k}' for k in range(1, 21))} FROM fr WHERE ref GROUP BY ALL),
m2 AS (SELECT fr.session_id, median(abs(seg - mseg)) AS mad FROM fr JOIN m1 USING (session_id) WHERE ref AND seg IS NOT NULL GROUP BY ALL),
m3 AS (SELECT session_id, quantile_cont(seg, 0.99) AS q99 FROM f GROUP BY ALL),
d1 AS (SELECT fr.*, path / mpath AS ratio, coalesce(mseg + {t.position_segment_mad_multiplier} * nullif(mad, 0), q99) AS seglimit, CASE WHEN {NRES} > 0 THEN sqrt(({RMS}) / ({NRES})) END AS rms, {' + '.join(f'CASE WHEN b{k} IS NOT NULL THEN 1 ELSE 0 END' for k in range(1, 21))} AS nbins FROM fr LEFT JOIN m1 USING (session_id) LEFT JOIN m2 USING (session_id) LEFT JOIN m3 USING (session_id)),
m4 AS (SELECT session_id, median(rms) AS mrms, quantile_cont(rms, 0.75) - quantile_cont(rms, 0.25) AS iqr FROM d1 WHERE ref AND rms IS NOT NULL GROUP BY ALL),
d2 AS (SELECT d1.*, mrms, iqr, mrms + greatest({t.shape_rms_min_kmh}, {t.shape_rms_iqr_multiplier} * coalesce(iqr, 0)) AS shapelimit FROM d1 LEFT JOIN m4 USING (session_id)),
c0 AS (SELECT *, car_samples < {t.min_car_samples} OR position_samples < {t.min_position_samples} AS c1, lap_time_ms IS NULL OR coalesce(cov < {t.min_lap_coverage_ratio}, false) AS c2, false AS c3,
 coalesce(s0 < 0, false) OR coalesce(s1 > 380, false) OR coalesce(r0 < 0, false) OR coalesce(r1 > 16000, false) OR coalesce(th1 > 100, false) OR coalesce(g1 > 9, false) AS c4, coalesce(nbins >= {t.shape_required_bins} AND rms > shapelimit, false) AS c5,
 coalesce(ratio < 1.0 - {t.path_length_tolerance_pct}, false) OR coalesce(ratio > 1.0 + {t.path_length_tolerance_pct}, false) OR (ratio IS NOT NULL AND coalesce(seg > seglimit, false)) AS c6, is_pit_in_lap OR is_pit_out_lap OR sc > 0 OR vsc > 0 OR red > 0 AS c7,
 coalesce(back > 0, false) OR coalesce(lback > 0, false) OR coalesce(gp95 > {t.telemetry_p95_gap_ms}, false) OR coalesce(gmax > {t.telemetry_max_gap_ms}, false) AS c8, NOT coalesce(is_accurate, true) OR is_deleted AS c9 FROM d2),
cl AS (SELECT *, c5 AND NOT (c1 OR c2 OR c4 OR c6 OR c7 OR c8 OR c9) AS c10, c1 OR c2 OR c4 OR c5 OR c6 OR c7 OR c8 OR c9 AS bad, CASE WHEN c1 THEN 'missing_or_sparse_telemetry' WHEN c8 THEN 'timing_session_boundary_artifact' WHEN c2 THEN 'incomplete_lap_window' WHEN c4 THEN 'implausible_channel_values' WHEN c6 THEN 'position_trace_discontinuity' WHEN c7 THEN 'pit_lane_or_safety_car_influenced' WHEN c5 THEN 'shape_mismatch_against_comparable_laps' WHEN c9 THEN 'import_or_source_data_anomaly' ELSE 'clean' END AS prim,
 CASE WHEN c1 OR c2 OR c4 OR c6 OR c8 THEN 'exclude' WHEN (c5 AND NOT (c1 OR c2 OR c4 OR c6 OR c8 OR c9) AND NOT c7) OR c4 THEN 'manual_review' WHEN c7 OR c9 THEN 'keep_with_context_label' ELSE 'keep' END AS advice FROM c0)"""


FEATURES = features_sql(LIMITS)
TAX = f"tx AS (SELECT *, {TAXONOMY_SQL} AS taxonomy FROM (SELECT *, lower(concat(coalesce(category, ''), ' ', coalesce(flag, ''), ' ', coalesce(scope, ''), ' ', coalesce(status, ''), ' ', coalesce(message, ''))) AS x FROM fx_race_control))"
INC = "taxonomy IN ('flags', 'safety_car', 'vsc', 'red_flag', 'investigations_noted', 'penalties')"
WIN = f"""{TAX}, wf AS (SELECT a.*, CAST(floor(a.session_time_ms / {WIDTH}) * {WIDTH} AS BIGINT) AS window_start_ms, {FAMILY} AS family, coalesce(l.is_pit_in_lap OR l.is_pit_out_lap, false) AS pit FROM fx_aligned a LEFT JOIN fx_laps l USING (session_id, driver_code, lap_number)),
w1 AS (SELECT session_id, driver_code, window_start_ms, count(*) AS samples, count(*) FILTER (WHERE family <> 'OK') AS not_ok, count(*) FILTER (WHERE pit) AS pit_lap_rows, 100.0 * count(*) FILTER (WHERE family <> 'OK') / count(*) AS non_ok_pct FROM wf GROUP BY ALL),
w2 AS (SELECT session_id, CAST(floor(session_time_ms / {WIDTH}) * {WIDTH} AS BIGINT) AS window_start_ms, count(*) AS messages, count(*) FILTER (WHERE {INC}) AS incident_messages FROM tx WHERE session_time_ms IS NOT NULL GROUP BY ALL),
w3 AS (SELECT DISTINCT w1.session_id, w1.window_start_ms FROM w1 JOIN v_periods p ON p.session_id = w1.session_id AND p.status_code <> '1' AND p.start_time_ms < w1.window_start_ms + {WIDTH} AND (p.end_time_ms IS NULL OR p.end_time_ms > w1.window_start_ms)),
win AS (SELECT w1.*, coalesce(messages, 0) AS messages, coalesce(incident_messages, 0) AS incident_messages, w3.session_id IS NOT NULL AS has_status_context, coalesce(messages, 0) > 0 AS has_race_control_context, pit_lap_rows > 0 AS has_pit_context, w3.session_id IS NOT NULL OR coalesce(incident_messages, 0) > 0 AS has_incident_context FROM w1 LEFT JOIN w2 USING (session_id, window_start_ms) LEFT JOIN w3 USING (session_id, window_start_ms))"""
ICOLS = "SELECT session_id, status_code, start_time_ms, coalesce(end_time_ms, (SELECT max(session_time_ms) FROM fx_telemetry t WHERE t.session_id = p.session_id)) AS end_time_ms FROM v_periods p"
BINS = f"""{WIN}, o AS (SELECT session_id, CAST(floor(window_start_ms / 3600000) * 3600000 AS BIGINT) AS bin_start_ms, count(*) AS driver_windows, count(*) FILTER (WHERE non_ok_pct >= 1) AS degraded_driver_windows, count(*) FILTER (WHERE non_ok_pct >= 10) AS severe_driver_windows, max(non_ok_pct) AS max_non_ok_pct FROM win GROUP BY ALL),
sd AS (SELECT session_id, CAST(floor(session_time_ms / 3600000) * 3600000 AS BIGINT) AS bin_start_ms, count(*) AS messages, count(*) FILTER (WHERE {INC}) AS incident_messages FROM tx WHERE session_time_ms IS NOT NULL GROUP BY ALL),
rd AS (SELECT session_id, session_time_ms, rainfall, lag(rainfall) OVER (PARTITION BY session_id ORDER BY session_time_ms, sample_time_utc) AS p FROM fx_weather),
rn AS (SELECT session_id, CAST(floor(session_time_ms / 3600000) * 3600000 AS BIGINT) AS bin_start_ms, count(*) AS rainfall_transitions FROM rd WHERE p IS NOT NULL AND (rainfall IS NULL OR rainfall <> p) GROUP BY ALL),
tc AS (SELECT DISTINCT o.session_id, o.bin_start_ms FROM o JOIN ({ICOLS}) i ON i.session_id = o.session_id AND i.status_code <> '1' AND i.end_time_ms >= i.start_time_ms AND i.end_time_ms >= o.bin_start_ms AND i.start_time_ms < o.bin_start_ms + 3600000),
bn AS (SELECT o.*, coalesce(messages, 0) AS messages, coalesce(incident_messages, 0) AS incident_messages, coalesce(rainfall_transitions, 0) AS rainfall_transitions, tc.session_id IS NOT NULL AS has_status_context, CAST(degraded_driver_windows AS DOUBLE) / driver_windows AS degraded_window_rate, tc.session_id IS NOT NULL OR coalesce(incident_messages, 0) > 0 OR coalesce(rainfall_transitions, 0) > 0 AS has_context_event FROM o LEFT JOIN sd USING (session_id, bin_start_ms) LEFT JOIN rn USING (session_id, bin_start_ms) LEFT JOIN tc USING (session_id, bin_start_ms))"""


MARK = """b AS (SELECT session_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, quantile_cont(x, 0.01) AS xa, quantile_cont(x, 0.99) AS xb, quantile_cont(y, 0.01) AS ya, quantile_cont(y, 0.99) AS yb FROM fx_positions GROUP BY ALL),
mq AS (SELECT m.*, b.n, coalesce(x < x0 - greatest((x1 - x0) * 0.08, 500) OR x > x1 + greatest((x1 - x0) * 0.08, 500) OR y < y0 - greatest((y1 - y0) * 0.08, 500) OR y > y1 + greatest((y1 - y0) * 0.08, 500), false) AS om, coalesce(x < xa - greatest((xb - xa) * 0.05, 250) OR x > xb + greatest((xb - xa) * 0.05, 250) OR y < ya - greatest((yb - ya) * 0.05, 250) OR y > yb + greatest((yb - ya) * 0.05, 250), false) AS oc FROM fx_markers m LEFT JOIN b USING (session_id)),
ms AS (SELECT s.session_id, s.event_name, count(m.session_id) AS marker_count, count(*) FILTER (WHERE marker_type = 'corner') AS corner_markers, count(*) FILTER (WHERE m.session_id IS NOT NULL AND distance_m IS NULL) AS nulls, count(*) FILTER (WHERE om) AS om, count(*) FILTER (WHERE oc) AS oc, coalesce(max(n), 0) AS n FROM fx_sessions s LEFT JOIN mq m USING (session_id) GROUP BY ALL),
ml AS (SELECT *, CASE WHEN n = 0 OR marker_count = 0 THEN 'needs_reimport' WHEN om > 0 THEN 'needs_manual_review' WHEN corner_markers < 5 THEN 'partial' WHEN oc > 0 OR nulls > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS circuit_context_readiness FROM ms)"""
SURFACE = """dv AS (SELECT session_id, count(*) AS drivers, count(*) FILTER (WHERE driver_number IS NULL OR team_name IS NULL) AS bare FROM fx_drivers GROUP BY ALL),
lp AS (SELECT session_id, count(*) AS laps, count(*) FILTER (WHERE lap_time_ms IS NULL) AS untimed FROM fx_laps GROUP BY ALL),
cr AS (SELECT session_id, count(*) AS n, count(DISTINCT driver_code) AS drv, count(*) FILTER (WHERE speed_kmh IS NULL) AS nulls FROM fx_telemetry GROUP BY ALL),
ps AS (SELECT session_id, count(*) AS n, count(DISTINCT driver_code) AS drv, count(*) FILTER (WHERE x IS NULL) AS nulls FROM fx_positions GROUP BY ALL),
al AS (SELECT session_id, count(*) AS n, 100.0 * count(*) FILTER (WHERE NOT list_contains(quality_flags, 'OK')) / count(*) AS bad FROM fx_aligned GROUP BY ALL),
we AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE air_temp_c IS NULL) + count(*) FILTER (WHERE track_temp_c IS NULL) + count(*) FILTER (WHERE rainfall IS NULL) AS nulls, max(gap) AS gap FROM (SELECT *, session_time_ms - lag(session_time_ms) OVER (PARTITION BY session_id ORDER BY session_time_ms, sample_time_utc) AS gap FROM fx_weather) GROUP BY ALL),
ts AS (SELECT session_id, count(*) AS n FROM fx_track_status GROUP BY ALL), ss AS (SELECT session_id, count(*) AS n FROM fx_session_status GROUP BY ALL),
rc AS (SELECT session_id, count(*) AS n, 100.0 * count(*) FILTER (WHERE session_time_ms IS NULL) / count(*) AS untimed FROM fx_race_control GROUP BY ALL),
mk AS (SELECT session_id, count(*) FILTER (WHERE marker_type = 'corner') AS corners, count(*) FILTER (WHERE distance_m IS NULL) AS nulls, count(*) AS n FROM fx_markers GROUP BY ALL),
dl AS (SELECT session_id, driver_code, sample_time_utc, (epoch_us(sample_time_utc) - lag(epoch_us(sample_time_utc)) OVER (PARTITION BY session_id, driver_code ORDER BY source_sample_index)) / 1000.0 AS d FROM fx_telemetry),
dg AS (SELECT session_id, bool_or(w) AS warned FROM (SELECT session_id, driver_code, count(*) > count(DISTINCT sample_time_utc) OR count(*) FILTER (WHERE d < 0) > 0 OR coalesce(max(d) > 14400000, false) AS w FROM dl GROUP BY ALL) GROUP BY ALL),
sf AS (SELECT s.session_id, session_start_utc IS NULL OR event_name IS NULL OR country IS NULL AS session_metadata_incomplete,
 coalesce(drivers, 0) < 15 OR coalesce(bare, 0) > 0 AS driver_metadata_sparse, coalesce(laps, 0) = 0 OR coalesce(drivers, 0) < 15 OR coalesce(lp.untimed, 0) > 0 AS lap_metadata_incomplete,
 coalesce(cr.drv, 0) < 10 OR coalesce(cr.nulls, 1) > 0 AS raw_telemetry_coverage_issue, coalesce(ps.drv, 0) < 10 OR coalesce(ps.nulls, 1) > 0 AS raw_position_coverage_issue,
 coalesce(al.bad, 100) > 5 AS aligned_replay_quality_issue, coalesce(warned, false) AS ingestion_diagnostic_warning, coalesce(we.n, 0) < 2 OR coalesce(we.nulls, 1) > 0 OR coalesce(gap, 0) > 180000 AS weather_surface_issue,
 ts.n IS NULL OR ss.n IS NULL AS status_timeline_sparse, rc.n IS NULL OR rc.untimed > 10 AS race_control_sparse_or_untimed, coalesce(mk.n, 0) = 0 OR coalesce(corners, 0) < 5 OR coalesce(mk.nulls, 0) > 0 AS circuit_annotation_issue, round(al.bad, 6) AS aligned_non_ok_pct
 FROM fx_sessions s LEFT JOIN dv USING (session_id) LEFT JOIN lp USING (session_id) LEFT JOIN cr USING (session_id) LEFT JOIN ps USING (session_id) LEFT JOIN al USING (session_id) LEFT JOIN we USING (session_id) LEFT JOIN ts USING (session_id) LEFT JOIN ss USING (session_id) LEFT JOIN rc USING (session_id) LEFT JOIN mk USING (session_id) LEFT JOIN dg USING (session_id))"""
COVER = """t AS (SELECT session_id, 'telemetry' AS surface, session_time_ms AS t FROM fx_telemetry UNION ALL SELECT session_id, 'position', epoch_us(sample_time_utc) // 1000 % 86400000 FROM fx_positions UNION ALL SELECT session_id, 'aligned', session_time_ms FROM fx_aligned UNION ALL SELECT session_id, 'weather', session_time_ms FROM fx_weather UNION ALL SELECT session_id, 'track_status', event_time_ms FROM fx_track_status UNION ALL SELECT session_id, 'session_status', event_time_ms FROM fx_session_status UNION ALL SELECT session_id, 'race_control', session_time_ms FROM fx_race_control),
w AS (SELECT session_id, surface, min(t) AS a, max(t) AS b FROM t GROUP BY ALL),
s AS (SELECT session_id, max(b) AS dur, coalesce(max(a) FILTER (WHERE surface = 'aligned'), min(a) FILTER (WHERE surface IN ('telemetry', 'position'))) AS a0, coalesce(max(b) FILTER (WHERE surface = 'aligned'), max(b) FILTER (WHERE surface IN ('telemetry', 'position'))) AS b0 FROM w GROUP BY ALL),
c AS (SELECT s.session_id, k.surface, CASE WHEN a IS NOT NULL THEN greatest(b - a, 0) END / nullif(dur, 0)::DOUBLE AS cov, CASE WHEN a IS NOT NULL THEN greatest(least(b, b0) - greatest(a, a0), 0) END / nullif(b0 - a0, 0)::DOUBLE AS act, a - a0 AS late, b0 - b AS early FROM s CROSS JOIN (SELECT DISTINCT surface FROM t) k LEFT JOIN w ON w.session_id = s.session_id AND w.surface = k.surface)"""


WATCH = f"""ad AS (SELECT session_id, driver_code, 100.0 * count(*) FILTER (WHERE {FAMILY} <> 'OK') / count(*) AS pct FROM fx_aligned GROUP BY ALL),
d0 AS (SELECT *, CASE WHEN session_time_ms - lag(session_time_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS fresh FROM fx_aligned WHERE {FAMILY} <> 'OK' WINDOW w AS (PARTITION BY session_id, driver_code ORDER BY session_time_ms)),
d1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, driver_code ORDER BY session_time_ms) AS seg FROM d0),
sg AS (SELECT session_id, driver_code, seg, greatest(max(session_time_ms) - min(session_time_ms) + 100, 100) AS dur FROM d1 GROUP BY ALL),
lg AS (SELECT session_id, driver_code, max(dur) AS longest, count(*) FILTER (WHERE dur >= 2000) AS over2 FROM sg GROUP BY ALL),
sw AS (SELECT session_id, driver_code, count(*) FILTER (WHERE non_ok_pct >= 1) AS degraded, count(*) FILTER (WHERE non_ok_pct >= 10) AS severe, max(non_ok_pct) AS most FROM win GROUP BY ALL),
wa AS (SELECT session_id, driver_code, coalesce(longest, 0) AS longest_segment_ms, coalesce(severe, 0) AS severe_windows, coalesce(degraded, 0) AS degraded_windows, pct * 4 + coalesce(most, 0) * 0.8 + coalesce(over2, 0) * 2 + coalesce(severe, 0) * 0.5 AS risk,
 CASE WHEN longest >= 5000 THEN 'warn_before_replay' WHEN severe >= 3 OR pct >= 5 THEN 'show_replay_quality_overlay' WHEN degraded > 0 THEN 'diagnostics_only' ELSE 'no_action' END AS guidance FROM ad LEFT JOIN lg USING (session_id, driver_code) LEFT JOIN sw USING (session_id, driver_code))"""
LEVEL = "CASE {0} WHEN 'ready' THEN 0 WHEN 'ready_with_warnings' THEN 1 WHEN 'partial' THEN 2 WHEN 'needs_manual_review' THEN 3 ELSE 4 END"
LABELS = ("catalog_readiness", "raw_stream_readiness", "replay_readiness", "context_readiness", "circuit_context_readiness")
READY = f"""{SURFACE}, {COVER}, {WIN}, {WATCH}, {MARK},
dr AS (SELECT session_id, count(DISTINCT driver_code) AS affected_drivers, sum(severe_windows) AS severe_windows, sum(degraded_windows) AS degraded_windows, max(longest_segment_ms) AS longest_segment_ms FROM wa GROUP BY ALL),
bw AS (SELECT session_id, count(DISTINCT window_start_ms) AS bad FROM win WHERE non_ok_pct >= 1 GROUP BY ALL),
r1 AS (SELECT e.session_id, e.event_name, CASE WHEN session_metadata_incomplete OR driver_metadata_sparse THEN 'partial' WHEN e.session_end_utc IS NULL THEN 'ready_with_warnings' ELSE 'ready' END AS catalog_readiness,
 CASE WHEN coalesce(cr.n, 0) = 0 OR coalesce(ps.n, 0) = 0 THEN 'needs_reimport' WHEN raw_telemetry_coverage_issue OR raw_position_coverage_issue THEN 'partial' WHEN ingestion_diagnostic_warning THEN 'ready_with_warnings' ELSE 'ready' END AS raw_stream_readiness,
 CASE WHEN coalesce(al.n, 0) = 0 THEN 'needs_reimport' WHEN aligned_replay_quality_issue OR coalesce(dr.severe_windows, 0) >= 8 OR coalesce(dr.longest_segment_ms, 0) >= 10000 THEN 'partial' WHEN al.bad > 0 OR coalesce(dr.degraded_windows, 0) > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS replay_readiness,
 CASE WHEN weather_surface_issue OR status_timeline_sparse THEN 'partial' WHEN race_control_sparse_or_untimed THEN 'ready_with_warnings' ELSE 'ready' END AS context_readiness, circuit_context_readiness,
 CASE WHEN ml.n = 0 OR marker_count = 0 THEN 'reimport' WHEN om > 0 THEN 'inspect' WHEN corner_markers < 5 THEN 'label_in_ui' WHEN oc > 0 THEN 'inspect' WHEN ml.nulls > 0 THEN 'label_in_ui' ELSE 'no_action' END AS advice, e.session_end_utc IS NULL AS endless,
 coalesce(affected_drivers, 0) AS affected_drivers, coalesce(dr.degraded_windows, 0) AS degraded_windows, coalesce(dr.severe_windows, 0) AS severe_windows, round(least(100, coalesce(bw.bad, 0) * 30000 / greatest(coalesce(s.b0 - s.a0, 1), 1) * 100), 3) AS affected_session_time_pct, coalesce(dr.longest_segment_ms, 0) AS longest_segment_ms
 FROM fx_sessions e JOIN sf USING (session_id) LEFT JOIN cr USING (session_id) LEFT JOIN ps USING (session_id) LEFT JOIN al USING (session_id) LEFT JOIN dr USING (session_id) LEFT JOIN bw USING (session_id) LEFT JOIN s USING (session_id) LEFT JOIN ml USING (session_id)),
rd AS (SELECT session_id, event_name, {", ".join(LABELS)}, greatest({", ".join(LEVEL.format(x) for x in LABELS)}) AS overall_readiness_score,
 CASE WHEN 'needs_reimport' IN ({", ".join(LABELS)}) THEN 'reimport' WHEN advice = 'inspect' OR 'needs_manual_review' IN ({", ".join(LABELS)}) THEN 'inspect' WHEN 'ready_with_warnings' IN ({", ".join(LABELS)}) OR 'partial' IN ({", ".join(LABELS)}) THEN 'label_in_ui' WHEN endless THEN 'schema_importer_change' ELSE 'no_action' END AS final_recommendation, affected_drivers, degraded_windows, severe_windows, affected_session_time_pct, longest_segment_ms FROM r1)"""


def _union(name: str, source: str, buckets: dict[str, str], aggs: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {name}, {aggs} FROM {source} WHERE {c} HAVING count(*) > 0" for k, c in buckets.items())


CAT = {f"c{k}": c for k, c in enumerate(D.CATEGORIES, 1)}
BLOCKED = "c1 OR c2 OR c4 OR c6 OR c8"
REVIEW = f"(c10 OR (c5 AND NOT ({BLOCKED} OR c9) AND NOT c7) OR c4)"
SHOWN = "CASE prim WHEN 'shape_mismatch_against_comparable_laps' THEN 'atypical_speed_profile' ELSE prim END"
REASONS = "CASE WHEN NOT bad THEN 'clean' ELSE concat_ws(' + ', " + ", ".join(f"CASE WHEN {k} THEN '{D.DISPLAY.get(c, c)}' END" for k, c in CAT.items()) + ") END"
SECOND = "concat_ws(' + ', " + ", ".join(f"CASE WHEN {k} AND prim <> '{c}' THEN '{D.DISPLAY.get(c, c)}' END" for k, c in CAT.items()) + ")"
SEVERITY = f"CASE WHEN c2 AND cov IS NULL THEN {LIMITS.min_lap_coverage_ratio} * 100 ELSE coalesce(greatest({LIMITS.min_lap_coverage_ratio} - cov, 0), 0) * 100 END AS dcov, coalesce(greatest(gp95 - {LIMITS.telemetry_p95_gap_ms}, 0), 0) AS gap95, greatest(coalesce(abs(ratio - 1.0) * 100, 0) - {LIMITS.path_length_tolerance_pct} * 100, 0) AS pathx, coalesce(greatest(rms - shapelimit, 0), 0) AS shapex, " + " + ".join(f"CAST({k} AS INT)" for k in CAT) + " AS reasons"
AUDIT = ("coverage_deficit_pct", "p95_gap_excess_ms", "path_ratio_excess_pct", "speed_shape_excess_kmh", "audit_priority")
#: Every lap under every scenario, beside the baseline.
CASES = "z AS (" + " UNION ALL ".join(f"SELECT * FROM (WITH {features_sql(t)} SELECT '{name}' AS scenario, session_id, driver_code, lap_number, bad, NOT ({BLOCKED}) AS replay, advice, {SHOWN} AS shown, {REVIEW} AS review FROM cl)" for name, t in D.scenarios(LIMITS)) + "), x AS (SELECT z.*, b.bad AS bbad, b.replay AS breplay, b.advice AS badvice, b.shown AS bshown FROM z JOIN (SELECT * FROM z WHERE scenario = 'baseline') b USING (session_id, driver_code, lap_number))"
CHANGED = {"bad_flag": "bad <> bbad", "replay_safety": "replay <> breplay", "lap_comparison_safety": "bad <> bbad", "recommendation": "advice <> badvice", "primary_category": "shown <> bshown"}
COUNTED = {"bad_laps": "bad", "replay_unsafe_laps": "NOT replay", "lap_comparison_unsafe_laps": "bad", "manual_review_laps": "review", "exclude_laps": "advice = 'exclude'", "context_label_laps": "advice = 'keep_with_context_label'"}
#: Sessions with the number of their event.
ROUNDS = "(SELECT *, CAST(dense_rank() OVER (ORDER BY session_start_utc NULLS LAST, event_name) AS INT) AS event_round FROM fx_sessions)"
FLIPS = "l AS (SELECT *, " + " + ".join(f"{k}_flip_count" for k in CHANGED) + " AS any_flips FROM (SELECT event_round, event_name, session_id, driver_code, lap_number, any_value(bbad) AS bbad, any_value(breplay) AS breplay, any_value(badvice) AS badvice, any_value(bshown) AS bshown, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}_flip_count" for k, c in CHANGED.items()) + f" FROM x JOIN {ROUNDS} USING (session_id) WHERE scenario <> 'baseline' GROUP BY event_round, event_name, session_id, driver_code, lap_number))"
SENSITIVE = "count(*) AS total_laps, count(*) FILTER (WHERE any_flips > 0) AS threshold_sensitive_laps, count(*) FILTER (WHERE bad_flag_flip_count > 0) AS bad_flag_sensitive_laps, count(*) FILTER (WHERE recommendation_flip_count > 0) AS recommendation_sensitive_laps, round(100.0 * count(*) FILTER (WHERE any_flips > 0) / count(*), 6) AS threshold_sensitive_pct"
SHARE = "count(*) AS laps, count(*) FILTER (WHERE bad) AS flagged_laps, round(100.0 * count(*) FILTER (WHERE bad) / count(*), 6) AS flagged_pct FROM cl GROUP BY ALL"


def _sensitivity(fx, kind):
    return D.threshold_sensitivity(features(fx), A.speed_profile(fx.telemetry, fx.laps), fx.sessions, kind, LIMITS)


def _report(kind):
    return lambda fx: D.lap_summary_report(classified(fx), kind)


def _shares(kind):
    return lambda fx: r6(D.lap_summary_report(classified(fx), kind), "flagged_pct")


QUALITY = {
    "lap_quality_features": (lambda fx: features(fx).select("lap_id", "car_samples", "position_samples", F.round("position_path_length_units", 4).alias("path"), F.round("car_p95_gap_ms", 3).alias("p95"), "safety_car_periods", "virtual_safety_car_periods", "red_flag_periods"), f"WITH {FEATURES} SELECT lap_id, car_samples, position_samples, round(path, 4) AS path, round(gp95, 3) AS p95, sc AS safety_car_periods, vsc AS virtual_safety_car_periods, red AS red_flag_periods FROM f"),
    "derived_lap_features": (lambda fx: derived(fx).select("lap_id", "is_reference", *(F.round(c, 6).alias(n) for c, n in (("car_coverage_ratio", "cov"), ("position_path_ratio", "ratio"), ("position_segment_limit_units", "seglimit"), ("speed_shape_rms_kmh", "rms"), ("speed_shape_limit_kmh", "shapelimit"))), "speed_profile_bins_present"), f"WITH {FEATURES} SELECT lap_id, ref AS is_reference, round(cov, 6) AS cov, round(ratio, 6) AS ratio, round(seglimit, 6) AS seglimit, round(rms, 6) AS rms, round(shapelimit, 6) AS shapelimit, nbins AS speed_profile_bins_present FROM d2"),
    "classify_laps": (lambda fx: classified(fx).select("lap_id", *D.CATEGORIES, "primary_category", "bad_lap_any_category", "reason_count", "product_recommendation"), f"WITH {FEATURES} SELECT lap_id, " + ", ".join(f"{k} AS {c}" for k, c in CAT.items()) + ", prim AS primary_category, bad AS bad_lap_any_category, " + " + ".join(f"CAST({k} AS INT)" for k in CAT) + f" AS reason_count, advice AS product_recommendation FROM cl"),
    "lap_category_counts": (lambda fx: r6(_report("categories")(fx), "pct"), f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER (WHERE {k}) AS laps, round(100.0 * count(*) FILTER (WHERE {k}) / count(*), 6) AS pct FROM cl" for k, c in CAT.items())),
    "lap_primary_counts": (_report("primary"), f"WITH {FEATURES} SELECT prim AS primary_category, count(*) AS laps FROM cl GROUP BY ALL"),
    "lap_recommendation_counts": (_report("recommendations"), f"WITH {FEATURES} SELECT advice AS product_recommendation, count(*) AS laps FROM cl GROUP BY ALL"),
    "lap_flags_by_race": (_shares("by_race"), f"WITH {FEATURES} SELECT session_id, {SHARE}"),
    "lap_flags_by_driver": (_shares("by_driver"), f"WITH {FEATURES} SELECT driver_code, {SHARE}"),
    "lap_flags_driver_race_matrix": (_shares("driver_race_matrix"), f"WITH {FEATURES} SELECT driver_code, session_id, {SHARE}"),
    "lap_primary_by_race": (_report("primary_by_race"), f"WITH {FEATURES} SELECT session_id, prim AS primary_category, count(*) AS laps FROM cl GROUP BY ALL"),
    "lap_lens_counts": (lambda fx: r6(_report("lenses")(fx), "pct"), f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{n}' AS lens, count(*) FILTER (WHERE {c}) AS laps, round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6) AS pct FROM cl" for n, c in (("data_integrity_flag", "c1 OR c2 OR c4 OR c6 OR c8 OR c9"), ("replay_blocking_integrity_flag", "c1 OR c2 OR c4 OR c6 OR c8"), ("race_context_flag", "c7"), ("analytical_shape_flag", "c5 OR c10")))),
    "lap_safety_counts": (lambda fx: r6(_report("safety")(fx), "pct"), f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{n}' AS use, count(*) FILTER (WHERE {c}) AS laps, round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6) AS pct FROM cl" for n, c in (("safe_for_replay", f"NOT ({BLOCKED})"), ("safe_for_time_domain_analysis", "NOT bad"), ("safe_for_lap_comparison", "NOT bad"), ("safe_for_geometry_reference", f"NOT bad AND position_samples >= {LIMITS.min_position_samples}"), ("needs_manual_review", REVIEW)))),
    "lap_category_intersections": (_report("intersections"), f"WITH {FEATURES} SELECT CASE WHEN NOT bad THEN 'clean' ELSE concat_ws(' + ', " + ", ".join(f"CASE WHEN {k} THEN '{D.DISPLAY.get(c, c)}' END" for k, c in CAT.items()) + ") END AS reason_set, " + " + ".join(f"CAST({k} AS INT)" for k in CAT) + " AS reason_count, count(*) AS laps FROM cl GROUP BY ALL"),
    "decision_waterfall": (lambda fx: r6(D.decision_waterfall(classified(fx)), "pct_of_all_laps"), f"WITH {FEATURES}, k AS (SELECT CASE WHEN c9 OR c8 THEN 1 WHEN c1 OR c2 THEN 2 WHEN c4 THEN 3 WHEN c6 THEN 4 WHEN c7 THEN 5 WHEN c5 THEN 6 WHEN bad THEN 7 ELSE 8 END AS k FROM cl), s(k, step) AS (VALUES (0, 'total_laps'), (1, 'source_or_timing_excluded'), (2, 'missing_or_incomplete_telemetry'), (3, 'implausible_channel_values'), (4, 'position_trace_discontinuity'), (5, 'race_context_influenced'), (6, 'atypical_speed_profile'), (7, 'other_or_manual_review'), (8, 'clean_after_waterfall')), n AS (SELECT s.k, step, count(*) FILTER (WHERE k.k = s.k OR s.k = 0) AS laps, count(*) FILTER (WHERE k.k > s.k) AS rest, count(*) AS total FROM s, k GROUP BY ALL) SELECT step, laps, round(100.0 * laps / total, 6) AS pct_of_all_laps, rest AS remaining_laps_after_step FROM n"),
    "primary_category_audit": (lambda fx: r6(D.primary_category_audit(classified(fx), fx.sessions), *AUDIT), f"WITH {FEATURES}, a AS (SELECT *, {SEVERITY} FROM cl JOIN {ROUNDS} USING (session_id) WHERE bad), b AS (SELECT *, dcov + gap95 / 100 + pathx + shapex + reasons * 2 AS prio FROM a WHERE reasons > 1) SELECT event_round, event_name, session_id, driver_code, lap_number, {SHOWN} AS primary_category, {SECOND} AS secondary_reason_set, reasons AS reason_count, advice AS product_recommendation, NOT ({BLOCKED}) AS safe_for_replay, NOT bad AS safe_for_lap_comparison, round(dcov, 6) AS coverage_deficit_pct, round(gap95, 6) AS p95_gap_excess_ms, round(pathx, 6) AS path_ratio_excess_pct, round(shapex, 6) AS speed_shape_excess_kmh, round(prio, 6) AS audit_priority FROM b ORDER BY round(prio, 9) DESC, event_round, session_id, driver_code, lap_number LIMIT 80"),
    "race_drilldown": (lambda fx: r6(D.race_drilldown(classified(fx), fx.sessions), "median_coverage_ratio"), f"WITH {FEATURES} SELECT event_name, prim AS primary_category, count(*) AS laps, count(DISTINCT driver_code) AS drivers, median(lap_time_ms) AS median_lap_time_ms, round(median(cov), 6) AS median_coverage_ratio FROM cl JOIN fx_sessions USING (session_id) GROUP BY ALL"),
    "threshold_sensitivity": (lambda fx: r6(_sensitivity(fx, "summary"), "bad_pct"), f"WITH {CASES}, s AS (SELECT scenario, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in COUNTED.items()) + ", round(100.0 * count(*) FILTER (WHERE bad) / count(*), 6) AS bad_pct, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}_changed_laps" for k, c in CHANGED.items()) + " FROM x GROUP BY scenario) SELECT s.*, " + ", ".join(f"s.{k} - b.{k} AS {k}_delta_vs_baseline" for k in COUNTED) + " FROM s, (SELECT * FROM s WHERE scenario = 'baseline') b"),
    "threshold_sensitivity_by_race": (lambda fx: r6(_sensitivity(fx, "by_race"), "threshold_sensitive_pct"), f"WITH {CASES}, {FLIPS} SELECT session_id, event_round, event_name, {SENSITIVE} FROM l GROUP BY ALL"),
    "threshold_sensitivity_by_driver": (lambda fx: r6(_sensitivity(fx, "by_driver"), "threshold_sensitive_pct"), f"WITH {CASES}, {FLIPS} SELECT driver_code, {SENSITIVE} FROM l GROUP BY ALL"),
    "threshold_borderline_laps": (lambda fx: _sensitivity(fx, "borderline"), f"WITH {CASES}, {FLIPS} SELECT event_round, event_name, session_id, driver_code, lap_number, " + ", ".join(f"{k}_flip_count" for k in CHANGED) + ", any_flips AS any_sensitivity_flip_count, bbad AS baseline_bad_lap_any_category, breplay AS baseline_safe_for_replay, NOT bbad AS baseline_safe_for_lap_comparison, badvice AS baseline_product_recommendation, bshown AS baseline_primary_category FROM l WHERE any_flips > 0"),
    "speed_profile_baselines": (lambda fx: r6(D.speed_profile_baselines(classified(fx), 2), "q10", "median", "q90"), f"WITH {FEATURES}, l AS (" + " UNION ALL ".join(f"SELECT session_id, {k} AS bin, b{k} AS v FROM cl WHERE NOT bad AND nbins >= 2 AND b{k} IS NOT NULL" for k in range(1, 21)) + ") SELECT session_id, bin, count(*) AS laps, round(quantile_cont(v, 0.1), 6) AS q10, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS q90 FROM l GROUP BY ALL"),
    "shape_examples": (lambda fx: r6(D.shape_examples(classified(fx), fx.sessions), "speed_shape_rms_kmh", "speed_shape_excess_kmh", "speed_shape_robust_z"), f"WITH {FEATURES}, a AS (SELECT *, {SEVERITY} FROM cl JOIN {ROUNDS} USING (session_id) WHERE c5 AND rms IS NOT NULL) SELECT event_round, event_name, session_id, driver_code, lap_number, {SHOWN} AS primary_category, {REASONS} AS reason_set, lap_time_ms, round(rms, 6) AS speed_shape_rms_kmh, round(shapex, 6) AS speed_shape_excess_kmh, round(coalesce((rms - mrms) / nullif(iqr, 0), 0), 6) AS speed_shape_robust_z, is_pit_in_lap, is_pit_out_lap, sc AS safety_car_periods, vsc AS virtual_safety_car_periods, red AS red_flag_periods FROM a ORDER BY ({REVIEW}) DESC, round(shapex, 9) DESC, round(rms, 9) DESC, session_id, driver_code, lap_number LIMIT 12"),
    "surface_flags": (lambda fx: surfaces(fx).select("session_id", *D.SURFACE_FLAGS, "surface_issue_count", F.round("aligned_non_ok_pct", 6).alias("aligned_non_ok_pct")), f"WITH {SURFACE} SELECT *, " + " + ".join(f"CAST({x} AS INT)" for x in D.SURFACE_FLAGS) + " AS surface_issue_count FROM sf"),
    "surface_flag_summary": (lambda fx: r6(D.surface_flag_summary(surfaces(fx)), "pct"), f"WITH {SURFACE} " + " UNION ALL ".join(f"SELECT '{x}' AS surface_flag, count(*) FILTER (WHERE {x}) AS sessions, round(100.0 * count(*) FILTER (WHERE {x}) / count(*), 6) AS pct FROM sf" for x in D.SURFACE_FLAGS)),
    "surface_summary_by_year": (lambda fx: r6(D.surface_summary_by_year(surfaces(fx)), "issue_pct").select("year", "sessions", "car_samples", "position_samples", "aligned_samples", "weather_samples", "messages"), "SELECT 2024 AS year, (SELECT count(*) FROM fx_sessions) AS sessions, (SELECT count(*) FROM fx_telemetry) AS car_samples, (SELECT count(*) FROM fx_positions) AS position_samples, (SELECT count(*) FROM fx_aligned) AS aligned_samples, (SELECT count(*) FROM fx_weather) AS weather_samples, (SELECT count(*) FROM fx_race_control) AS messages"),
    "session_surface_features": (lambda fx: A.session_surface_features(fx.sessions, fx.drivers, fx.laps, fx.telemetry, fx.positions, fx.aligned, fx.weather, fx.track_status, fx.race_control, fx.markers, fx.circuits).select("session_id", "drivers", "laps", "deleted_laps", "inaccurate_laps", "pit_laps", "lap_time_ms_nulls", "car_samples", "speed_kmh_nulls", "position_samples", "off_track_samples", "aligned_not_ok", "weather_samples", "rain_samples", "status_events", "status_4", "messages", "messages_without_time", "corners", "circuit_metadata_rows"), "SELECT s.session_id, (SELECT count(*) FROM fx_drivers d WHERE d.session_id = s.session_id) AS drivers, l.*, c.*, p.*, (SELECT count(*) FILTER (WHERE NOT list_contains(quality_flags, 'OK')) FROM fx_aligned a WHERE a.session_id = s.session_id) AS aligned_not_ok, w.*, e.*, m.*, (SELECT count(*) FILTER (WHERE marker_type = 'corner') FROM fx_markers k WHERE k.session_id = s.session_id) AS corners, (SELECT count(*) FROM fx_markers k WHERE k.session_id = s.session_id) AS circuit_metadata_rows FROM fx_sessions s, LATERAL (SELECT count(*) AS laps, count(*) FILTER (WHERE is_deleted) AS deleted_laps, count(*) FILTER (WHERE NOT is_accurate) AS inaccurate_laps, count(*) FILTER (WHERE is_pit_in_lap OR is_pit_out_lap) AS pit_laps, count(*) FILTER (WHERE lap_time_ms IS NULL) AS lap_time_ms_nulls FROM fx_laps x WHERE x.session_id = s.session_id) l, LATERAL (SELECT count(*) AS car_samples, count(*) FILTER (WHERE speed_kmh IS NULL) AS speed_kmh_nulls FROM fx_telemetry x WHERE x.session_id = s.session_id) c, LATERAL (SELECT count(*) AS position_samples, count(*) FILTER (WHERE track_status = 'OffTrack') AS off_track_samples FROM fx_positions x WHERE x.session_id = s.session_id) p, LATERAL (SELECT count(*) AS weather_samples, count(*) FILTER (WHERE rainfall) AS rain_samples FROM fx_weather x WHERE x.session_id = s.session_id) w, LATERAL (SELECT count(*) AS status_events, count(*) FILTER (WHERE status_code = '4') AS status_4 FROM fx_track_status x WHERE x.session_id = s.session_id) e, LATERAL (SELECT count(*) AS messages, count(*) FILTER (WHERE session_time_ms IS NULL) AS messages_without_time FROM fx_race_control x WHERE x.session_id = s.session_id) m"),
    "quality_windows": (lambda fx: r6(windows(fx), "non_ok_pct").select("session_id", "driver_code", "window_start_ms", "samples", "not_ok", "pit_lap_rows", "non_ok_pct", "messages", "incident_messages", "has_status_context", "has_incident_context"), f"WITH {WIN} SELECT session_id, driver_code, window_start_ms, samples, not_ok, pit_lap_rows, round(non_ok_pct, 6) AS non_ok_pct, messages, incident_messages, has_status_context, has_incident_context FROM win"),
    "context_overlap": (lambda fx: r6(D.context_overlap(windows(fx)), "pct_has_race_control_context", "pct_has_status_context", "pct_has_pit_context", "pct_has_incident_context", "median_non_ok_pct", "p95_non_ok_pct"), f"WITH {WIN} " + _union("window_bucket", "win", {"all_windows": "true", "degraded_windows": "non_ok_pct >= 1", "severe_windows": "non_ok_pct >= 10"}, "count(*) AS windows, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6) AS pct_{c}" for c in ("has_race_control_context", "has_status_context", "has_pit_context", "has_incident_context")) + ", round(median(non_ok_pct), 6) AS median_non_ok_pct, round(quantile_cont(non_ok_pct, 0.95), 6) AS p95_non_ok_pct")),
    "lap_context": (lambda fx: r6(D.lap_context(A.aligned_quality_by(fx.aligned, "lap"), fx.laps), "median_non_ok_pct", "p95_non_ok_pct"), f"WITH a AS (SELECT session_id, driver_code, lap_number, count(*) FILTER (WHERE {FAMILY} <> 'OK') AS not_ok, 100.0 * count(*) FILTER (WHERE {FAMILY} <> 'OK') / count(*) AS pct FROM fx_aligned GROUP BY ALL), j AS (SELECT a.*, is_pit_in_lap OR is_pit_out_lap AS pit, NOT coalesce(is_accurate, true) AS bad, lap_time_ms IS NULL AS untimed FROM a LEFT JOIN fx_laps USING (session_id, driver_code, lap_number)) " + _union("lap_bucket", "j", {"all_laps": "true", "pit_laps": "pit", "inaccurate_laps": "bad", "missing_lap_time_laps": "untimed", "ordinary_laps": "NOT (pit OR bad OR untimed)"}, "count(*) AS laps, count(*) FILTER (WHERE not_ok > 0) AS laps_with_any_non_ok, count(*) FILTER (WHERE pct >= 10) AS laps_with_severe_non_ok, round(median(pct), 6) AS median_non_ok_pct, round(quantile_cont(pct, 0.95), 6) AS p95_non_ok_pct, CAST(sum(not_ok) AS BIGINT) AS non_ok_rows")),
    "replay_watchlist": (lambda fx: watch(fx).select("session_id", "driver_code", F.round("replay_risk_score", 4).alias("risk"), "guidance", "severe_windows", "longest_segment_ms"), f"WITH {WIN}, {WATCH} SELECT session_id, driver_code, round(risk, 4) AS risk, guidance, severe_windows, longest_segment_ms FROM wa"),
    "session_duration_coverage": (lambda fx: coverage(fx).select("session_id", "derived_session_duration_ms", "duration_source", "active_replay_duration_ms", F.round("weather_active_coverage_ratio", 6).alias("weather_active"), F.round("race_control_coverage_ratio", 6).alias("messages")), "WITH t AS (SELECT session_id, min(session_time_ms) AS a, max(session_time_ms) AS b FROM fx_telemetry GROUP BY ALL), p AS (SELECT session_id, max(epoch_us(sample_time_utc) // 1000 % 86400000) AS b FROM fx_positions GROUP BY ALL), w AS (SELECT session_id, min(session_time_ms) AS a, max(session_time_ms) AS b FROM fx_weather GROUP BY ALL), m AS (SELECT session_id, min(session_time_ms) AS a, max(session_time_ms) AS b FROM fx_race_control GROUP BY ALL) SELECT t.session_id, greatest(t.b, p.b) AS derived_session_duration_ms, CASE WHEN t.b >= p.b THEN 'telemetry' ELSE 'position' END AS duration_source, t.b - t.a AS active_replay_duration_ms, round(greatest(least(w.b, t.b) - greatest(w.a, t.a), 0) / CAST(t.b - t.a AS DOUBLE), 6) AS weather_active, round((m.b - m.a) / CAST(greatest(t.b, p.b) AS DOUBLE), 6) AS messages FROM t JOIN p USING (session_id) JOIN w USING (session_id) JOIN m USING (session_id)"),
    "coverage_windows": (lambda fx: D.coverage_windows(coverage(fx)).where("surface in ('telemetry', 'weather', 'race_control')").select("session_id", "surface", "start_ms", "end_ms", "span_ms"), "SELECT session_id, surface, min(t) AS start_ms, max(t) AS end_ms, max(t) - min(t) AS span_ms FROM (SELECT session_id, 'telemetry' AS surface, session_time_ms AS t FROM fx_telemetry UNION ALL SELECT session_id, 'weather', session_time_ms FROM fx_weather UNION ALL SELECT session_id, 'race_control', session_time_ms FROM fx_race_control) GROUP BY ALL"),
    "coverage_summary": (lambda fx: r6(D.coverage_summary(D.coverage_windows(coverage(fx))), "median_coverage_ratio", "median_active_coverage_ratio", "min_active_coverage_ratio"), f"WITH {COVER} SELECT surface, count(*) AS sessions, round(median(cov), 6) AS median_coverage_ratio, round(median(act), 6) AS median_active_coverage_ratio, round(min(act), 6) AS min_active_coverage_ratio, count(*) FILTER (WHERE late > 60000) AS sessions_starting_after_active, count(*) FILTER (WHERE early > 60000) AS sessions_ending_before_active_end FROM c GROUP BY surface"),
    "message_taxonomy_summary": (lambda fx: r6(D.message_taxonomy_summary(fx.race_control), "missing_session_time_pct", "missing_lap_scope_pct", "missing_driver_scope_pct"), f"WITH {TAX}, g AS (SELECT taxonomy, count(*) AS messages, count(*) FILTER (WHERE session_time_ms IS NULL) AS missing_session_time, count(*) FILTER (WHERE lap_number IS NULL) AS missing_lap_scope, count(*) FILTER (WHERE racing_number IS NULL) AS missing_driver_scope, count(DISTINCT session_id) AS sessions FROM tx GROUP BY ALL) SELECT *, " + ", ".join(f"round(100.0 * {c} / messages, 6) AS {c}_pct" for c in ("missing_session_time", "missing_lap_scope", "missing_driver_scope")) + " FROM g"),
    "duplicate_messages": (lambda fx: D.duplicate_messages(fx.race_control), rf"WITH {TAX}, n AS (SELECT *, regexp_replace(regexp_replace(lower(message), '\bcar\s+\d+\b', 'car #', 'g'), '\bturn\s+\d+\b', 'turn #', 'g') AS a FROM tx), k AS (SELECT *, trim(regexp_replace(a, '\b\d+\b', '#', 'g')) AS normalized_message FROM n), g AS (SELECT session_id, normalized_message, count(*) AS messages, min(session_time_ms) AS first_session_time_ms, max(session_time_ms) AS last_session_time_ms, string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy) AS taxonomy FROM k GROUP BY ALL HAVING count(*) > 1) SELECT *, last_session_time_ms - first_session_time_ms AS span_ms FROM g"),
    "status_message_overlap": (lambda fx: D.status_message_overlap(intervals(fx), fx.race_control).select("session_id", "start_time_ms", "status_code", "messages", "incident_messages", "taxonomies"), f"WITH {TAX}, i AS ({ICOLS}) SELECT i.session_id, i.start_time_ms, i.status_code, count(t.session_id) AS messages, count(*) FILTER (WHERE {INC}) AS incident_messages, coalesce(string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy), '') AS taxonomies FROM i LEFT JOIN tx t ON t.session_id = i.session_id AND t.session_time_ms >= i.start_time_ms AND t.session_time_ms < i.end_time_ms GROUP BY ALL"),
    "context_timeline": (lambda fx: r6(bins(fx), "max_non_ok_pct", "degraded_window_rate").select("session_id", "bin_start_ms", "driver_windows", "degraded_driver_windows", "messages", "incident_messages", "rainfall_transitions", "has_status_context", "has_context_event", "max_non_ok_pct"), f"WITH {BINS} SELECT session_id, bin_start_ms, driver_windows, degraded_driver_windows, messages, incident_messages, rainfall_transitions, has_status_context, has_context_event, round(max_non_ok_pct, 6) AS max_non_ok_pct FROM bn"),
    "context_correlation": (lambda fx: r6(D.context_correlation(bins(fx)), "median_degraded_window_rate", "p95_degraded_window_rate", "median_max_non_ok_pct", "p95_max_non_ok_pct"), f"WITH {BINS} " + _union("bin_bucket", "bn", {"all_bins": "true", "context_event_bins": "has_context_event", "no_context_event_bins": "NOT has_context_event", "race_control_incident_bins": "incident_messages > 0", "status_bins": "has_status_context", "rainfall_transition_bins": "rainfall_transitions > 0"}, "count(*) AS bins, round(median(degraded_window_rate), 6) AS median_degraded_window_rate, round(quantile_cont(degraded_window_rate, 0.95), 6) AS p95_degraded_window_rate, round(median(max_non_ok_pct), 6) AS median_max_non_ok_pct, round(quantile_cont(max_non_ok_pct, 0.95), 6) AS p95_max_non_ok_pct, CAST(sum(severe_driver_windows) AS BIGINT) AS severe_driver_windows")),
    "marker_quality": (lambda fx: D.marker_quality(fx.markers, fx.positions).select("session_id", "marker_number", "marker_issue"), f"WITH {MARK} SELECT session_id, marker_number, CASE WHEN om THEN 'outside_position_bounds' WHEN oc THEN 'outside_core_trace_bounds' WHEN distance_m IS NULL THEN 'missing_distance' ELSE 'none' END AS marker_issue FROM mq"),
    "marker_summary": (lambda fx: markers(fx).select("session_id", "marker_count", "corner_markers", "circuit_context_readiness"), f"WITH {MARK} SELECT session_id, marker_count, corner_markers, circuit_context_readiness FROM ml"),
    "marker_example_sessions": (lambda fx: r6(D.marker_example_sessions(markers(fx)), "priority"), f"WITH {MARK} SELECT session_id, round(om * 100 + oc * 10 + CASE WHEN circuit_context_readiness <> 'ready' THEN 1 ELSE 0 END + least(marker_count, 50) / 100.0, 6) AS priority FROM ml ORDER BY priority DESC, event_name LIMIT 6"),
    "product_readiness": (lambda fx: D.product_readiness(surfaces(fx), watch(fx), windows(fx), coverage(fx), markers(fx)), f"WITH {READY} SELECT * FROM rd"),
    "readiness_summary": (lambda fx: D.readiness_summary(D.product_readiness(surfaces(fx), watch(fx), windows(fx), coverage(fx), markers(fx))), f"WITH {READY} SELECT x AS final_recommendation, count(session_id) AS sessions FROM (SELECT unnest(" + repr(D.RECOMMENDATIONS) + ") AS x) LEFT JOIN rd ON final_recommendation = x GROUP BY x"),
    "assert_scope": (lambda fx: D.assert_scope(fx.sessions, 24), "SELECT CAST(24 AS BIGINT) AS expected, count(*) AS found, count(*) = 24 AS matches FROM fx_sessions"),
}
