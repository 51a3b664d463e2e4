"""Queries and SQL of the race analysis over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import race as Q
from ..operators.race import PAIR
from .core import pairs, r6

CH = ["speed_kmh", "throttle_pct", "brake_pct", "rpm"]
P = ", ".join(PAIR)


def _binned() -> str:
    return "SELECT session_id, driver_code, lap_number, CAST(floor(lap_time_ms / 1800000) * 1800000 AS BIGINT) AS bucket_ms, " + ", ".join(f"avg({c}) AS {c}" for c in CH) + ", CAST(round(avg(gear)) AS INT) AS gear FROM fx_telemetry GROUP BY ALL"


def _side(k: str) -> str:
    return f"SELECT p.*, b.bucket_ms, " + ", ".join(f"b.{c} AS {k}_{c}" for c in [*CH, "gear"]) + f" FROM v_pairs p JOIN b ON b.session_id = p.session_id AND b.driver_code = p.driver_{k} AND b.lap_number = p.lap_{k}"


COMPARE = f"WITH b AS ({_binned()}), x AS ({_side('a')}), y AS ({_side('b')}) SELECT {P}, bucket_ms, " + ", ".join(f"round({k}_{c}, 6) AS {k}_{c}" for k in "ab" for c in CH) + ", a_gear, b_gear, " + ", ".join(f"round(a_{c} - b_{c}, 6) AS d_{c}" for c in CH[:3]) + f" FROM x FULL JOIN y USING ({P}, bucket_ms)"
LAPSUM = "SELECT l.session_id, l.driver_code, l.lap_number, any_value(l.lap_time_ms) AS lap_time_ms, any_value(l.sector_1_ms) AS sector_1_ms, any_value(l.sector_2_ms) AS sector_2_ms, any_value(l.sector_3_ms) AS sector_3_ms, max(speed_kmh) AS max_speed_kmh, avg(speed_kmh) AS avg_speed_kmh FROM fx_laps l LEFT JOIN fx_telemetry t USING (session_id, driver_code, lap_number) GROUP BY ALL"
DUR = "CASE WHEN {0} >= 60000 THEN concat({0} // 60000, ':', lpad(CAST({0} % 60000 // 1000 AS VARCHAR), 2, '0'), '.', lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')) ELSE concat({0} // 1000, '.', lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'), 's') END"
STAND = """k AS (SELECT * FROM fx_laps WHERE NOT is_deleted {scope}), d AS (SELECT session_id, driver_code, max(lap_number) AS laps_done, max(epoch_ms(lap_end_utc)) AS end_ms, count(*) FILTER (WHERE is_pit_in_lap) AS pit_count, min(lap_time_ms) AS best_lap_ms FROM k GROUP BY ALL),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY session_id, driver_code ORDER BY lap_number DESC) = 1),
s AS (SELECT sd.session_id, sd.driver_code, sd.full_name, d.laps_done, d.end_ms, coalesce(d.pit_count, 0) AS pit_count, d.best_lap_ms, l.lap_time_ms AS last_lap_ms, l.compound, row_number() OVER (PARTITION BY sd.session_id ORDER BY coalesce(d.laps_done, -1) DESC, d.end_ms NULLS LAST, sd.driver_code) AS position FROM fx_drivers sd LEFT JOIN d USING (session_id, driver_code) LEFT JOIN l USING (session_id, driver_code))"""
STOPS = """stops AS (SELECT i.session_id, i.driver_code, i.lap_number, i.stint_number, i.compound AS from_compound,
 (SELECT l.compound FROM fx_laps l WHERE l.session_id = i.session_id AND l.driver_code = i.driver_code AND l.lap_number > i.lap_number AND NOT l.is_deleted AND (i.stint_number IS NULL OR l.stint_number IS DISTINCT FROM i.stint_number) ORDER BY l.lap_number LIMIT 1) AS to_compound, i.pit_in_session_time_ms,
 (SELECT l.pit_out_session_time_ms FROM fx_laps l WHERE l.session_id = i.session_id AND l.driver_code = i.driver_code AND l.pit_out_session_time_ms IS NOT NULL AND l.lap_number BETWEEN i.lap_number AND i.lap_number + 2 ORDER BY l.lap_number LIMIT 1) AS pit_out_session_time_ms, i.is_accurate,
 coalesce((SELECT p.status_name FROM v_periods p WHERE p.session_id = i.session_id AND i.pit_in_session_time_ms >= p.start_time_ms AND (p.end_time_ms IS NULL OR i.pit_in_session_time_ms < p.end_time_ms) ORDER BY p.start_time_ms DESC LIMIT 1), 'unknown') AS track_status
 FROM fx_laps i WHERE i.pit_in_session_time_ms IS NOT NULL AND NOT i.is_deleted),
st AS (SELECT *, CASE WHEN pit_out_session_time_ms >= pit_in_session_time_ms THEN pit_out_session_time_ms - pit_in_session_time_ms END AS pit_lane_time_ms FROM stops)"""
SUMMARY = STOPS + """,
lastlap AS (SELECT session_id, max(lap_number) AS last_lap FROM v_pos GROUP BY ALL),
bp AS (SELECT st.*, p.position AS before_position FROM st LEFT JOIN v_pos p ON p.session_id = st.session_id AND p.driver_code = st.driver_code AND p.lap_number = greatest(1, st.lap_number - 1)),
rv AS (SELECT bp.session_id, bp.driver_code, bp.lap_number, o.driver_code AS rival, o.lap_number AS rival_lap, p.position AS rival_before FROM bp JOIN st o ON o.session_id = bp.session_id AND o.driver_code <> bp.driver_code AND abs(o.lap_number - bp.lap_number) <= 3 JOIN v_pos p ON p.session_id = o.session_id AND p.driver_code = o.driver_code AND p.lap_number = greatest(1, bp.lap_number - 1)
 QUALIFY row_number() OVER (PARTITION BY bp.session_id, bp.driver_code, bp.lap_number ORDER BY coalesce(abs(p.position - bp.before_position), 2147483647), abs(o.lap_number - bp.lap_number), o.driver_code, o.lap_number) = 1),
aa AS (SELECT bp.*, rv.rival, rv.rival_lap, rv.rival_before, least(l.last_lap, greatest(bp.lap_number, coalesce(rv.rival_lap, bp.lap_number)) + 2) AS after_lap FROM bp LEFT JOIN rv USING (session_id, driver_code, lap_number) LEFT JOIN lastlap l USING (session_id)),
ab AS (SELECT aa.*, p.position AS after_position, r.position AS rival_after FROM aa LEFT JOIN v_pos p ON p.session_id = aa.session_id AND p.driver_code = aa.driver_code AND p.lap_number = aa.after_lap LEFT JOIN v_pos r ON r.session_id = aa.session_id AND r.driver_code = aa.rival AND r.lap_number = aa.after_lap),
ac AS (SELECT *, coalesce(pit_out_session_time_ms IS NOT NULL AND pit_lane_time_ms > 0 AND coalesce(is_accurate, true) AND before_position IS NOT NULL AND after_position IS NOT NULL, false) AS complete, track_status = 'track_clear' AS clr, coalesce(before_position > rival_before AND after_position < rival_after, false) AS rev FROM ab),
sm AS (SELECT ac.session_id, ac.driver_code, ac.lap_number, from_compound, to_compound, pit_lane_time_ms, track_status, rival, before_position, after_position, before_position - after_position AS position_gain, CASE WHEN complete AND clr THEN 'supported' ELSE 'degraded' END AS quality,
 CASE WHEN NOT complete OR NOT clr THEN 'unknown' WHEN rival IS NULL THEN 'scheduled' WHEN rev AND lap_number < rival_lap THEN 'undercut' WHEN rev AND lap_number > rival_lap THEN 'overcut' WHEN lap_number - rival_lap BETWEEN 0 AND 1 THEN 'reactive' ELSE 'scheduled' END AS label,
 (SELECT CAST(round_even(avg(pit_lane_time_ms), 0) AS BIGINT) FROM st WHERE st.session_id = ac.session_id AND pit_lane_time_ms > 0) AS field_average_ms FROM ac)"""
INCIDENTS = """ia AS (SELECT session_id, CASE status_code WHEN '2' THEN 'yellow' WHEN '4' THEN 'safety_car' WHEN '5' THEN 'red' ELSE 'vsc' END AS type, CAST(NULL AS INT) AS lap_number, start_time_ms AS session_time_ms, CASE WHEN trim(coalesce(message, '')) <> '' THEN message ELSE CASE status_code WHEN '2' THEN 'Yellow flag' WHEN '4' THEN 'Safety car deployed' WHEN '5' THEN 'Red flag' WHEN '6' THEN 'Virtual safety car deployed' ELSE 'Virtual safety car ending' END END AS message, CAST(NULL AS VARCHAR) AS driver_code, CASE WHEN status_code IN ('4', '5') THEN 'high' ELSE 'info' END AS severity, 0 AS seq FROM v_periods WHERE status_code IN ('2', '4', '5', '6', '7')),
ib AS (SELECT * FROM fx_race_control WHERE message ILIKE '%spin%' OR message ILIKE '%off track%' OR message ILIKE '%off the track%' OR message ILIKE '%collision%' OR message ILIKE '%incident%' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms NULLS LAST, race_control_message_id) <= 200),
ic AS (SELECT ib.session_id, CASE WHEN ib.message ILIKE '%spin%' THEN 'spin' ELSE 'off_track' END AS type, ib.lap_number, ib.session_time_ms, ib.message, d.driver_code, 'info' AS severity, ib.race_control_message_id AS seq FROM ib LEFT JOIN fx_drivers d ON d.session_id = ib.session_id AND d.driver_number = ib.racing_number),
iu AS (SELECT * FROM ia UNION ALL SELECT * FROM ic),
inc AS (SELECT iu.*, (SELECT count(*) FROM ia WHERE ia.session_id = iu.session_id AND ia.type IN ('safety_car', 'vsc')) AS safety_periods, row_number() OVER (PARTITION BY session_id ORDER BY session_time_ms NULLS LAST, seq, type, message) AS k FROM iu)"""
SEC = "concat(CAST(floor({0} / 1000) AS BIGINT), '.', lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'), 's')"
FACTS = SUMMARY + ",\n" + INCIDENTS + ",\n" + STAND.format(scope="") + f""",
fw AS (SELECT s.session_id, 'debrief-winner' AS fact_id, 'winner' AS kind, concat(s.driver_code, ' was classified first after ', (SELECT max(lap_number) FROM k WHERE k.session_id = s.session_id), ' laps.') AS text, CAST(1 AS DOUBLE) AS value, 'position' AS unit, 'supported' AS quality, 'assert' AS policy FROM s WHERE position = 1),
fs AS (SELECT session_id, concat('strategy-', lower(driver_code), '-', lap_number) AS fact_id, 'strategy_stop' AS kind, concat(driver_code, ' stopped on lap ', lap_number, ' for ', coalesce(to_compound, 'an unknown compound'), CASE WHEN pit_lane_time_ms IS NOT NULL THEN concat(' in ', {SEC.format('pit_lane_time_ms')}) ELSE '' END,
 CASE WHEN pit_lane_time_ms - field_average_ms IS NOT NULL THEN concat(', ', {SEC.format('abs(pit_lane_time_ms - field_average_ms)')}, CASE WHEN pit_lane_time_ms <= field_average_ms THEN ' faster' ELSE ' slower' END, ' than the field average') ELSE '' END,
 CASE WHEN label IN ('undercut', 'overcut') THEN concat('; the ', label, ' on ', rival, ' changed track position') WHEN position_gain <> 0 THEN concat('; net position change ', CASE WHEN position_gain > 0 THEN '+' ELSE '' END, position_gain) ELSE '' END, '.') AS text, CAST(pit_lane_time_ms AS DOUBLE) AS value, 'ms' AS unit, quality, CASE WHEN quality = 'supported' THEN 'assert' ELSE 'caveat' END AS policy FROM sm),
fi AS (SELECT session_id, concat('incident-', k) AS fact_id, 'incident' AS kind, CASE WHEN lap_number IS NULL THEN message ELSE concat('Lap ', lap_number, ': ', message) END AS text, CAST(lap_number AS DOUBLE) AS value, CASE WHEN lap_number IS NOT NULL THEN 'lap' END AS unit, 'supported' AS quality, 'assert' AS policy FROM inc WHERE k <= 10),
fr AS (SELECT session_id, 'debrief-weather' AS fact_id, 'weather' AS kind, CASE WHEN bool_or(coalesce(rainfall, false)) THEN 'Rainfall was observed during the session.' ELSE 'No rainfall was observed during the session.' END AS text, CAST(CAST(bool_or(coalesce(rainfall, false)) AS INT) AS DOUBLE) AS value, 'boolean' AS unit, 'supported' AS quality, 'assert' AS policy FROM fx_weather GROUP BY session_id),
facts AS (SELECT * FROM fw UNION ALL SELECT * FROM fs UNION ALL SELECT * FROM fi UNION ALL SELECT * FROM fr)"""
SQUAL = "sq AS (SELECT session_id, count(*) FILTER (WHERE quality = 'supported' AND policy <> 'omit') AS supported, count(*) FILTER (WHERE quality = 'degraded' AND policy <> 'omit') AS degraded, count(*) FILTER (WHERE policy = 'omit') AS omitted FROM facts GROUP BY ALL)"
SCOLS = ["session_id", "driver_code", "lap_number", "from_compound", "to_compound", "pit_lane_time_ms", "track_status", "rival", "before_position", "after_position", "position_gain", "quality", "label", "field_average_ms"]


def _texts(column: str):
    return F.array_join(F.transform(column, lambda i: i["text"]), " ")


SEGMENTS = f"u AS (SELECT p.*, 'a' AS side, t.lap_time_ms, t.speed_kmh FROM v_pairs p JOIN fx_telemetry t ON t.session_id = p.session_id AND t.driver_code = p.driver_a AND t.lap_number = p.lap_a UNION ALL SELECT p.*, 'b', t.lap_time_ms, t.speed_kmh FROM v_pairs p JOIN fx_telemetry t ON t.session_id = p.session_id AND t.driver_code = p.driver_b AND t.lap_number = p.lap_b), v AS (SELECT *, CAST(least(floor(lap_time_ms * 3 / greatest(max(lap_time_ms) OVER (PARTITION BY {P}), 1)), 2) AS INT) + 1 AS segment FROM u), g AS (SELECT {P}, segment, avg(speed_kmh) FILTER (WHERE side = 'a') - avg(speed_kmh) FILTER (WHERE side = 'b') AS d FROM v GROUP BY ALL)"
STORY = f"WITH {SEGMENTS}, n AS (SELECT {P}, count(*) AS n, count(*) FILTER (WHERE d > 2) AS won FROM g GROUP BY ALL), t AS (SELECT {', '.join('p.' + c for c in PAIR)}, x.lap_time_ms - y.lap_time_ms AS dt FROM v_pairs p LEFT JOIN fx_laps x ON x.session_id = p.session_id AND x.driver_code = p.driver_a AND x.lap_number = p.lap_a LEFT JOIN fx_laps y ON y.session_id = p.session_id AND y.driver_code = p.driver_b AND y.lap_number = p.lap_b) SELECT {P}, dt AS delta_lap_time_ms, n, CASE WHEN dt <> 0 THEN concat(CASE WHEN dt < 0 THEN driver_a ELSE driver_b END, ' was faster by ', {DUR.format('abs(dt)')}, '.') WHEN n IS NOT NULL THEN concat(driver_a, ' was faster in ', won, ' segments.') END AS text FROM t LEFT JOIN n USING ({P})"
WINNER = f"""WITH e AS (SELECT * FROM (WITH {STAND.format(scope='')} SELECT * FROM s)), o AS (SELECT * FROM (WITH {STAND.format(scope='AND lap_number <= 1')} SELECT * FROM s)),
wn AS (SELECT session_id, driver_code AS winner FROM e WHERE position = 1),
ft AS (SELECT session_id, driver_code AS fastest_driver, best_lap_ms AS fastest_lap_ms FROM e WHERE best_lap_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY best_lap_ms, position, driver_code) = 1),
si AS (SELECT l.session_id, stint_number, compound, count(*) AS laps FROM fx_laps l JOIN wn ON wn.session_id = l.session_id AND wn.winner = l.driver_code WHERE stint_number IS NOT NULL GROUP BY ALL),
sh AS (SELECT *, round(100.0 * laps / sum(laps) OVER (PARTITION BY session_id), 1) AS share FROM si),
sg AS (SELECT session_id, string_agg(concat(compound, ' ', CAST(CAST(share AS DOUBLE) AS VARCHAR)), ',' ORDER BY stint_number, compound, share) AS stints, count(*) - 1 AS stops FROM sh GROUP BY ALL),
mv AS (SELECT session_id, max(o.position - e.position) AS largest_gain, min(o.position - e.position) AS largest_loss FROM e JOIN o USING (session_id, driver_code) GROUP BY ALL)
SELECT session_id, winner, fastest_driver, fastest_lap_ms, stops, largest_gain, largest_loss, stints FROM wn LEFT JOIN ft USING (session_id) LEFT JOIN sg USING (session_id) LEFT JOIN mv USING (session_id)"""

RACE = {
    "compare_laps": (lambda fx: r6(Q.compare_laps(pairs(fx), fx.telemetry, 1_800_000), *(f"{k}_{c}" for k in "ab" for c in CH), *(f"d_{c}" for c in CH[:3])), COMPARE),
    "compare_laps_summary": (lambda fx: r6(Q.compare_laps_summary(pairs(fx), fx.laps, fx.telemetry), "delta_avg_speed_kmh", "delta_max_speed_kmh"), f"WITH b AS ({LAPSUM}) SELECT {', '.join('p.' + c for c in PAIR)}, " + ", ".join((f"round(x.{c} - y.{c}, 6)" if "speed" in c else f"x.{c} - y.{c}") + f" AS delta_{c}" for c in Q.SUMMARY) + " FROM v_pairs p LEFT JOIN b x ON x.session_id = p.session_id AND x.driver_code = p.driver_a AND x.lap_number = p.lap_a LEFT JOIN b y ON y.session_id = p.session_id AND y.driver_code = p.driver_b AND y.lap_number = p.lap_b"),
    "compare_laps_segments": (lambda fx: r6(Q.compare_laps_segments(pairs(fx), fx.telemetry, 3), "delta_speed_kmh", "delta_throttle_pct", "delta_brake_pct"), f"WITH u AS (SELECT p.*, 'a' AS side, t.lap_time_ms, t.speed_kmh, t.throttle_pct, t.brake_pct FROM v_pairs p JOIN fx_telemetry t ON t.session_id = p.session_id AND t.driver_code = p.driver_a AND t.lap_number = p.lap_a UNION ALL SELECT p.*, 'b', t.lap_time_ms, t.speed_kmh, t.throttle_pct, t.brake_pct FROM v_pairs p JOIN fx_telemetry t ON t.session_id = p.session_id AND t.driver_code = p.driver_b AND t.lap_number = p.lap_b), v AS (SELECT *, CAST(least(floor(lap_time_ms * 3 / greatest(max(lap_time_ms) OVER (PARTITION BY {P}), 1)), 2) AS INT) + 1 AS segment FROM u), g AS (SELECT {P}, segment, " + ", ".join(f"avg({c}) FILTER (WHERE side = 'a') - avg({c}) FILTER (WHERE side = 'b') AS delta_{c}" for c in CH[:3]) + f" FROM v GROUP BY ALL) SELECT {P}, segment, " + ", ".join(f"round(delta_{c}, 6) AS delta_{c}" for c in CH[:3]) + ", CASE WHEN delta_speed_kmh > 2 THEN driver_a WHEN delta_speed_kmh < -2 THEN driver_b ELSE 'even' END AS advantage FROM g"),
    "compare_laps_by_distance": (lambda fx: r6(Q.compare_laps_by_distance(pairs(fx), fx.distance, 0, 800), "lap_progress", "delta_elapsed_ms"), f"WITH d AS MATERIALIZED (SELECT *, CAST(round(distance_m * 1000) AS BIGINT) AS mm FROM fx_distance WHERE distance_m BETWEEN 0 AND 800), q AS MATERIALIZED (SELECT * FROM v_pairs), x AS MATERIALIZED (SELECT q.*, d.* EXCLUDE (session_id, driver_code, lap_number) FROM q JOIN d ON d.session_id = q.session_id AND d.driver_code = q.driver_a AND d.lap_number = q.lap_a), y AS MATERIALIZED (SELECT q.*, d.* EXCLUDE (session_id, driver_code, lap_number) FROM q JOIN d ON d.session_id = q.session_id AND d.driver_code = q.driver_b AND d.lap_number = q.lap_b) SELECT {', '.join('x.' + c for c in PAIR)}, x.mm / 1000.0 AS distance_m, round((x.lap_progress + y.lap_progress) / 2, 6) AS lap_progress, round(x.elapsed_ms - y.elapsed_ms, 6) AS delta_elapsed_ms, " + ", ".join(f"x.{c} - y.{c} AS delta_{c}" for c in CH[:3]) + f" FROM x JOIN y USING ({P}, mm)"),
    "compare_by_distance_summary": (lambda fx: Q.compare_by_distance_summary(pairs(fx), fx.laps, fx.distance, fx.laps.select("session_id", "driver_code", "lap_number", F.when(F.col("is_accurate"), "valid").otherwise("incomplete").alias("quality_status"))), f"WITH f AS (SELECT session_id, driver_code, lap_number, last(elapsed_ms ORDER BY distance_m) AS finish_ms FROM fx_distance GROUP BY ALL), b AS (SELECT l.session_id, l.driver_code, l.lap_number, l.lap_time_ms, f.finish_ms, CASE WHEN is_accurate THEN 'valid' ELSE 'incomplete' END AS q FROM fx_laps l LEFT JOIN f USING (session_id, driver_code, lap_number)) SELECT {', '.join('p.' + c for c in PAIR)}, x.lap_time_ms - y.lap_time_ms AS official_delta_ms, x.finish_ms - y.finish_ms AS finish_delta_ms, abs((x.lap_time_ms - y.lap_time_ms) - (x.finish_ms - y.finish_ms)) AS difference_ms, x.q AS quality_a, y.q AS quality_b FROM v_pairs p LEFT JOIN b x ON x.session_id = p.session_id AND x.driver_code = p.driver_a AND x.lap_number = p.lap_a LEFT JOIN b y ON y.session_id = p.session_id AND y.driver_code = p.driver_b AND y.lap_number = p.lap_b"),
    "lap_story": (lambda fx: Q.lap_story(fx.laps, fx.telemetry).select("lap_id", _texts("insights").alias("text")), f"WITH b AS (SELECT l.lap_id, any_value(l.lap_time_ms) AS t, any_value(l.sector_1_ms) AS s1, any_value(l.sector_2_ms) AS s2, any_value(l.sector_3_ms) AS s3, any_value(compound) AS compound, any_value(tyre_life) AS tyre_life, max(speed_kmh) AS v, count(c.session_id) AS n FROM fx_laps l LEFT JOIN fx_telemetry c USING (session_id, driver_code, lap_number) WHERE NOT l.is_deleted GROUP BY l.lap_id), m AS (SELECT *, least(s1, s2, s3) AS s, CASE WHEN s1 = least(s1, s2, s3) THEN 1 WHEN s2 = least(s1, s2, s3) THEN 2 ELSE 3 END AS k FROM b) SELECT lap_id, concat_ws(' ', CASE WHEN t IS NOT NULL THEN concat('Lap time was ', {DUR.format('t')}, '.') END, CASE WHEN v IS NOT NULL THEN concat('Peak sampled speed was ', CAST(round_even(v, 0) AS BIGINT), ' km/h.') END, CASE WHEN s IS NOT NULL THEN concat('Fastest sector was S', k, ' at ', {DUR.format('s')}, '.') END, concat('Tyre context: ', compound, ', tyre life ', tyre_life, '.'), concat('Telemetry sample count for this lap is ', n, '.')) AS text FROM m"),
    "compare_laps_story": (lambda fx: Q.compare_laps_story(pairs(fx), fx.laps, fx.telemetry).select(*PAIR, "delta_lap_time_ms", F.size("segments").alias("n"), F.element_at(F.transform("insights", lambda i: i["text"]), 1).alias("text")), STORY),
    "pit_laps": (lambda fx: Q.pit_laps(fx.laps, fx.telemetry).select("session_id", "driver_code", "lap_number", "kind", "session_time_ms"), "SELECT p.session_id, p.driver_code, p.lap_number, p.pit_type AS kind, (SELECT min(session_time_ms) FROM fx_telemetry t WHERE t.session_id = p.session_id AND t.driver_code = p.driver_code AND t.lap_number = p.lap_number) AS session_time_ms FROM v_pit p"),
    "analyze_pit_stops": (lambda fx: Q.analyze_pit_stops(fx.laps, fx.telemetry, 3, 5000).select("session_id", "driver_code", "lap_number", "kind", "lap_time_ms", "nearby_baseline_lap_time_ms", "estimated_loss_ms"), "SELECT p.session_id, p.driver_code, p.lap_number, p.pit_type AS kind, p.lap_time_ms, CAST(round(avg(b.lap_time_ms)) AS BIGINT) AS nearby_baseline_lap_time_ms, any_value(p.lap_time_ms) - CAST(round(avg(b.lap_time_ms)) AS BIGINT) AS estimated_loss_ms FROM v_pit p LEFT JOIN fx_laps b ON b.session_id = p.session_id AND b.driver_code = p.driver_code AND b.lap_time_ms IS NOT NULL AND NOT b.is_deleted AND NOT b.is_pit_in_lap AND NOT b.is_pit_out_lap AND abs(b.lap_number - p.lap_number) BETWEEN 1 AND 3 GROUP BY p.session_id, p.driver_code, p.lap_number, p.pit_type, p.lap_time_ms"),
    "strategy_stops": (lambda fx: Q.strategy_stops(fx.laps, fx.track_status), f"WITH {STOPS} SELECT session_id, driver_code, lap_number, stint_number, from_compound, to_compound, pit_in_session_time_ms, pit_out_session_time_ms, pit_lane_time_ms, track_status, is_accurate FROM st"),
    "strategy_summary": (lambda fx: Q.strategy_summary(fx.laps, fx.track_status).select(*SCOLS), f"WITH {SUMMARY} SELECT {', '.join(SCOLS)} FROM sm"),
    "standings": (lambda fx: Q.standings(fx.laps, fx.drivers).select("session_id", "driver_code", "position", "laps_done", "gap_ms", "interval_ms", "best_lap_ms", "last_lap_ms", "compound", "pit_count", "status", "is_session_best", "is_personal_best"), f"WITH {STAND.format(scope='')}, w AS (SELECT *, last_value(end_ms IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ms, min(best_lap_ms) OVER (PARTITION BY session_id) AS best, max(laps_done) OVER (PARTITION BY session_id) AS most FROM s) SELECT session_id, driver_code, position, laps_done, coalesce(greatest(end_ms - (SELECT x.end_ms FROM s x WHERE x.session_id = w.session_id AND x.end_ms IS NOT NULL ORDER BY x.position LIMIT 1), 0), 0) AS gap_ms, CASE WHEN end_ms IS NULL OR prev_ms IS NULL THEN 0 ELSE greatest(end_ms - prev_ms, 0) END AS interval_ms, best_lap_ms, last_lap_ms, compound, pit_count, CASE WHEN coalesce(laps_done, -1) >= most - 1 THEN 'running' ELSE 'out' END AS status, coalesce(best_lap_ms = best, false) AS is_session_best, coalesce(last_lap_ms = best_lap_ms, false) AS is_personal_best FROM w"),
    "standings_at_lap": (lambda fx: Q.standings(fx.laps, fx.drivers, 3, "pit_count").select("session_id", "driver_code", "position", "place", "laps_done"), f"WITH {STAND.format(scope='AND lap_number <= 3')} SELECT session_id, driver_code, position, row_number() OVER (PARTITION BY session_id ORDER BY pit_count DESC, position) AS place, laps_done FROM s"),
    "position_changes": (lambda fx: Q.position_changes(fx.laps, fx.drivers), f"WITH {STAND.format(scope='')}, {STAND.format(scope='AND lap_number <= 1').replace('k AS', 'k1 AS', 1).replace('FROM k ', 'FROM k1 ').replace('d AS (', 'd1 AS (', 1).replace('l AS (', 'l1 AS (', 1).replace(chr(10) + 's AS (', chr(10) + 's1 AS (', 1).replace('JOIN d USING', 'JOIN d1 d USING').replace('JOIN l USING', 'JOIN l1 l USING')}, j AS (SELECT s.session_id, s.driver_code, s.full_name, CASE WHEN g.grid_position > 0 THEN g.grid_position ELSE s1.position END AS start, s.position AS finish FROM s JOIN s1 USING (session_id, driver_code) JOIN fx_drivers g USING (session_id, driver_code)) SELECT *, start - finish AS delta FROM j WHERE start IS NOT NULL"),
    "race_control_incidents": (lambda fx: Q.race_control_incidents(fx.track_status, fx.race_control, fx.drivers), f"WITH {INCIDENTS} SELECT session_id, type, lap_number, session_time_ms, message, driver_code, severity, seq, safety_periods FROM inc WHERE k <= 200"),
    "race_story": (lambda fx: Q.race_story(fx.sessions, fx.laps, fx.telemetry, fx.weather, fx.track_status, fx.race_control, 20).select("session_id", "event_name", "any_rain", F.size("stints").alias("stints"), F.size("pit_events").alias("pit_events"), F.size("periods").alias("periods"), F.size("messages").alias("messages"), _texts("insights").alias("text")), "WITH a AS (SELECT session_id, count(*) AS stints, string_agg(DISTINCT compound, ', ' ORDER BY compound) AS compounds FROM (SELECT DISTINCT session_id, driver_code, stint_number, compound FROM fx_laps) GROUP BY ALL), p AS (SELECT session_id, count(*) AS n FROM v_pit GROUP BY ALL), t AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE status_code <> '1') AS neutral FROM v_periods GROUP BY ALL), m AS (SELECT session_id, least(count(*), 20) AS n FROM fx_race_control GROUP BY ALL), w AS (SELECT session_id, bool_or(coalesce(rainfall, false)) AS any_rain FROM fx_weather GROUP BY ALL) SELECT s.session_id, s.event_name, w.any_rain, CAST(a.stints AS INT) AS stints, CAST(p.n AS INT) AS pit_events, CAST(t.n AS INT) AS periods, CAST(m.n AS INT) AS messages, concat_ws(' ', concat('Stint data contains ', a.stints, ' stints across compounds: ', compounds, '.'), concat('Detected ', p.n, ' pit-in/out lap markers.'), CASE WHEN neutral > 0 THEN concat('Track status includes ', neutral, ' non-clear period(s).') END, concat('Included ', m.n, ' race-control messages for narrative context.')) AS text FROM fx_sessions s LEFT JOIN a USING (session_id) LEFT JOIN p USING (session_id) LEFT JOIN t USING (session_id) LEFT JOIN m USING (session_id) LEFT JOIN w USING (session_id)"),
    "narrative_facts": (lambda fx: Q.narrative_facts(fx.laps, fx.drivers, fx.track_status, fx.race_control, fx.weather).drop("evidence"), f"WITH {FACTS} SELECT * FROM facts"),
    "story_quality": (lambda fx: Q.story_quality(Q.narrative_facts(fx.laps, fx.drivers, fx.track_status, fx.race_control, fx.weather)).drop("warnings"), f"WITH {FACTS}, {SQUAL} SELECT *, CASE WHEN degraded > 0 THEN 'degraded' WHEN supported > 0 THEN 'supported' ELSE 'unavailable' END AS status FROM sq"),
    "race_debrief": (lambda fx: Q.race_debrief(fx.sessions, fx.laps, fx.drivers, fx.track_status, fx.race_control, fx.weather).select("session_id", "headline", F.size("fact_ids").alias("facts"), "supported", "degraded", "incidents"), f"WITH {FACTS}, {SQUAL} SELECT f.session_id, max(CASE WHEN kind = 'winner' THEN text END) AS headline, CAST(count(*) AS INT) AS facts, any_value(sq.supported) AS supported, any_value(sq.degraded) AS degraded, (SELECT least(count(*), 50) FROM inc WHERE inc.session_id = f.session_id AND k <= 200) AS incidents FROM facts f JOIN sq USING (session_id) GROUP BY f.session_id"),
    "winner_report": (lambda fx: Q.winner_report(fx.laps, fx.drivers).select("session_id", "winner", "fastest_driver", "fastest_lap_ms", "stops", "largest_gain", "largest_loss", F.array_join(F.transform("stints", lambda s: F.concat(s["compound"], F.lit(" "), s["share"].cast("string"))), ",").alias("stints")), WINNER),
}
