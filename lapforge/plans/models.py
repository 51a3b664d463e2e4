"""Queries of clusters, geometry and batch forms of the streams over the fixture tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import clusters as M
from ..operators import geometry as G
from ..operators import lloyd
from ..sources.tables import shared_path
from ..streaming import runs
from ..streaming import streams as ST
from .core import EVENT, FAMILY, r6
from .quality import FEATURES, classified

LAP = ["session_id", "driver_code", "lap_number"]
ORDER = ["sample_time_utc", "source_sample_index"]
N = 24


def lines(fx):
    return G.resample_closed(fx.positions, ["session_id"], ORDER, N)


def reference(fx):
    return G.regular_polygon(fx.spark, N, 1000.0)


def streamed(fx, plan, closing=False, **inputs):
    """A stream's results over inputs that arrive in three slices of time, and then end where windows are open."""
    return runs.replay(inputs, plan, shared_path(fx.spark, "stream"), closing=closing)


PATH = """p AS (SELECT session_id, driver_code, lap_number, x, y, sample_time_utc, source_sample_index FROM fx_positions),
k AS (SELECT *, coalesce(x = lag(x) OVER w AND y = lag(y) OVER w, false) AS same FROM p WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY sample_time_utc, source_sample_index)),
s AS (SELECT session_id, driver_code, lap_number, sqrt(power(coalesce(lead(x) OVER w, first(x) OVER v) - x, 2) + power(coalesce(lead(y) OVER w, first(y) OVER v) - y, 2)) AS step FROM k WHERE NOT same WINDOW w AS (PARTITION BY session_id, driver_code, lap_number ORDER BY sample_time_utc, source_sample_index), v AS (PARTITION BY session_id, driver_code, lap_number ORDER BY sample_time_utc, source_sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
RES = f"""s0 AS (SELECT session_id, x, y, coalesce(lead(x) OVER w, first(x) OVER v) AS nx, coalesce(lead(y) OVER w, first(y) OVER v) AS ny, row_number() OVER w AS r FROM fx_positions WINDOW w AS (PARTITION BY session_id ORDER BY sample_time_utc, source_sample_index), v AS (PARTITION BY session_id ORDER BY sample_time_utc, source_sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s1 AS (SELECT *, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS step FROM s0), s2 AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY r) AS t, sum(step) OVER (PARTITION BY session_id) AS total FROM s1 WHERE step > 0),
m AS (SELECT s2.session_id, g.i, g.i * total / {N} AS target, x, y, nx, ny, step, t FROM s2, range(0, {N}) g(i) WHERE t > g.i * total / {N} + 1e-6 OR (g.i = 0 AND t > 0)),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, i ORDER BY t) = 1),
res AS (SELECT session_id, CAST(i AS INT) AS i, x + (nx - x) * greatest(0, target - (t - step)) / step AS x, y + (ny - y) * greatest(0, target - (t - step)) / step AS y FROM f)"""

#: All offsets in both directions, point by point.
FIT_SQL = f"""WITH {RES}, ref AS (SELECT CAST(g.i AS INT) AS j, cos(g.i * 2 * pi() / {N}) * 1000 AS u, sin(g.i * 2 * pi() / {N}) * 1000 AS v FROM range(0, {N}) g(i)),
t AS (SELECT CAST(o.i AS INT) AS o, d FROM range(0, {N}) o(i), (VALUES (1), (-1)) e(d)),
p AS (SELECT session_id, o, d, x, y, u, v FROM res, t JOIN ref ON j = ((i * d + o) % {N} + {N}) % {N}),
mm AS (SELECT session_id, o, d, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, avg(x * x + y * y) AS xx, avg(u * u + v * v) AS uu, avg(x * u + y * v) AS dt, avg(x * v - y * u) AS cr FROM p GROUP BY ALL),
c AS (SELECT *, xx - mx * mx - my * my AS sx, uu - mu * mu - mv * mv AS su, dt - mx * mu - my * mv AS dot, cr - mx * mv + my * mu AS crs FROM mm),
ff AS (SELECT *, dot / sx AS a, crs / sx AS b, sqrt(greatest(su - (dot * dot + crs * crs) / sx, 0)) AS rmse FROM c),
gg AS (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(rmse, 7), o, d) = 1),
e AS (SELECT p.session_id, rmse, sqrt(a * a + b * b) AS scale, sqrt(power(a * (x - mx) - b * (y - my) + mu - u, 2) + power(b * (x - mx) + a * (y - my) + mv - v, 2)) AS gap FROM p JOIN gg USING (session_id, o, d))
SELECT session_id, round(any_value(rmse), 4) AS rmse, round(any_value(scale), 6) AS scale, round(median(gap), 3) AS p50, round(max(gap), 3) AS worst FROM e GROUP BY session_id"""

def fixed_labels(fx):
    return fx.laps.select("lap_id", ((F.col("lap_number") + F.substring("driver_code", 2, 2).cast("int")) % 4).alias("cluster_id"))


SECTORS = ["sector_1_ms", "sector_2_ms"]
#: Centres of two models over the laps' first two sectors, in seconds.
CENTRES = [[[4600.0, 4700.125], [4600.625, 4700.75], [4609.0, 4708.0]], [[4600.25, 4700.25], [4601.5, 4701.25]]]


def _sector_points(fx):
    return lloyd.prepared(fx.laps.select("lap_id", F.array(*(F.col(c) / 1000.0 for c in SECTORS)).alias("features")), "lap_id")


def _models():
    return [lloyd.Model(len(c), k, np.array(c)) for k, c in enumerate(CENTRES)]


def _lloyd_step(fx):
    """Centres of both models after one step."""
    models = _models()
    lloyd.step(_sector_points(fx), models)
    rows = [(m.seed, c, float(round(v[0], 6)), float(round(v[1], 6))) for m in models for c, v in enumerate(m.centres)]
    return fx.spark.createDataFrame(rows, "model int, cluster int, a double, b double")


def _silhouette(fx):
    """Sizes, inertia and silhouette of both models as they are."""
    models = _models()
    lloyd.assess(_sector_points(fx), models)
    return fx.spark.createDataFrame([(m.seed, sum(m.sizes), round(m.inertia, 4), round(m.silhouette, 6)) for m in models], "model int, points long, inertia double, silhouette double")


_CENTRE_ROWS = ", ".join(f"({m}, {c}, {v[0]}, {v[1]})" for m, rows in enumerate(CENTRES) for c, v in enumerate(rows))
_NEAREST = f"""c(model, cluster, ca, cb) AS (VALUES {_CENTRE_ROWS}), p AS (SELECT lap_id, sector_1_ms / 1000.0 AS a, sector_2_ms / 1000.0 AS b FROM fx_laps WHERE sector_1_ms IS NOT NULL AND sector_2_ms IS NOT NULL),
d AS (SELECT c.*, p.*, power(CAST(a - ca AS DOUBLE), 2) + power(CAST(b - cb AS DOUBLE), 2) AS gap FROM p, c QUALIFY row_number() OVER (PARTITION BY model, lap_id ORDER BY gap, cluster) = 1)"""
LLOYD_SQL = f"WITH {_NEAREST} SELECT c.model, c.cluster, round(CAST(coalesce(avg(d.a), any_value(c.ca)) AS DOUBLE), 6) AS a, round(CAST(coalesce(avg(d.b), any_value(c.cb)) AS DOUBLE), 6) AS b FROM c LEFT JOIN d USING (model, cluster) GROUP BY c.model, c.cluster"
#: Pair by pair.
SILHOUETTE_SQL = f"""WITH {_NEAREST}, n AS (SELECT model, cluster, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT x.model, x.lap_id, x.cluster, y.cluster AS other, sum(power(CAST(x.a - y.a AS DOUBLE), 2) + power(CAST(x.b - y.b AS DOUBLE), 2)) AS total FROM d x JOIN d y ON x.model = y.model GROUP BY ALL),
s AS (SELECT q.model, lap_id, max(CASE WHEN q.cluster = other THEN total / greatest(n - 1, 1) END) AS inside, min(CASE WHEN q.cluster <> other THEN total / n END) AS outside, max(CASE WHEN q.cluster = other THEN n END) AS own FROM q JOIN n ON n.model = q.model AND n.cluster = other GROUP BY ALL),
i AS (SELECT model, sum(gap) AS inertia FROM d GROUP BY model)
SELECT s.model, count(*) AS points, round(any_value(inertia), 4) AS inertia, round(avg(CASE WHEN own > 1 AND greatest(inside, outside) > 0 THEN (outside - inside) / greatest(inside, outside) ELSE 0 END), 6) AS silhouette FROM s JOIN i ON i.model = s.model GROUP BY s.model"""
PROFILE_SQL = f"""WITH {FEATURES}, l AS (SELECT *, CAST((lap_number + CAST(substr(driver_code, 2, 2) AS INT)) % 4 AS INT) AS cluster_id FROM cl)
SELECT cluster_id, count(*) AS laps, round(100.0 * count(*) FILTER (WHERE bad) / count(*), 6) AS bad_pct, round(median(rms), 6) AS median_shape_rms, median(lap_time_ms) AS median_lap_time_ms, round(median(cov), 6) AS median_car_coverage,
 round(100.0 * count(*) FILTER (WHERE c7) / count(*), 6) AS pit_sc_pct, round(100.0 * count(*) FILTER (WHERE c9) / count(*), 6) AS source_anomaly_pct, round(100.0 * count(*) FILTER (WHERE c6) / count(*), 6) AS position_discontinuity_pct,
 CAST(0.25 AS DOUBLE) AS pca_variance_1, CAST(0.125 AS DOUBLE) AS pca_variance_2, CAST(0.5 AS DOUBLE) AS silhouette FROM l GROUP BY cluster_id"""

MODELS = {
    "cluster_messages": (lambda fx: M.cluster_messages(fx.race_control).select("race_control_message_id", "cluster_id", "cluster_terms"), None),
    "message_cluster_summary": (lambda fx: M.message_cluster_summary(fx.race_control, M.cluster_messages(fx.race_control)), None),
    "lap_shape_clusters": (lambda fx: M.lap_shape_clusters(classified(fx))[0].select("lap_id", "cluster_id", F.round("distance_to_centre", 4).alias("distance")), None),
    "lap_shape_profile": (lambda fx: r6(M.lap_shape_clusters(classified(fx))[1], "bad_pct", "median_shape_rms", "median_car_coverage", "pit_sc_pct", "source_anomaly_pct", "position_discontinuity_pct", "silhouette"), None),
    "cluster_profile": (lambda fx: r6(M.cluster_profile(classified(fx), fixed_labels(fx), 0.5, (0.25, 0.125)), "bad_pct", "median_shape_rms", "median_car_coverage", "pit_sc_pct", "source_anomaly_pct", "position_discontinuity_pct"), PROFILE_SQL),
    "cluster_silhouette": (_silhouette, SILHOUETTE_SQL),
    "lloyd_step": (_lloyd_step, LLOYD_SQL),
    "cluster_exemplars": (lambda fx: M.cluster_exemplars(M.lap_shape_clusters(classified(fx))[0]), None),
    "cluster_stability": (lambda fx: M.cluster_stability(classified(fx)), None),
    "adjusted_rand": (lambda fx: r6(M.adjusted_rand(fx.telemetry.select((F.col("gear") % 3).alias("a"), (F.col("drs") + F.col("gear") % 2).alias("b")), "a", "b"), "ari"), "WITH c AS (SELECT gear % 3 AS a, drs + gear % 2 AS b, CAST(count(*) AS DOUBLE) AS n FROM fx_telemetry GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((t.s - x.s * y.s / (t.n * (t.n - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t, x, y"),
    "lap_path_length": (lambda fx: r6(G.lap_path_length(fx.positions, LAP, ORDER), "path_length"), f"WITH {PATH} SELECT session_id, driver_code, lap_number, count(*) AS points, round(sum(step), 6) AS path_length FROM s GROUP BY ALL"),
    "candidate_laps": (lambda fx: G.candidate_laps(G.lap_path_length(fx.positions, LAP, ORDER), fx.laps, 2, 0.5).select(*LAP), f"WITH {PATH}, l AS (SELECT session_id, driver_code, lap_number, count(*) AS points, sum(step) AS path_length FROM s GROUP BY ALL), g AS (SELECT l.* FROM l JOIN fx_laps f USING (session_id, driver_code, lap_number) WHERE is_accurate AND NOT is_pit_in_lap AND NOT is_pit_out_lap AND points >= 2), m AS (SELECT session_id, median(path_length) AS md FROM g GROUP BY ALL) SELECT session_id, driver_code, lap_number FROM g JOIN m USING (session_id) WHERE abs(path_length - md) <= 0.5 * md"),
    "resample_closed": (lambda fx: lines(fx).select("session_id", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")), f"WITH {RES} SELECT session_id, i, round(x, 3) AS x, round(y, 3) AS y FROM res"),
    "fit_shape": (lambda fx: G.fit_shape(lines(fx), reference(fx), ["session_id"], N).select("session_id", F.round("rmse", 4).alias("rmse"), F.round("scale", 6).alias("scale"), F.round("p50", 3).alias("p50"), F.round("max", 3).alias("worst")), FIT_SQL),
    "average_fitted_laps": (lambda fx: r6(G.average_fitted_laps(lines(fx), G.fit_shape(lines(fx), reference(fx), ["session_id"], N), ["session_id"], N), "x", "y"), None),
    "line_difference": (lambda fx: r6(G.line_difference(lines(fx), lines(fx).select("session_id", "i", (F.col("x") + F.col("i")).alias("x"), "y"), ["session_id"]), "rmse", "p50", "p95", "max"), f"WITH {RES} SELECT session_id, round(sqrt(avg(i * i)), 6) AS rmse, round(median(i), 6) AS p50, round(quantile_cont(i, 0.95), 6) AS p95, round(CAST(max(i) AS DOUBLE), 6) AS max FROM res GROUP BY session_id"),
    "stream_event_candidates": (lambda fx: streamed(fx, ST.stream_event_candidates, samples=fx.telemetry).select("source_sample_index", "event_type"), f"SELECT source_sample_index, {EVENT} AS event_type FROM fx_telemetry WHERE {EVENT} IS NOT NULL"),
    "stream_tumbling_metrics": (lambda fx: r6(streamed(fx, lambda s: ST.stream_tumbling_metrics(s, "2 hours"), closing=True, samples=fx.telemetry), "avg_speed_kmh"), "SELECT session_id, driver_code, time_bucket(INTERVAL '2 hours', sample_time_utc) AS window_start, count(*) AS samples, round(avg(speed_kmh), 6) AS avg_speed_kmh, max(speed_kmh) AS max_speed_kmh, count(*) FILTER (WHERE throttle_pct <= 10 AND speed_kmh >= 150) AS throttle_lifts FROM fx_telemetry GROUP BY ALL"),
    "stream_degraded_segments": (lambda fx: streamed(fx, lambda s: ST.stream_degraded_segments(s, "1 hour"), closing=True, aligned=fx.aligned), f"WITH n AS (SELECT * FROM fx_aligned WHERE {FAMILY} <> 'OK'), s AS (SELECT *, CASE WHEN epoch_us(sample_time_utc) - epoch_us(lag(sample_time_utc) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY session_id, driver_code ORDER BY sample_time_utc)), t AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, driver_code ORDER BY sample_time_utc) AS k FROM s) SELECT session_id, driver_code, min(session_time_ms) AS start_ms, max(session_time_ms) AS end_ms, count(*) AS samples FROM t GROUP BY session_id, driver_code, k"),
    "stream_dedupe": (lambda fx: streamed(fx, ST.stream_dedupe, samples=fx.telemetry.select("session_id", "driver_code", F.date_trunc("hour", "sample_time_utc").alias("sample_time_utc"))), "SELECT DISTINCT session_id, driver_code, date_trunc('hour', sample_time_utc) AS sample_time_utc FROM fx_telemetry"),
    "stream_pair_positions": (lambda fx: streamed(fx, ST.stream_pair_positions, samples=fx.telemetry, positions=fx.positions).select("car_index", "x", "y"), "SELECT c.source_sample_index AS car_index, p.x, p.y FROM fx_telemetry c JOIN fx_positions p ON p.session_id = c.session_id AND p.driver_code = c.driver_code AND abs(epoch_us(p.sample_time_utc) - epoch_us(c.sample_time_utc)) <= 500000"),
}
