"""Data-quality analytics: lap features, classification and reports; session surfaces, windows, coverage and readiness."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import FAMILIES, first_match, message_taxonomy, normalize_message_text, quality_family
from .aggregates import lap_channel_features, marker_bounds, speed_profile
from .joins import lap_race_control, lap_status_overlap, overlap_counts, track_status_periods
from .lookups import top_n
from .selection import exact_percentiles
from .sequences import lap_gap_features, position_step_features

LAP = ["session_id", "driver_code", "lap_number"]


def _n() -> Column:
    return F.count(F.lit(1))



@dataclass(frozen=True)
class LapThresholds:
    """Limits of the lap classification (fixed default values)."""

    min_car_samples: float = 50
    min_position_samples: float = 100
    min_lap_coverage_ratio: float = 0.80
    path_length_tolerance_pct: float = 0.05
    telemetry_p95_gap_ms: float = 500.0
    telemetry_max_gap_ms: float = 2_000.0
    speed_min_kmh: float = 0.0
    speed_max_kmh: float = 380.0
    rpm_min: float = 0.0
    rpm_max: float = 16_000.0
    gear_min: float = -1
    gear_max: float = 9
    shape_rms_min_kmh: float = 25.0
    shape_rms_iqr_multiplier: float = 3.0
    shape_required_bins: float = 12
    position_segment_mad_multiplier: float = 8.0


#: Categories in report order, and the order in which the first one that holds is the primary (fixed values).
CATEGORIES = ["missing_or_sparse_telemetry", "incomplete_lap_window", "distance_reset_or_non_monotonic_distance", "implausible_channel_values", "shape_mismatch_against_comparable_laps", "position_trace_discontinuity", "pit_lane_or_safety_car_influenced", "timing_session_boundary_artifact", "import_or_source_data_anomaly", "unknown_needs_inspection"]
PRIORITY = ["missing_or_sparse_telemetry", "timing_session_boundary_artifact", "incomplete_lap_window", "implausible_channel_values", "position_trace_discontinuity", "pit_lane_or_safety_car_influenced", "shape_mismatch_against_comparable_laps", "import_or_source_data_anomaly", "unknown_needs_inspection"]
BLOCKING = ["missing_or_sparse_telemetry", "incomplete_lap_window", "implausible_channel_values", "position_trace_discontinuity", "timing_session_boundary_artifact"]
INTEGRITY = [*BLOCKING, "distance_reset_or_non_monotonic_distance", "import_or_source_data_anomaly"]
DISPLAY = {"shape_mismatch_against_comparable_laps": "atypical_speed_profile"}
BINS = [f"speed_bin_{k:02d}" for k in range(1, 21)]


def lap_quality_features(laps: DataFrame, windows: DataFrame, samples: DataFrame, positions: DataFrame, drivers: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Laps with channel, gap, position, status and message features. windows: lap_id, lap_start_ms, lap_end_ms."""
    out = laps.join(windows.select("lap_id", F.col("lap_start_ms").alias("lap_start_session_ms"), F.col("lap_end_ms").alias("lap_end_session_ms")), "lap_id", "left")
    for part in (lap_channel_features(samples), lap_gap_features(samples), position_step_features(positions)):
        out = out.join(part, LAP, "left")
    out = out.join(lap_status_overlap(windows, events), "lap_id", "left").join(lap_race_control(laps, drivers, messages), "lap_id", "left")
    return out.fillna(0, ["car_samples", "position_samples", "safety_car_periods", "virtual_safety_car_periods", "red_flag_periods", "race_control_messages", "race_control_flag_messages"])


def _limit(t, name: str) -> Column:
    return F.col(f"t_{name}") if t is None else F.lit(float(getattr(t, name)))


def derived_lap_features(features: DataFrame, profiles: DataFrame, thresholds: LapThresholds | None = LapThresholds(), by: list[str] = ("session_id",)) -> DataFrame:
    """Coverage, null rates, and how a lap compares with its session's reference laps.

    Reference laps are accurate, off the pit lane and well covered. The segment limit is median + k MAD;
    where the MAD is 0 or missing it is the 99th percentile of all laps. The shape limit is the median
    plus the larger of a floor and k IQR. With ``thresholds`` None, limits are columns named ``t_...``.
    """
    limit = lambda n: _limit(thresholds, n)
    by = list(by)
    df = features.join(profiles, LAP, "left")
    nulls = F.col("speed_nulls") + F.col("throttle_nulls") + F.col("brake_nulls") + F.col("rpm_nulls")
    df = df.withColumns({
        "car_coverage_ratio": (F.col("car_lap_time_max_ms") - F.col("car_lap_time_min_ms")) / F.nullif("lap_time_ms", F.lit(0)),
        "telemetry_null_rate": nulls / (F.nullif("car_samples", F.lit(0)) * 4),
        "position_null_rate": F.col("position_xy_nulls") / F.nullif("position_samples", F.lit(0)),
        "speed_profile_bins_present": sum((F.col(b).isNotNull().cast("int") for b in BINS), F.lit(0)),
    })
    reference = F.coalesce(F.col("is_accurate"), F.lit(False)) & ~F.coalesce("is_pit_in_lap", F.lit(False)) & ~F.coalesce("is_pit_out_lap", F.lit(False)) & (F.col("position_samples") >= limit("min_position_samples")) & F.col("position_path_length_units").isNotNull() & F.coalesce(F.col("car_coverage_ratio") >= limit("min_lap_coverage_ratio"), F.lit(False))
    df = df.withColumn("is_reference", reference)
    ref = df.where("is_reference")
    first = ref.groupBy(*by).agg(F.median("position_path_length_units").alias("session_reference_path_length_units"), F.median("position_max_segment_units").alias("_seg"), *(F.median(b).alias(f"{b}_m") for b in BINS))
    mad = ref.where("position_max_segment_units is not null").join(first.select(*by, "_seg"), by).groupBy(*by).agg(F.median(F.abs(F.col("position_max_segment_units") - F.col("_seg"))).alias("_mad"))
    wide = df.groupBy(*by).agg(F.percentile("position_max_segment_units", 0.99).alias("_q99"))
    df = df.join(first, by, "left").join(mad, by, "left").join(wide, by, "left")
    residuals = F.filter(F.array(*(F.pow(F.col(b) - F.col(f"{b}_m"), 2) for b in BINS)), lambda x: x.isNotNull())
    rms = F.when(F.size(residuals) > 0, F.sqrt(F.aggregate(residuals, F.lit(0.0), lambda s, x: s + x) / F.size(residuals)))
    df = df.withColumns({"position_path_ratio": F.col("position_path_length_units") / F.col("session_reference_path_length_units"), "position_segment_limit_units": F.coalesce(F.col("_seg") + limit("position_segment_mad_multiplier") * F.nullif("_mad", F.lit(0.0)), F.col("_q99")), "speed_shape_rms_kmh": rms})
    shape = df.where("is_reference and speed_shape_rms_kmh is not null").groupBy(*by).agg(F.median("speed_shape_rms_kmh").alias("speed_shape_session_median_kmh"), (F.percentile("speed_shape_rms_kmh", 0.75) - F.percentile("speed_shape_rms_kmh", 0.25)).alias("speed_shape_iqr_kmh"))
    df = df.join(shape, by, "left")
    top = F.col("speed_shape_session_median_kmh") + F.greatest(limit("shape_rms_min_kmh"), limit("shape_rms_iqr_multiplier") * F.coalesce("speed_shape_iqr_kmh", F.lit(0.0)))
    return df.withColumn("speed_shape_limit_kmh", top).drop("_seg", "_mad", "_q99", *(f"{b}_m" for b in BINS))


def classify_laps(df: DataFrame, thresholds: LapThresholds | None = LapThresholds()) -> DataFrame:
    """Ten category flags, primary category, reasons, lenses, severities, safety flags and a recommendation. A comparison with a missing value is false."""
    limit = lambda n: _limit(thresholds, n)
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    flags = {
        "missing_or_sparse_telemetry": no(c("car_samples") < limit("min_car_samples")) | no(c("position_samples") < limit("min_position_samples")),
        "incomplete_lap_window": c("lap_time_ms").isNull() | c("lap_start_utc").isNull() | c("lap_end_utc").isNull() | no(c("car_coverage_ratio") < limit("min_lap_coverage_ratio")),
        # no distance is stored with raw samples, so this one is never found
        "distance_reset_or_non_monotonic_distance": F.lit(False),
        "implausible_channel_values": reduce(Column.__or__, (no(x) for x in (c("min_speed_kmh") < limit("speed_min_kmh"), c("max_speed_kmh") > limit("speed_max_kmh"), c("min_rpm") < limit("rpm_min"), c("max_rpm") > limit("rpm_max"), c("min_gear") < limit("gear_min"), c("max_gear") > limit("gear_max"), c("min_throttle_pct") < 0, c("max_throttle_pct") > 100, c("min_brake_pct") < 0, c("max_brake_pct") > 100))),
        "shape_mismatch_against_comparable_laps": no((c("speed_profile_bins_present") >= limit("shape_required_bins")) & (c("speed_shape_rms_kmh") > c("speed_shape_limit_kmh"))),
        "position_trace_discontinuity": no(c("position_path_ratio") < 1.0 - limit("path_length_tolerance_pct")) | no(c("position_path_ratio") > 1.0 + limit("path_length_tolerance_pct")) | (c("position_path_ratio").isNotNull() & no(c("position_max_segment_units") > c("position_segment_limit_units"))),
        "pit_lane_or_safety_car_influenced": no(c("is_pit_in_lap")) | no(c("is_pit_out_lap")) | no(c("safety_car_periods") > 0) | no(c("virtual_safety_car_periods") > 0) | no(c("red_flag_periods") > 0),
        "timing_session_boundary_artifact": c("lap_start_session_ms").isNull() | c("lap_end_session_ms").isNull() | no(c("car_out_of_order_steps") > 0) | no(c("car_lap_time_negative_steps") > 0) | no(c("car_p95_gap_ms") > limit("telemetry_p95_gap_ms")) | no(c("car_max_gap_ms") > limit("telemetry_max_gap_ms")),
        "import_or_source_data_anomaly": ~F.coalesce("is_accurate", F.lit(True)) | no(c("is_deleted")),
    }
    df = df.withColumns(flags)
    others = [x for x in flags if x != "shape_mismatch_against_comparable_laps"]
    any_of = lambda names: reduce(Column.__or__, map(F.col, names))
    df = df.withColumn("unknown_needs_inspection", c("shape_mismatch_against_comparable_laps") & ~any_of(others))
    df = df.withColumns({
        "bad_lap_any_category": any_of(CATEGORIES),
        "primary_category": first_match([(c(x), x) for x in PRIORITY], "clean"),
        "reason_count": sum((c(x).cast("int") for x in CATEGORIES), F.lit(0)),
        "reason_set": F.coalesce(F.nullif(F.concat_ws(" + ", *(F.when(c(x), DISPLAY.get(x, x)) for x in CATEGORIES)), F.lit("")), F.lit("clean")),
        "data_integrity_flag": any_of(INTEGRITY),
        "replay_blocking_integrity_flag": any_of(BLOCKING),
        "race_context_flag": c("pit_lane_or_safety_car_influenced"),
        "analytical_shape_flag": c("shape_mismatch_against_comparable_laps") | c("unknown_needs_inspection"),
    })
    over = lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    positive = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    deficit = F.when(c("incomplete_lap_window") & c("car_coverage_ratio").isNull(), limit("min_lap_coverage_ratio") * 100).otherwise(F.coalesce(positive(limit("min_lap_coverage_ratio") - c("car_coverage_ratio")), F.lit(0.0)) * 100)
    deviation = F.coalesce(F.abs(c("position_path_ratio") - 1.0) * 100, F.lit(0.0))
    df = df.withColumns({
        "coverage_deficit_pct": deficit,
        "p95_gap_excess_ms": over(c("car_p95_gap_ms") - limit("telemetry_p95_gap_ms")),
        "max_gap_excess_ms": over(c("car_max_gap_ms") - limit("telemetry_max_gap_ms")),
        "path_ratio_deviation_pct": deviation,
        "path_ratio_excess_pct": over(deviation - limit("path_length_tolerance_pct") * 100),
        "max_segment_jump_excess_units": over(c("position_max_segment_units") - c("position_segment_limit_units")),
        "speed_shape_excess_kmh": over(c("speed_shape_rms_kmh") - c("speed_shape_limit_kmh")),
        "speed_shape_robust_z": F.coalesce((c("speed_shape_rms_kmh") - c("speed_shape_session_median_kmh")) / F.nullif("speed_shape_iqr_kmh", F.lit(0.0)), F.lit(0.0)),
        "null_rate_severity_pct": F.greatest(F.coalesce("telemetry_null_rate", F.lit(0.0)), F.coalesce("position_null_rate", F.lit(0.0))) * 100,
    })
    clean = ~(c("data_integrity_flag") | c("race_context_flag") | c("analytical_shape_flag"))
    review = c("unknown_needs_inspection") | (c("analytical_shape_flag") & ~c("data_integrity_flag") & ~c("race_context_flag")) | c("implausible_channel_values")
    df = df.withColumns({"safe_for_replay": ~c("replay_blocking_integrity_flag"), "safe_for_time_domain_analysis": clean, "safe_for_lap_comparison": clean, "safe_for_geometry_reference": clean & no(c("position_samples") >= limit("min_position_samples")), "needs_manual_review": review})
    return df.withColumn("product_recommendation", F.when(c("replay_blocking_integrity_flag"), "exclude").when(c("needs_manual_review"), "manual_review").when(c("race_context_flag") | c("import_or_source_data_anomaly"), "keep_with_context_label").otherwise("keep"))


LENSES = ["data_integrity_flag", "replay_blocking_integrity_flag", "race_context_flag", "analytical_shape_flag"]
SAFETY = ["safe_for_replay", "safe_for_time_domain_analysis", "safe_for_lap_comparison", "safe_for_geometry_reference", "needs_manual_review"]


def _flag_counts(df: DataFrame, flags: list[str], name: str, by: list[str] = ()) -> DataFrame:
    """Rows (by, name, laps, pct): how many rows have each flag, in one pass."""
    counts = df.groupBy(*by).agg(_n().alias("_n"), *(F.count_if(c).alias(c) for c in flags))
    long = counts.select(*by, "_n", F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias("laps")) for c in flags))).alias("x"))
    return long.select(*by, "x.*", (100.0 * F.col("x.laps") / F.col("_n")).alias("pct"))


def lap_summary_report(df: DataFrame, kind: str) -> DataFrame:
    """One of the reports over classified laps: categories, primary, lenses, safety, recommendations, by_race, by_driver, intersections, primary_by_race, driver_race_matrix."""
    share = lambda keys: df.groupBy(*keys).agg(_n().alias("laps"), F.count_if("bad_lap_any_category").alias("flagged_laps")).withColumn("flagged_pct", 100.0 * F.col("flagged_laps") / F.col("laps"))
    if kind == "categories":
        return _flag_counts(df, CATEGORIES, "category")
    if kind == "lenses":
        return _flag_counts(df, LENSES, "lens")
    if kind == "safety":
        return _flag_counts(df, SAFETY, "use")
    if kind == "primary":
        return df.groupBy("primary_category").agg(_n().alias("laps"))
    if kind == "recommendations":
        return df.groupBy("product_recommendation").agg(_n().alias("laps"))
    if kind == "intersections":
        return df.groupBy("reason_set", "reason_count").agg(_n().alias("laps"))
    if kind == "primary_by_race":
        return df.groupBy("session_id", "primary_category").agg(_n().alias("laps"))
    if kind == "by_race":
        return share(["session_id"])
    if kind == "by_driver":
        return share(["driver_code"])
    if kind == "driver_race_matrix":
        return share(["driver_code", "session_id"])
    raise ValueError(f"unknown report {kind}")


#: Steps in which laps leave the waterfall, each with the categories that it merges (fixed values).
WATERFALL = [
    ("source_or_timing_excluded", ["import_or_source_data_anomaly", "timing_session_boundary_artifact"]),
    ("missing_or_incomplete_telemetry", ["missing_or_sparse_telemetry", "incomplete_lap_window"]),
    ("implausible_channel_values", ["implausible_channel_values"]),
    ("position_trace_discontinuity", ["position_trace_discontinuity"]),
    ("race_context_influenced", ["pit_lane_or_safety_car_influenced"]),
    ("atypical_speed_profile", ["shape_mismatch_against_comparable_laps"]),
    ("other_or_manual_review", ["bad_lap_any_category"]),
]


def decision_waterfall(df: DataFrame) -> DataFrame:
    """All laps, how many each step takes from those that are left, and the clean ones: laps, share of all, and how many remain after it."""
    conditions = [(reduce(Column.__or__, map(F.col, names)), k) for k, (_, names) in enumerate(WATERFALL)]
    steps = [name for name, _ in WATERFALL]
    taken = first_match(conditions, len(steps))
    counts = df.select(taken.alias("k")).agg(_n().alias("n"), *(F.count_if(F.col("k") == k).alias(f"s{k}") for k in range(len(steps) + 1)))
    left = lambda k: F.col("n") - sum((F.col(f"s{j}") for j in range(k + 1)), F.lit(0))
    row = lambda name, laps, rest: F.struct(F.lit(name).alias("step"), laps.alias("laps"), F.coalesce(100.0 * laps / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("pct_of_all_laps"), rest.cast("long").alias("remaining_laps_after_step"))
    rows = [row("total_laps", F.col("n"), F.col("n")), *(row(x, F.col(f"s{k}"), left(k)) for k, x in enumerate(steps)), row("clean_after_waterfall", F.col(f"s{len(steps)}"), F.lit(0))]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _display(category: Column) -> Column:
    return first_match([(category == k, v) for k, v in DISPLAY.items()], category)


def event_rounds(sessions: DataFrame) -> DataFrame:
    """(session_id, event_name, event_round): sessions numbered by start (unknown ones last) and event; equal ones share a number."""
    # one row a session
    order = Window.orderBy(F.col("session_start_utc").asc_nulls_last(), "event_name")
    return sessions.select("session_id", "event_name", F.dense_rank().over(order).alias("event_round"))


def primary_category_audit(df: DataFrame, sessions: DataFrame, limit: int = 80) -> DataFrame:
    """Flagged laps with several reasons, the first ``limit`` by a priority of coverage, gaps, path, shape and reasons; ties by round and lap."""
    priority = F.col("coverage_deficit_pct") + F.col("p95_gap_excess_ms") / 100 + F.col("path_ratio_excess_pct") + F.col("speed_shape_excess_kmh") + F.col("reason_count") * 2
    second = F.concat_ws(" + ", *(F.when(F.col(x) & (F.col("primary_category") != x), DISPLAY.get(x, x)) for x in CATEGORIES))
    rows = df.where("bad_lap_any_category and reason_count > 1").join(event_rounds(sessions), "session_id")
    out = rows.select("event_round", "event_name", *LAP, _display(F.col("primary_category")).alias("primary_category"), second.alias("secondary_reason_set"), "reason_count", "product_recommendation", "safe_for_replay", "safe_for_lap_comparison", "coverage_deficit_pct", "p95_gap_excess_ms", "path_ratio_excess_pct", "speed_shape_excess_kmh", priority.alias("audit_priority"))
    return out.orderBy(F.desc(F.round("audit_priority", 9)), "event_round", *LAP).limit(limit)


def race_drilldown(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per event and primary category: laps, drivers and medians of lap time and coverage."""
    rows = df.join(sessions.select("session_id", "event_name"), "session_id")
    return rows.groupBy("event_name", "primary_category").agg(_n().alias("laps"), F.count_distinct("driver_code").alias("drivers"), F.median("lap_time_ms").alias("median_lap_time_ms"), F.median("car_coverage_ratio").alias("median_coverage_ratio"))


#: Variations of single limits (fixed values).
SCENARIOS = [
    ("min_car_samples_loose", "min_car_samples", 40.0),
    ("min_car_samples_strict", "min_car_samples", 75.0),
    ("min_position_samples_loose", "min_position_samples", 80.0),
    ("min_position_samples_strict", "min_position_samples", 150.0),
    ("lap_coverage_loose", "min_lap_coverage_ratio", 0.75),
    ("lap_coverage_strict", "min_lap_coverage_ratio", 0.85),
    ("p95_gap_loose", "telemetry_p95_gap_ms", 600.0),
    ("p95_gap_strict", "telemetry_p95_gap_ms", 450.0),
    ("max_gap_loose", "telemetry_max_gap_ms", 2300.0),
    ("max_gap_strict", "telemetry_max_gap_ms", 1800.0),
    ("path_tolerance_loose", "path_length_tolerance_pct", 0.06),
    ("path_tolerance_strict", "path_length_tolerance_pct", 0.04),
    ("shape_rms_loose", "shape_rms_min_kmh", 30.0),
    ("shape_rms_strict", "shape_rms_min_kmh", 20.0),
]


def scenarios(base: LapThresholds = LapThresholds()) -> list[tuple[str, LapThresholds]]:
    """The baseline and its variations."""
    return [("baseline", base), *((name, replace(base, **{limit: value})) for name, limit, value in SCENARIOS)]


#: What a scenario can change in a lap, and the names of its flips.
CHANGES = {"bad_lap_any_category": "bad_flag", "safe_for_replay": "replay_safety", "safe_for_lap_comparison": "lap_comparison_safety", "product_recommendation": "recommendation", "primary_category": "primary_category"}


def _scenario_laps(features: DataFrame, profiles: DataFrame, base: LapThresholds) -> DataFrame:
    """Every lap under every scenario, with what changed against the baseline. All scenarios go through one plan, as columns."""
    rows = [(name, *(float(v) for v in asdict(t).values())) for name, t in scenarios(base)]
    table = features.sparkSession.createDataFrame(rows, ["scenario", *(f"t_{f.name}" for f in fields(LapThresholds))])
    # fifteen rows, whatever the data
    wide = features.crossJoin(F.broadcast(table))
    done = classify_laps(derived_lap_features(wide, profiles, None, ["session_id", "scenario"]), None)
    done = done.select("scenario", *LAP, *CHANGES, "needs_manual_review").withColumn("primary_category", _display(F.col("primary_category")))
    base_row = F.max(F.when(F.col("scenario") == "baseline", F.struct(*CHANGES))).over(Window.partitionBy(*LAP))
    done = done.withColumn("was", base_row)
    return done.withColumns({f"{name}_changed": F.col(c) != F.col(f"was.{c}") for c, name in CHANGES.items()})


def threshold_sensitivity(features: DataFrame, profiles: DataFrame, sessions: DataFrame, kind: str = "summary", base: LapThresholds = LapThresholds()) -> DataFrame:
    """How far classified laps depend on single limits. Kinds: summary (by scenario), by_race, by_driver, borderline (laps that change in any scenario)."""
    done = _scenario_laps(features, profiles, base)
    if kind == "summary":
        counts = {"bad_laps": F.col("bad_lap_any_category"), "replay_unsafe_laps": ~F.col("safe_for_replay"), "lap_comparison_unsafe_laps": ~F.col("safe_for_lap_comparison"), "manual_review_laps": F.col("needs_manual_review"), "exclude_laps": F.col("product_recommendation") == "exclude", "context_label_laps": F.col("product_recommendation") == "keep_with_context_label"}
        out = done.groupBy("scenario").agg(_n().alias("_laps"), *(F.count_if(v).alias(k) for k, v in counts.items()), *(F.count_if(f"{x}_changed").alias(f"{x}_changed_laps") for x in CHANGES.values()))
        # fifteen rows
        of_base = lambda c: F.max(F.when(F.col("scenario") == "baseline", F.col(c))).over(Window.partitionBy())
        return out.withColumns({"bad_pct": 100.0 * F.col("bad_laps") / F.col("_laps")} | {f"{k}_delta_vs_baseline": F.col(k) - of_base(k) for k in counts}).drop("_laps")
    flips = [F.count_if(f"{x}_changed").alias(f"{x}_flip_count") for x in CHANGES.values()]
    laps = done.where("scenario <> 'baseline'").groupBy(*LAP).agg(*flips, F.first("was").alias("was"))
    laps = laps.withColumn("any_sensitivity_flip_count", sum((F.col(f"{x}_flip_count") for x in CHANGES.values()), F.lit(0)))
    laps = laps.join(event_rounds(sessions), "session_id")
    if kind == "borderline":
        return laps.where("any_sensitivity_flip_count > 0").select("event_round", "event_name", *LAP, *(f"{x}_flip_count" for x in CHANGES.values()), "any_sensitivity_flip_count", *(F.col(f"was.{c}").alias(f"baseline_{c}") for c in CHANGES))
    if kind not in ("by_race", "by_driver"):
        raise ValueError(f"unknown kind {kind}")
    some = lambda c: F.count_if(F.col(c) > 0)
    out = laps.groupBy(*(["session_id", "event_round", "event_name"] if kind == "by_race" else ["driver_code"])).agg(_n().alias("total_laps"), some("any_sensitivity_flip_count").alias("threshold_sensitive_laps"), some("bad_flag_flip_count").alias("bad_flag_sensitive_laps"), some("recommendation_flip_count").alias("recommendation_sensitive_laps"))
    return out.withColumn("threshold_sensitive_pct", 100.0 * F.col("threshold_sensitive_laps") / F.col("total_laps"))


def speed_profile_baselines(df: DataFrame, required_bins: int = 12, accuracy: int | None = None) -> DataFrame:
    """Per session and bin, over clean laps with enough bins: 10th percentile, median and 90th of speed. ``accuracy``: by :func:`.selection.exact_percentiles`, for bins of very many laps."""
    rows = df.where(~F.col("bad_lap_any_category") & (F.col("speed_profile_bins_present") >= required_bins))
    long = rows.select("session_id", F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.col(b).alias("v")) for k, b in enumerate(BINS, 1)))).alias("x")).select("session_id", "x.*").where("v is not null")
    by, shares = ["session_id", "bin"], {"q10": 0.1, "median": 0.5, "q90": 0.9}
    if accuracy is None:
        return long.groupBy(*by).agg(_n().alias("laps"), *(F.percentile("v", p).alias(name) for name, p in shares.items()))
    return long.groupBy(*by).agg(_n().alias("laps")).join(exact_percentiles(long, by, "v", shares, accuracy), by)


def shape_examples(df: DataFrame, sessions: DataFrame, limit: int = 12) -> DataFrame:
    """Laps off their session's speed profile: those for review first, then by how far they exceed the limit; ties by lap."""
    rows = df.where("shape_mismatch_against_comparable_laps and speed_shape_rms_kmh is not null").join(event_rounds(sessions), "session_id")
    rows = rows.orderBy(F.desc("needs_manual_review"), F.desc(F.round("speed_shape_excess_kmh", 9)), F.desc(F.round("speed_shape_rms_kmh", 9)), *LAP).limit(limit)
    return rows.select("event_round", "event_name", *LAP, _display(F.col("primary_category")).alias("primary_category"), "reason_set", "lap_time_ms", "speed_shape_rms_kmh", "speed_shape_excess_kmh", "speed_shape_robust_z", "is_pit_in_lap", "is_pit_out_lap", "safety_car_periods", "virtual_safety_car_periods", "red_flag_periods")


@dataclass(frozen=True)
class SurfaceThresholds:
    """Limits of the session checks (fixed default values)."""

    expected_min_drivers: int = 15
    min_weather_samples: int = 2
    weather_max_gap_ms: int = 180_000
    min_corner_markers: int = 5
    min_raw_driver_streams: int = 10
    max_aligned_non_ok_pct: float = 5.0
    degraded_window_min_non_ok_pct: float = 1.0
    severe_window_min_non_ok_pct: float = 10.0


SURFACE_FLAGS = ["session_metadata_incomplete", "driver_metadata_sparse", "lap_metadata_incomplete", "raw_telemetry_coverage_issue", "raw_position_coverage_issue", "aligned_replay_quality_issue", "ingestion_diagnostic_warning", "weather_surface_issue", "status_timeline_sparse", "race_control_sparse_or_untimed", "circuit_annotation_issue"]


def surface_flags(sessions: DataFrame, surface: DataFrame, drivers: DataFrame, markers: DataFrame, gaps: DataFrame, session_status: DataFrame, diagnostics: DataFrame | None = None, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Session features with null shares, eleven issue flags and their number. gaps: session_id, weather_max_gap_ms."""
    c = F.col
    df = sessions.select("session_id", "session_start_utc", "session_end_utc", "country").join(surface, "session_id")
    df = df.join(drivers.groupBy("session_id").agg(F.count_if(c("driver_number").isNull()).alias("missing_driver_number"), F.count_if(c("team_name").isNull()).alias("missing_team_name")), "session_id", "left")
    df = df.join(markers.groupBy("session_id").agg(F.count_if(c("distance_m").isNull()).alias("marker_distance_nulls")), "session_id", "left").join(gaps, "session_id", "left")
    df = df.join(session_status.groupBy("session_id").agg(_n().alias("session_status_events")), "session_id", "left")
    warned = diagnostics.groupBy("session_id").agg(F.max(F.size("warning_flags") > 0).alias("ingestion_diagnostic_warning")) if diagnostics is not None else sessions.select("session_id", F.lit(False).alias("ingestion_diagnostic_warning"))
    df = df.join(warned, "session_id", "left").fillna(False, ["ingestion_diagnostic_warning"]).fillna(0, ["missing_driver_number", "missing_team_name", "marker_distance_nulls", "session_status_events"])
    share = lambda a, b, k=1: 100.0 * a / (F.nullif(c(b), F.lit(0)) * k)
    df = df.withColumns({"telemetry_null_pct": share(c("speed_kmh_nulls"), "car_samples", 3), "position_xy_null_pct": share(c("x_nulls"), "position_samples"), "aligned_non_ok_pct": share(c("aligned_not_ok"), "aligned_samples"), "race_control_untimed_pct": share(c("messages_without_time"), "messages"), "weather_null_pct": share(c("air_temp_c_nulls") + c("track_temp_c_nulls") + c("rainfall_nulls"), "weather_samples", 5)})
    df = df.withColumns({
        "session_metadata_incomplete": c("session_start_utc").isNull() | c("event_name").isNull() | c("country").isNull(),
        "session_end_missing": c("session_end_utc").isNull(),
        "driver_metadata_sparse": (c("drivers") < t.expected_min_drivers) | (c("missing_driver_number") > 0) | (c("missing_team_name") > 0),
        "lap_metadata_incomplete": (c("laps") == 0) | (c("drivers") < t.expected_min_drivers) | (c("lap_time_ms_nulls") > 0),
        "raw_telemetry_coverage_issue": (c("car_drivers") < t.min_raw_driver_streams) | (c("car_samples") == 0) | (F.coalesce("telemetry_null_pct", F.lit(100.0)) > 0),
        "raw_position_coverage_issue": (c("position_drivers") < t.min_raw_driver_streams) | (c("position_samples") == 0) | (F.coalesce("position_xy_null_pct", F.lit(100.0)) > 0),
        "aligned_replay_quality_issue": (c("aligned_samples") == 0) | (F.coalesce("aligned_non_ok_pct", F.lit(100.0)) > t.max_aligned_non_ok_pct),
        "weather_surface_issue": (c("weather_samples") < t.min_weather_samples) | (F.coalesce("weather_null_pct", F.lit(100.0)) > 0) | (F.coalesce("weather_max_gap_ms", F.lit(0)) > t.weather_max_gap_ms),
        "status_timeline_sparse": (c("status_events") == 0) | (c("session_status_events") == 0),
        "race_control_sparse_or_untimed": (c("messages") == 0) | (F.coalesce("race_control_untimed_pct", F.lit(0.0)) > 10),
        "circuit_annotation_issue": (c("circuit_metadata_rows") == 0) | (c("corners") < t.min_corner_markers) | (c("marker_distance_nulls") > 0),
    })
    df = df.withColumn("surface_issue_count", sum((c(x).cast("int") for x in SURFACE_FLAGS), F.lit(0)))
    return df.withColumn("has_surface_issue", c("surface_issue_count") > 0)


def surface_flag_summary(df: DataFrame) -> DataFrame:
    return _flag_counts(df, SURFACE_FLAGS, "surface_flag").withColumnRenamed("laps", "sessions")


def surface_summary_by_year(df: DataFrame) -> DataFrame:
    out = df.groupBy("year").agg(_n().alias("sessions"), F.count_if("has_surface_issue").alias("sessions_with_issue"), F.median("surface_issue_count").alias("median_surface_issue_count"), *(F.sum(c).alias(c) for c in ("car_samples", "position_samples", "aligned_samples", "weather_samples", "messages")))
    return out.withColumn("issue_pct", 100.0 * F.col("sessions_with_issue") / F.col("sessions"))


INCIDENT_KINDS = ["flags", "safety_car", "vsc", "red_flag", "investigations_noted", "penalties"]


def with_taxonomy(messages: DataFrame) -> DataFrame:
    return messages.withColumn("taxonomy", message_taxonomy(*map(F.col, ("category", "flag", "scope", "status", "message"))))


def quality_windows(aligned: DataFrame, laps: DataFrame, messages: DataFrame, events: DataFrame, width: int = 30_000) -> DataFrame:
    """Tumbling windows of a driver's aligned samples: rows not OK by family, pit laps, and the session's messages and status in the window."""
    keys = ["session_id", "driver_code", "window_start_ms"]
    bucket = (F.floor(F.col("session_time_ms") / width) * width).cast("long")
    pits = laps.select(*LAP, (F.col("is_pit_in_lap") | F.col("is_pit_out_lap")).alias("_pit"))
    rows = aligned.where("session_time_ms is not null").join(pits, LAP, "left").withColumns({"window_start_ms": bucket, "family": quality_family(F.col("quality_flags"))})
    names = [v for _, v in FAMILIES if v != "OK"] + ["other_unknown"]
    out = rows.groupBy(*keys).agg(_n().alias("samples"), F.count_if(F.col("family") != "OK").alias("not_ok"), *(F.count_if(F.col("family") == n).alias(n) for n in names), F.count_if("_pit").alias("pit_lap_rows"))
    most = F.greatest(*names)
    out = out.withColumns({"window_end_ms": F.col("window_start_ms") + width, "dominant_family": F.when(most == 0, "OK").otherwise(F.coalesce(*(F.when(F.col(n) == most, n) for n in names))), "non_ok_pct": 100.0 * F.col("not_ok") / F.col("samples")})
    own = ["session_id", "window_start_ms"]
    said = with_taxonomy(messages).where("session_time_ms is not null").groupBy("session_id", bucket.alias("window_start_ms")).agg(_n().alias("messages"), F.count_if(F.col("taxonomy").isin(INCIDENT_KINDS)).alias("incident_messages"))
    spans = out.select(*own, "window_end_ms").distinct()
    met = overlap_counts(spans, own, "window_start_ms", "window_end_ms", track_status_periods(events), {"_status": F.col("status_code") != "1"}, closed=False, width=width * 20)
    met = met.select(*own, (F.col("_status") > 0).alias("has_status_context"))
    out = out.join(said, own, "left").join(met, own, "left").fillna(0, ["messages", "incident_messages"]).fillna(False, ["has_status_context"])
    return out.withColumns({"has_race_control_context": F.col("messages") > 0, "has_pit_context": F.col("pit_lap_rows") > 0, "has_incident_context": F.col("has_status_context") | (F.col("incident_messages") > 0)})


def _bucketed(df: DataFrame, buckets: dict[str, Column], name: str, *aggs: Column) -> DataFrame:
    """Aggregates of the rows that meet each bucket's condition; a row counts in all that it meets."""
    labels = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in buckets.items())), lambda x: x.isNotNull())
    return df.select(F.explode(labels).alias(name), *df.columns).groupBy(name).agg(*aggs)


def context_overlap(windows: DataFrame, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Shares of context among all, degraded and severe windows, and their quality."""
    pct = lambda c: (100.0 * F.count_if(c) / _n()).alias(f"pct_{c}")
    return _bucketed(windows, {"all_windows": F.lit(True), "degraded_windows": F.col("non_ok_pct") >= t.degraded_window_min_non_ok_pct, "severe_windows": F.col("non_ok_pct") >= t.severe_window_min_non_ok_pct}, "window_bucket", _n().alias("windows"), *map(pct, ("has_race_control_context", "has_status_context", "has_pit_context", "has_incident_context")), F.median("non_ok_pct").alias("median_non_ok_pct"), F.percentile("non_ok_pct", 0.95).alias("p95_non_ok_pct"))


def lap_context(aligned_laps: DataFrame, laps: DataFrame, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Aligned quality (rows of grain lap) of all, pit, inaccurate, untimed and ordinary laps."""
    df = aligned_laps.join(laps.select(*LAP, (F.col("is_pit_in_lap") | F.col("is_pit_out_lap")).alias("pit"), (~F.coalesce("is_accurate", F.lit(True))).alias("inaccurate"), F.col("lap_time_ms").isNull().alias("untimed")), LAP, "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    buckets = {"all_laps": F.lit(True), "pit_laps": no("pit"), "inaccurate_laps": no("inaccurate"), "missing_lap_time_laps": no("untimed"), "ordinary_laps": ~(no("pit") | no("inaccurate") | no("untimed"))}
    return _bucketed(df, buckets, "lap_bucket", _n().alias("laps"), F.count_if(F.col("not_ok") > 0).alias("laps_with_any_non_ok"), F.count_if(F.col("not_ok_pct") >= t.severe_window_min_non_ok_pct).alias("laps_with_severe_non_ok"), F.median("not_ok_pct").alias("median_non_ok_pct"), F.percentile("not_ok_pct", 0.95).alias("p95_non_ok_pct"), F.sum("not_ok").alias("non_ok_rows"))


def replay_watchlist(aligned_drivers: DataFrame, segments: DataFrame, windows: DataFrame, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Drivers by replay risk, with guidance by the first rule that holds."""
    keys = ["session_id", "driver_code"]
    long = segments.groupBy(*keys).agg(F.max("duration_ms").alias("longest_segment_ms"), F.count_if(F.col("duration_ms") >= 2000).alias("segments_over_2s"))
    seen = windows.groupBy(*keys).agg(F.count_if(F.col("non_ok_pct") >= t.degraded_window_min_non_ok_pct).alias("degraded_windows"), F.count_if(F.col("non_ok_pct") >= t.severe_window_min_non_ok_pct).alias("severe_windows"), F.count_if("has_incident_context").alias("windows_with_incident_context"), F.max("non_ok_pct").alias("max_window_non_ok_pct"))
    df = aligned_drivers.select(*keys, "samples", "not_ok", "not_ok_pct").join(long, keys, "left").join(seen, keys, "left").fillna(0)
    risk = F.col("not_ok_pct") * 4 + F.col("max_window_non_ok_pct") * 0.8 + F.col("segments_over_2s") * 2 + F.col("severe_windows") * 0.5
    guide = F.when(F.col("longest_segment_ms") >= 5000, "warn_before_replay").when((F.col("severe_windows") >= 3) | (F.col("not_ok_pct") >= t.max_aligned_non_ok_pct), "show_replay_quality_overlay").when(F.col("degraded_windows") > 0, "diagnostics_only").otherwise("no_action")
    return df.withColumns({"replay_risk_score": risk, "guidance": guide})


SURFACES = ["telemetry", "position", "aligned", "weather", "track_status", "session_status", "race_control"]


def session_duration_coverage(sessions: DataFrame, times: dict[str, DataFrame]) -> DataFrame:
    """Per session: each surface's start and end (times: surface -> session_id, t), the derived duration and its source, and each surface's overlap with the active range."""
    df = sessions.select("session_id", "year", "event_name")
    for s in SURFACES:
        df = df.join(times[s].groupBy("session_id").agg(F.min("t").alias(f"{s}_start_ms"), F.max("t").alias(f"{s}_end_ms")), "session_id", "left")
    ends = [f"{s}_end_ms" for s in SURFACES]
    longest = F.greatest(*ends)
    start = F.coalesce("aligned_start_ms", F.least("telemetry_start_ms", "position_start_ms"))
    end = F.coalesce("aligned_end_ms", F.greatest("telemetry_end_ms", "position_end_ms"))
    df = df.withColumns({"derived_session_duration_ms": longest, "duration_source": F.coalesce(*(F.when(F.col(f"{s}_end_ms") == longest, s) for s in SURFACES)), "active_replay_start_ms": start, "active_replay_end_ms": end})
    df = df.withColumn("active_replay_duration_ms", F.col("active_replay_end_ms") - F.col("active_replay_start_ms"))
    more = {}
    for s in SURFACES:
        a, b = F.col(f"{s}_start_ms"), F.col(f"{s}_end_ms")
        span = F.when(a.isNotNull(), F.greatest(b - a, F.lit(0)))
        inside = F.when(a.isNotNull(), F.greatest(F.least(b, F.col("active_replay_end_ms")) - F.greatest(a, F.col("active_replay_start_ms")), F.lit(0)))
        more |= {f"{s}_span_ms": span, f"{s}_coverage_ratio": span / F.nullif("derived_session_duration_ms", F.lit(0)), f"{s}_active_coverage_ratio": inside / F.nullif("active_replay_duration_ms", F.lit(0)), f"{s}_starts_after_active_ms": a - F.col("active_replay_start_ms"), f"{s}_ends_before_active_end_ms": F.col("active_replay_end_ms") - b}
    return df.withColumns(more)


def coverage_windows(coverage: DataFrame) -> DataFrame:
    """The same, one row a session and surface."""
    parts = ["start_ms", "end_ms", "span_ms", "coverage_ratio", "active_coverage_ratio", "starts_after_active_ms", "ends_before_active_end_ms"]
    rows = F.array(*(F.struct(F.lit(s).alias("surface"), *(F.col(f"{s}_{p}").alias(p) for p in parts)) for s in SURFACES))
    return coverage.select("session_id", "event_name", F.explode(rows).alias("x")).select("session_id", "event_name", "x.*")


def coverage_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("surface").agg(F.count_distinct("session_id").alias("sessions"), F.median("coverage_ratio").alias("median_coverage_ratio"), F.median("active_coverage_ratio").alias("median_active_coverage_ratio"), F.min("active_coverage_ratio").alias("min_active_coverage_ratio"), F.count_if(F.col("starts_after_active_ms") > 60_000).alias("sessions_starting_after_active"), F.count_if(F.col("ends_before_active_end_ms") > 60_000).alias("sessions_ending_before_active_end"))


def message_taxonomy_summary(messages: DataFrame) -> DataFrame:
    out = with_taxonomy(messages).groupBy("taxonomy").agg(_n().alias("messages"), F.count_if(F.col("session_time_ms").isNull()).alias("missing_session_time"), F.count_if(F.col("lap_number").isNull()).alias("missing_lap_scope"), F.count_if(F.col("racing_number").isNull()).alias("missing_driver_scope"), F.count_distinct("session_id").alias("sessions"))
    return out.withColumns({f"{c}_pct": 100.0 * F.col(c) / F.col("messages") for c in ("missing_session_time", "missing_lap_scope", "missing_driver_scope")})


def duplicate_messages(messages: DataFrame) -> DataFrame:
    """Messages of a session that are alike but for numbers, with their span and labels."""
    rows = with_taxonomy(messages).withColumn("normalized_message", normalize_message_text(F.col("message")))
    out = rows.groupBy("session_id", "normalized_message").agg(_n().alias("messages"), F.min("session_time_ms").alias("first_session_time_ms"), F.max("session_time_ms").alias("last_session_time_ms"), F.array_join(F.array_sort(F.collect_set("taxonomy")), ",").alias("taxonomy"))
    return out.where("messages > 1").withColumn("span_ms", F.col("last_session_time_ms") - F.col("first_session_time_ms"))


def status_message_overlap(intervals: DataFrame, messages: DataFrame) -> DataFrame:
    """Status intervals with the messages in [start, end), how many tell of incidents, and their labels. Intervals of a session do not overlap."""
    rows = with_taxonomy(messages).where("session_time_ms is not null")
    spans = intervals.where("end_time_ms > start_time_ms")
    points = rows.select("session_id", F.col("session_time_ms").alias("_t"), F.lit(1).alias("_o"), "taxonomy").unionByName(spans.select("session_id", F.col("start_time_ms").alias("_t"), F.lit(0).alias("_o"), F.struct("start_time_ms", "end_time_ms", "status_code").alias("_i")), allowMissingColumns=True)
    last = Window.partitionBy("session_id").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    met = points.withColumn("_f", F.last("_i", ignorenulls=True).over(last)).where("_o = 1 and _t < _f.end_time_ms")
    by = met.groupBy("session_id", F.col("_f.start_time_ms").alias("start_time_ms"), F.col("_f.status_code").alias("status_code")).agg(_n().alias("messages"), F.count_if(F.col("taxonomy").isin(INCIDENT_KINDS)).alias("incident_messages"), F.array_join(F.array_sort(F.collect_set("taxonomy")), ",").alias("taxonomies"))
    return intervals.join(by, ["session_id", "start_time_ms", "status_code"], "left").fillna(0, ["messages", "incident_messages"]).fillna("", ["taxonomies"])


def context_timeline(windows: DataFrame, messages: DataFrame, transitions: DataFrame, intervals: DataFrame, width: int = 300_000, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Bins of a session: replay windows, messages, changes of rain, and bins that a non-clear status touches."""
    bucket = lambda c: (F.floor(F.col(c) / width) * width).cast("long").alias("bin_start_ms")
    keys = ["session_id", "bin_start_ms"]
    own = windows.groupBy("session_id", bucket("window_start_ms")).agg(_n().alias("driver_windows"), F.count_if(F.col("non_ok_pct") >= t.degraded_window_min_non_ok_pct).alias("degraded_driver_windows"), F.count_if(F.col("non_ok_pct") >= t.severe_window_min_non_ok_pct).alias("severe_driver_windows"), F.max("non_ok_pct").alias("max_non_ok_pct"))
    said = with_taxonomy(messages).where("session_time_ms is not null").groupBy("session_id", bucket("session_time_ms")).agg(_n().alias("messages"), F.count_if(F.col("taxonomy").isin(INCIDENT_KINDS)).alias("incident_messages"))
    rain = transitions.groupBy("session_id", bucket("session_time_ms")).agg(_n().alias("rainfall_transitions"))
    touched = intervals.where("status_code <> '1' and end_time_ms >= start_time_ms").select("session_id", F.explode(F.sequence((F.floor(F.col("start_time_ms") / width) * width).cast("long"), F.col("end_time_ms"), F.lit(width).cast("long"))).alias("bin_start_ms")).distinct().withColumn("has_status_context", F.lit(True))
    out = own.join(said, keys, "left").join(rain, keys, "left").join(touched, keys, "left").fillna(0, ["messages", "incident_messages", "rainfall_transitions"]).fillna(False, ["has_status_context"])
    return out.withColumns({"degraded_window_rate": F.col("degraded_driver_windows") / F.col("driver_windows"), "has_context_event": F.col("has_status_context") | (F.col("incident_messages") > 0) | (F.col("rainfall_transitions") > 0)})


def context_correlation(bins: DataFrame) -> DataFrame:
    c = F.col
    buckets = {"all_bins": F.lit(True), "context_event_bins": c("has_context_event"), "no_context_event_bins": ~c("has_context_event"), "race_control_incident_bins": c("incident_messages") > 0, "status_bins": c("has_status_context"), "rainfall_transition_bins": c("rainfall_transitions") > 0}
    return _bucketed(bins, buckets, "bin_bucket", _n().alias("bins"), F.median("degraded_window_rate").alias("median_degraded_window_rate"), F.percentile("degraded_window_rate", 0.95).alias("p95_degraded_window_rate"), F.median("max_non_ok_pct").alias("median_max_non_ok_pct"), F.percentile("max_non_ok_pct", 0.95).alias("p95_max_non_ok_pct"), F.sum("severe_driver_windows").alias("severe_driver_windows"))


def marker_quality(markers: DataFrame, positions: DataFrame) -> DataFrame:
    """Markers against their session's positions: outside all of them, outside their core, without a distance, or none."""
    b = marker_bounds(positions.where("x is not null and y is not null")).withColumnRenamed("markers", "position_xy_samples")
    df = markers.join(b, "session_id", "left")
    out, core = [], []
    for k in "xy":
        c, lo, hi, p1, p9 = (F.col(n) for n in (k, f"min_{k}", f"max_{k}", f"p01_{k}", f"p99_{k}"))
        pad, inner = F.greatest((hi - lo) * 0.08, F.lit(500.0)), F.greatest((p9 - p1) * 0.05, F.lit(250.0))
        out += [c < lo - pad, c > hi + pad]
        core += [c < p1 - inner, c > p9 + inner]
    any_of = lambda cs: reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in cs))
    df = df.withColumns({"outside_minmax_bounds": any_of(out), "outside_core_bounds": any_of(core)})
    return df.withColumn("marker_issue", F.when(F.col("outside_minmax_bounds"), "outside_position_bounds").when(F.col("outside_core_bounds"), "outside_core_trace_bounds").when(F.col("distance_m").isNull(), "missing_distance").otherwise("none"))


def marker_summary(sessions: DataFrame, quality: DataFrame, circuits: DataFrame, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Per session: markers by kind and issue, readiness and recommendation by the first rule that holds."""
    c = F.col
    by = quality.groupBy("session_id").agg(_n().alias("marker_count"), F.count_if(c("marker_type") == "corner").alias("corner_markers"), F.count_if(c("distance_m").isNull()).alias("marker_distance_nulls"), F.count_if("outside_minmax_bounds").alias("markers_outside_position_bounds"), F.count_if("outside_core_bounds").alias("markers_outside_core_bounds"), F.max("position_xy_samples").alias("position_xy_samples"))
    meta = circuits.where("rotation_degrees is not null").select("session_id").distinct().withColumn("rotation_present", F.lit(True))
    df = sessions.select("session_id", "event_name").join(by, "session_id", "left").join(meta, "session_id", "left").fillna(0).fillna(False, ["rotation_present"])
    missing = ~c("rotation_present") | (c("position_xy_samples") == 0) | (c("marker_count") == 0)
    outside, few, core = c("markers_outside_position_bounds") > 0, c("corner_markers") < t.min_corner_markers, c("markers_outside_core_bounds") > 0
    label = F.when(missing, "needs_reimport").when(outside, "needs_manual_review").when(few, "partial").when(core | (c("marker_distance_nulls") > 0), "ready_with_warnings").otherwise("ready")
    advice = F.when(missing, "reimport").when(outside, "inspect").when(few, "label_in_ui").when(core, "inspect").when(c("marker_distance_nulls") > 0, "label_in_ui").otherwise("no_action")
    return df.withColumns({"circuit_context_readiness": label, "circuit_context_recommendation": advice})


def marker_example_sessions(summary: DataFrame, n: int = 6) -> DataFrame:
    priority = F.col("markers_outside_position_bounds") * 100 + F.col("markers_outside_core_bounds") * 10 + (F.col("circuit_context_readiness") != "ready").cast("int") + F.least("marker_count", F.lit(50)) / 100
    return summary.withColumn("priority", priority).orderBy(F.desc("priority"), "event_name").limit(n).select("session_id", "priority")


READINESS = {"ready": 0, "ready_with_warnings": 1, "partial": 2, "needs_manual_review": 3, "needs_reimport": 4}
RECOMMENDATIONS = ["no_action", "label_in_ui", "inspect", "reimport", "schema_importer_change"]


def product_readiness(flags: DataFrame, watchlist: DataFrame, windows: DataFrame, coverage: DataFrame, markers: DataFrame, t: SurfaceThresholds = SurfaceThresholds()) -> DataFrame:
    """Per session: five readiness labels, the worst score, a recommendation, affected drivers, windows and time."""
    c = F.col
    drivers = watchlist.groupBy("session_id").agg(F.count_distinct("driver_code").alias("affected_drivers"), F.sum("severe_windows").alias("severe_windows"), F.sum("degraded_windows").alias("degraded_windows"), F.max("longest_segment_ms").alias("longest_segment_ms"))
    bad = windows.where(c("non_ok_pct") >= t.degraded_window_min_non_ok_pct).select("session_id", "window_start_ms").distinct().groupBy("session_id").agg(_n().alias("bad_windows"))
    df = flags.join(drivers, "session_id", "left").join(bad, "session_id", "left").join(coverage.select("session_id", "active_replay_duration_ms"), "session_id", "left").join(markers.select("session_id", "circuit_context_readiness", "circuit_context_recommendation"), "session_id", "left")
    df = df.fillna(0, ["affected_drivers", "severe_windows", "degraded_windows", "longest_segment_ms", "bad_windows"]).fillna({"circuit_context_readiness": "needs_reimport", "circuit_context_recommendation": "reimport"})
    df = df.withColumns({
        "catalog_readiness": F.when(c("session_metadata_incomplete") | c("driver_metadata_sparse"), "partial").when(c("session_end_missing"), "ready_with_warnings").otherwise("ready"),
        "raw_stream_readiness": F.when((c("car_samples") == 0) | (c("position_samples") == 0), "needs_reimport").when(c("raw_telemetry_coverage_issue") | c("raw_position_coverage_issue"), "partial").when(c("ingestion_diagnostic_warning"), "ready_with_warnings").otherwise("ready"),
        "replay_readiness": F.when(c("aligned_samples") == 0, "needs_reimport").when(c("aligned_replay_quality_issue") | (c("severe_windows") >= 8) | (c("longest_segment_ms") >= 10_000), "partial").when((c("aligned_non_ok_pct") > 0) | (c("degraded_windows") > 0), "ready_with_warnings").otherwise("ready"),
        "context_readiness": F.when(c("weather_surface_issue") | c("status_timeline_sparse"), "partial").when(c("race_control_sparse_or_untimed"), "ready_with_warnings").otherwise("ready"),
    })
    names = ["catalog_readiness", "raw_stream_readiness", "replay_readiness", "context_readiness", "circuit_context_readiness"]
    has = lambda x: reduce(Column.__or__, (c(n) == x for n in names))
    score = F.greatest(*(first_match([(c(n) == k, v) for k, v in READINESS.items()], 0) for n in names))
    advice = F.when(has("needs_reimport"), "reimport").when((c("circuit_context_recommendation") == "inspect") | has("needs_manual_review"), "inspect").when(has("ready_with_warnings") | has("partial"), "label_in_ui").when(c("session_end_missing"), "schema_importer_change").otherwise("no_action")
    time = F.round(F.least(F.lit(100.0), c("bad_windows") * 30_000 / F.greatest(F.coalesce("active_replay_duration_ms", F.lit(1)), F.lit(1)) * 100), 3)
    return df.select("session_id", "event_name", *names, score.alias("overall_readiness_score"), advice.alias("final_recommendation"), "affected_drivers", "degraded_windows", "severe_windows", time.alias("affected_session_time_pct"), "longest_segment_ms")


def readiness_summary(readiness: DataFrame) -> DataFrame:
    """Sessions of each recommendation; all five are kept."""
    every = readiness.sparkSession.createDataFrame([(r,) for r in RECOMMENDATIONS], "final_recommendation string")
    return every.join(readiness.groupBy("final_recommendation").agg(_n().alias("sessions")), "final_recommendation", "left").fillna(0, ["sessions"])


def assert_scope(sessions: DataFrame, expected: int) -> DataFrame:
    """One row: sessions expected and found, and whether they agree."""
    return sessions.agg(_n().alias("found")).select(F.lit(expected).cast("long").alias("expected"), "found", (F.col("found") == expected).alias("matches"))
