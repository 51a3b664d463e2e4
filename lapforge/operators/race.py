"""Race analysis: lap comparisons, pit stops, strategy, standings, incidents and narrative facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import format_duration_ms, insight, insights, status_sentence
from .aggregates import check_range, lap_summaries, stint_summaries, weather_summary
from .joins import asof_status, track_status_periods
from .lookups import top_n
from .sequences import _ranked

LAP = ["session_id", "driver_code", "lap_number"]
CHANNELS = ["speed_kmh", "throttle_pct", "brake_pct", "rpm"]


def _side(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """Rows of one side's laps, once for each pair."""
    keys = pairs.select("session_id", "driver_a", "lap_a", "driver_b", "lap_b", F.col(f"driver_{side}").alias("driver_code"), F.col(f"lap_{side}").alias("lap_number"))
    return keys.join(rows, LAP).drop("driver_code", "lap_number")


PAIR = ["session_id", "driver_a", "lap_a", "driver_b", "lap_b"]


def compare_laps(pairs: DataFrame, samples: DataFrame, step_ms: int = 100) -> DataFrame:
    """Per pair and time bucket: mean channels and rounded mean gear of both laps, and A - B. Buckets of either lap count."""
    check_range("step_ms", step_ms, 20, 5_000_000)
    bucket = (F.floor(F.col("lap_time_ms") / step_ms) * step_ms).cast("long").alias("bucket_ms")
    binned = samples.where("lap_time_ms is not null").groupBy(*LAP, bucket).agg(*(F.avg(c).alias(c) for c in CHANNELS), F.round(F.avg("gear")).cast("int").alias("gear"))
    a = _side(pairs, binned, "a").withColumnsRenamed({c: f"a_{c}" for c in [*CHANNELS, "gear"]})
    b = _side(pairs, binned, "b").withColumnsRenamed({c: f"b_{c}" for c in [*CHANNELS, "gear"]})
    out = a.join(b, [*PAIR, "bucket_ms"], "full_outer")
    return out.withColumns({f"d_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in ("speed_kmh", "throttle_pct", "brake_pct")})


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with ``columns`` of both laps, prefixed a_ and b_; null where a lap is missing."""
    out = pairs
    for k in "ab":
        own = rows.select("session_id", F.col("driver_code").alias(f"driver_{k}"), F.col("lap_number").alias(f"lap_{k}"), *(F.col(c).alias(f"{k}_{c}") for c in columns))
        out = out.join(own, ["session_id", f"driver_{k}", f"lap_{k}"], "left")
    return out


SUMMARY = ["lap_time_ms", "sector_1_ms", "sector_2_ms", "sector_3_ms", "max_speed_kmh", "avg_speed_kmh"]


def compare_laps_summary(pairs: DataFrame, laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Per pair: A - B of lap and sector times, peak and mean speed."""
    out = _both(pairs, lap_summaries(laps, samples), SUMMARY)
    return out.select(*PAIR, *((F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in SUMMARY))


def compare_laps_segments(pairs: DataFrame, samples: DataFrame, segments: int = 3) -> DataFrame:
    """Per pair and equal part of [0, longest lap time of both]: mean deltas, and who has the speed (over 2 km/h). The last part is closed."""
    check_range("segments", segments, 2, 12)
    rows = samples.where("lap_time_ms is not null").select(*LAP, "lap_time_ms", "speed_kmh", "throttle_pct", "brake_pct")
    both = _side(pairs, rows, "a").withColumn("side", F.lit("a")).unionByName(_side(pairs, rows, "b").withColumn("side", F.lit("b")))
    span = F.max("lap_time_ms").over(Window.partitionBy(*PAIR))
    at = F.least(F.floor(F.col("lap_time_ms") * segments / F.greatest(span, F.lit(1))), F.lit(segments - 1)).cast("int")
    mean = lambda c, k: F.avg(F.when(F.col("side") == k, F.col(c)))
    out = both.withColumn("segment", at + 1).groupBy(*PAIR, "segment").agg(*((mean(c, "a") - mean(c, "b")).alias(f"delta_{c}") for c in ("speed_kmh", "throttle_pct", "brake_pct")))
    d = F.col("delta_speed_kmh")
    return out.withColumn("advantage", F.when(d > 2, F.col("driver_a")).when(d < -2, F.col("driver_b")).otherwise("even"))


def _mm(column: str):
    return F.round(F.col(column) * 1000).cast("long")


def compare_laps_by_distance(pairs: DataFrame, distance: DataFrame, start_m: float | None = None, end_m: float | None = None) -> DataFrame:
    """Per pair and shared distance (to the millimetre): mean progress, and deltas of elapsed time and channels; positive: A is slower."""
    rows = distance
    if start_m is not None:
        rows = rows.where(F.col("distance_m") >= start_m)
    if end_m is not None:
        rows = rows.where(F.col("distance_m") <= end_m)
    rows = rows.withColumn("mm", _mm("distance_m")).drop("distance_m")
    columns = ["lap_progress", "elapsed_ms", "speed_kmh", "throttle_pct", "brake_pct"]
    a = _side(pairs, rows, "a").withColumnsRenamed({c: f"a_{c}" for c in columns})
    b = _side(pairs, rows, "b").withColumnsRenamed({c: f"b_{c}" for c in columns})
    out = a.join(b, [*PAIR, "mm"])
    return out.select(*PAIR, (F.col("mm") / 1000).alias("distance_m"), ((F.col("a_lap_progress") + F.col("b_lap_progress")) / 2).alias("lap_progress"), *((F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in columns[1:]))


def compare_by_distance_summary(pairs: DataFrame, laps: DataFrame, distance: DataFrame, quality: DataFrame) -> DataFrame:
    """Per pair: official lap time delta, delta at the last distance of each, their difference, and both laps' quality."""
    finish = distance.groupBy(*LAP).agg(F.max_by("elapsed_ms", "distance_m").alias("finish_ms"))
    rows = laps.select(*LAP, "lap_time_ms").join(finish, LAP, "left").join(quality.select(*LAP, "quality_status"), LAP, "left")
    out = _both(pairs, rows, ["lap_time_ms", "finish_ms", "quality_status"])
    official, projected = F.col("a_lap_time_ms") - F.col("b_lap_time_ms"), F.col("a_finish_ms") - F.col("b_finish_ms")
    return out.select(*PAIR, official.alias("official_delta_ms"), projected.alias("finish_delta_ms"), F.abs(official - projected).alias("difference_ms"), F.col("a_quality_status").alias("quality_a"), F.col("b_quality_status").alias("quality_b"))


def lap_story(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Kept laps' summaries with insights on lap time, peak speed, fastest sector, tyre, pace and samples."""
    rows = lap_summaries(laps.where("not is_deleted"), samples)
    sectors = F.array_min(F.filter(F.array(*(F.struct(F.col(f"sector_{k}_ms").alias("v"), F.lit(k).alias("k")) for k in (1, 2, 3))), lambda s: s["v"].isNotNull()))
    rows = rows.withColumn("_s", sectors)
    tyre = F.coalesce(F.nullif(F.trim("compound"), F.lit("")), F.lit("unknown compound"))
    lists = insights(
        (F.col("lap_time_ms").isNotNull(), insight("lap_time", F.concat(F.lit("Lap time was "), format_duration_ms(F.col("lap_time_ms")), F.lit(".")), F.col("lap_time_ms"), "ms")),
        (F.col("max_speed_kmh").isNotNull(), insight("peak_speed", F.concat(F.lit("Peak sampled speed was "), F.bround("max_speed_kmh", 0).cast("long").cast("string"), F.lit(" km/h.")), F.col("max_speed_kmh"), "km/h")),
        (F.col("_s").isNotNull(), insight("fastest_sector", F.concat(F.lit("Fastest sector was S"), F.col("_s.k").cast("string"), F.lit(" at "), format_duration_ms(F.col("_s.v")), F.lit(".")), F.col("_s.v"), "ms")),
        (F.col("compound").isNotNull() | F.col("tyre_life").isNotNull(), insight("tyre", F.concat(F.lit("Tyre context: "), tyre, F.lit(", tyre life "), F.coalesce(F.col("tyre_life").cast("string"), F.lit("unknown")), F.lit(".")), F.col("tyre_life"), "laps")),
        (F.lit(True), insight("data_quality", F.concat(F.lit("Telemetry sample count for this lap is "), F.col("telemetry_samples").cast("string"), F.lit(".")), F.col("telemetry_samples"), "samples")),
    )
    return rows.withColumn("insights", lists).drop("_s")


def compare_laps_story(pairs: DataFrame, laps: DataFrame, samples: DataFrame, segments: int = 3) -> DataFrame:
    """Per pair: the summary's deltas, the segments, and insights on lap time and segments won."""
    parts = compare_laps_segments(pairs, samples, segments).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("segment", "advantage"))).alias("segments"))
    out = compare_laps_summary(pairs, laps, samples).join(parts, PAIR, "left")
    d = F.col("delta_lap_time_ms")
    faster = F.when(d < 0, F.col("driver_a")).otherwise(F.col("driver_b"))
    won = F.size(F.filter("segments", lambda s: s["advantage"] == F.col("driver_a")))
    lists = insights(
        (d.isNotNull() & (d != 0), insight("lap_delta", F.concat(faster, F.lit(" was faster by "), format_duration_ms(F.abs(d)), F.lit(".")), d, "ms")),
        (F.col("segments").isNotNull(), insight("segments", F.concat(F.col("driver_a"), F.lit(" was faster in "), won.cast("string"), F.lit(" segments.")), won, "segments")),
    )
    return out.withColumn("insights", lists)


def pit_laps(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Kept pit laps with their kind and the session time of their first sample."""
    rows = laps.where("not is_deleted and (is_pit_in_lap or is_pit_out_lap)")
    kind = F.when(F.col("is_pit_in_lap") & F.col("is_pit_out_lap"), "pit_in_out").when(F.col("is_pit_in_lap"), "pit_in").otherwise("pit_out")
    first = samples.groupBy(*LAP).agg(F.min("session_time_ms").alias("session_time_ms"))
    return rows.select(*LAP, kind.alias("kind"), "stint_number", "compound", "tyre_life", "lap_time_ms").join(first, LAP, "left")


def analyze_pit_stops(laps: DataFrame, samples: DataFrame, window: int = 3, limit: int = 200) -> DataFrame:
    """Pit laps with the rounded mean of clean laps at most ``window`` laps away, and the loss against it; ``limit`` of a session by time."""
    check_range("window", window, 1, 10)
    check_range("limit", limit, 1, 5000)
    # a pit lap is never clean, so it leaves itself out
    clean = F.when(F.expr("lap_time_ms is not null and not is_deleted and not is_pit_in_lap and not is_pit_out_lap"), F.col("lap_time_ms"))
    around = Window.partitionBy("session_id", "driver_code").orderBy("lap_number").rangeBetween(-window, window)
    base = laps.withColumn("nearby_baseline_lap_time_ms", F.round(F.avg(clean).over(around)).cast("long")).select(*LAP, "nearby_baseline_lap_time_ms")
    out = pit_laps(laps, samples).join(base, LAP, "left").withColumn("estimated_loss_ms", F.col("lap_time_ms") - F.col("nearby_baseline_lap_time_ms"))
    return top_n(out, ["session_id"], ["session_time_ms", "driver_code", "lap_number"], limit)


def strategy_stops(laps: DataFrame, events: DataFrame) -> DataFrame:
    """Pit-in laps with the pit-out time of laps n..n+2 (deleted or not), the compound of the next stint's first kept lap, lane time and track status."""
    by = Window.partitionBy("session_id", "driver_code").orderBy("lap_number")
    out_time = F.first("pit_out_session_time_ms", ignorenulls=True).over(by.rangeBetween(0, 2))
    # the next kept lap of another stint: first of the stint after, as a stint's laps follow one another
    kept = laps.where("not is_deleted")
    ahead = kept.select("session_id", "driver_code", F.col("lap_number").alias("n"), F.col("stint_number").alias("s"), F.col("compound").alias("c")).groupBy("session_id", "driver_code", "s").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("l"))
    rows = laps.withColumn("pit_out_ms", out_time).where("pit_in_session_time_ms is not null and not is_deleted")
    later = rows.select(*LAP, "stint_number").join(ahead, ["session_id", "driver_code"]).where("stint_number is null or s is null or s <> stint_number")
    first = F.array_min(F.filter("l", lambda x: x["n"] > F.col("lap_number")))
    nxt = later.select(*LAP, first.alias("f")).where("f is not null").groupBy(*LAP).agg(F.min("f").alias("f"))
    rows = rows.join(nxt, LAP, "left")
    rows = asof_status(rows.withColumn("session_time_ms", F.col("pit_in_session_time_ms")), events)
    lane = F.when(F.col("pit_out_ms") >= F.col("pit_in_session_time_ms"), F.col("pit_out_ms") - F.col("pit_in_session_time_ms"))
    return rows.select(*LAP, "stint_number", F.col("compound").alias("from_compound"), F.col("f.c").alias("to_compound"), "pit_in_session_time_ms", F.col("pit_out_ms").alias("pit_out_session_time_ms"), lane.alias("pit_lane_time_ms"), "track_status", "is_accurate")


def strategy_summary(laps: DataFrame, events: DataFrame) -> DataFrame:
    """Stops with positions before and after, the rival, a label, and whether the data support it.

    The rival is another driver's stop within 3 laps: nearest in position on the lap before, then in
    laps, then by code. Positions after are two laps past the later stop, at most the last lap.
    """
    stops = strategy_stops(laps, events)
    # one row a session: a position for each driver's lap, by "driver|lap"
    place = lambda driver, lap: F.concat_ws("|", F.col(driver), F.col(lap).cast("string"))
    ranked = _ranked(laps).groupBy("session_id", place("driver_code", "lap_number").alias("k")).agg(F.max("position").alias("position"), F.max("lap_number").alias("n"))
    places = ranked.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "position"))).alias("_m"), F.max("n").alias("_last"))

    def at(df: DataFrame, *names: tuple[str, str, str]) -> DataFrame:
        """``df`` with positions, each as (driver's column, lap's column, name)."""
        found = df.join(places, "session_id", "left")
        return found.withColumns({name: F.try_element_at("_m", place(driver, lap)) for driver, lap, name in names}).drop("_m", "_last")

    rows = at(stops.withColumn("before_lap", F.greatest(F.lit(1), F.col("lap_number") - 1)), ("driver_code", "before_lap", "before_position"))
    other = stops.select("session_id", F.col("driver_code").alias("rival"), F.col("lap_number").alias("rival_lap"))
    near = rows.select(*LAP, "before_lap", "before_position").withColumn("rival_lap", F.explode(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda k: (F.col("lap_number") + k).cast("int"))))
    met = at(near.join(other, ["session_id", "rival_lap"]).where("rival <> driver_code"), ("rival", "before_lap", "rival_before")).where("rival_before is not null")
    key = F.struct(F.coalesce(F.abs(F.col("rival_before") - F.col("before_position")), F.lit(2**31 - 1)).alias("p"), F.abs(F.col("rival_lap") - F.col("lap_number")).alias("l"), "rival", "rival_lap", "rival_before")
    best = met.groupBy(*LAP).agg(F.min(key).alias("r")).select(*LAP, "r.rival", "r.rival_lap", "r.rival_before")
    rows = rows.join(best, LAP, "left").join(places.select("session_id", F.col("_last").alias("last_lap")), "session_id", "left")
    rows = rows.withColumn("after_lap", F.least("last_lap", F.greatest("lap_number", F.coalesce("rival_lap", "lap_number")) + 2))
    rows = at(rows, ("driver_code", "after_lap", "after_position"), ("rival", "after_lap", "rival_after"))
    complete = F.coalesce(F.expr("pit_out_session_time_ms is not null and pit_lane_time_ms > 0 and coalesce(is_accurate, true) and before_position is not null and after_position is not null"), F.lit(False))
    clear = F.col("track_status") == "track_clear"
    reversed_ = F.coalesce((F.col("before_position") > F.col("rival_before")) & (F.col("after_position") < F.col("rival_after")), F.lit(False))
    ahead = F.col("lap_number") - F.col("rival_lap")
    label = F.when(~complete | ~clear, "unknown").when(F.col("rival").isNull(), "scheduled").when(reversed_ & (ahead < 0), "undercut").when(reversed_ & (ahead > 0), "overcut").when(ahead.between(0, 1), "reactive").otherwise("scheduled")
    mean = F.bround(F.avg(F.when(F.col("pit_lane_time_ms") > 0, F.col("pit_lane_time_ms"))).over(Window.partitionBy("session_id")), 0).cast("long")
    out = rows.withColumns({"label": label, "quality": F.when(complete & clear, "supported").otherwise("degraded"), "position_gain": F.col("before_position") - F.col("after_position")})
    return out.withColumn("field_average_ms", mean).drop("before_lap", "after_lap", "last_lap", "rival_lap", "rival_before", "rival_after")


def standings(laps: DataFrame, drivers: DataFrame, at_lap: int | None = None, sort: str = "position") -> DataFrame:
    """Order of each session's drivers, at a lap or the end: laps done (most first), last crossing, code.

    Gap to the leader and interval to the last crossing before are 0 at least. A driver runs within
    one lap of the most laps done. ``sort`` renumbers nothing; it adds the place in another order.
    """
    kept = laps.where("not is_deleted")
    if at_lap is not None:
        kept = kept.where(F.col("lap_number") <= at_lap)
    by = ["session_id", "driver_code"]
    done = kept.groupBy(*by).agg(F.max("lap_number").alias("laps_done"), F.max(F.unix_millis("lap_end_utc")).alias("end_ms"), F.count_if("is_pit_in_lap").alias("pit_count"), F.min("lap_time_ms").alias("best_lap_ms"), F.max_by(F.struct("lap_time_ms", "compound", "tyre_life"), "lap_number").alias("l"))
    newest = top_n(kept.where("lap_time_ms is not null"), by, [F.desc("lap_number")], 5).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lap_number", "lap_time_ms"))).alias("r"))
    rows = drivers.select(*by, "full_name", "team_name").join(done, by, "left").join(newest, by, "left")
    order = Window.partitionBy("session_id").orderBy(F.desc(F.coalesce("laps_done", F.lit(-1))), F.col("end_ms").asc_nulls_last(), "driver_code")
    whole = Window.partitionBy("session_id")
    before = F.last("end_ms", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    leader = F.first("end_ms", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    clamp = lambda c: F.coalesce(F.greatest(c, F.lit(0)), F.lit(0))
    gap = F.when(F.col("end_ms").isNotNull(), clamp(F.col("end_ms") - leader)).otherwise(0)
    interval = F.when(F.col("end_ms").isNotNull() & before.isNotNull(), clamp(F.col("end_ms") - before)).otherwise(0)
    best, most = F.min("best_lap_ms").over(whole), F.max("laps_done").over(whole)
    out = rows.select(
        *by, "full_name", "team_name", "laps_done", "best_lap_ms",
        F.row_number().over(order).alias("position"), gap.alias("gap_ms"), interval.alias("interval_ms"),
        F.col("l.lap_time_ms").alias("last_lap_ms"), F.coalesce(F.col("best_lap_ms") == best, F.lit(False)).alias("is_session_best"),
        F.coalesce(F.col("l.lap_time_ms") == F.col("best_lap_ms"), F.lit(False)).alias("is_personal_best"), F.col("l.compound").alias("compound"), F.col("l.tyre_life").alias("tyre_life"),
        F.coalesce("pit_count", F.lit(0)).alias("pit_count"), F.when(F.coalesce(F.coalesce("laps_done", F.lit(-1)) >= most - 1, F.lit(False)), "running").otherwise("out").alias("status"), F.col("r.lap_time_ms").alias("recent_laps"),
    )
    keys = {"position": [F.col("position")], "last_lap_ms": [F.col("last_lap_ms").asc_nulls_last(), F.col("position")], "best_lap_ms": [F.col("best_lap_ms").asc_nulls_last(), F.col("position")], "gap_ms": [F.col("gap_ms"), F.col("position")], "pit_count": [F.desc("pit_count"), F.col("position")]}
    if sort not in keys:
        raise ValueError(f"sort must be one of {list(keys)}")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*keys[sort])))


def position_changes(laps: DataFrame, drivers: DataFrame) -> DataFrame:
    """Start (grid if over 0, else the order after lap 1), finish and places gained."""
    end = standings(laps, drivers).select("session_id", "driver_code", "full_name", F.col("position").alias("finish"))
    one = standings(laps, drivers, 1).select("session_id", "driver_code", F.col("position").alias("lap_one"))
    rows = end.join(one, ["session_id", "driver_code"]).join(drivers.select("session_id", "driver_code", "grid_position"), ["session_id", "driver_code"])
    start = F.when(F.col("grid_position") > 0, F.col("grid_position")).otherwise(F.col("lap_one"))
    return rows.select("session_id", "driver_code", "full_name", start.alias("start"), "finish", (start - F.col("finish")).alias("delta")).where("start is not null")


INCIDENT = "(?i)spin|off track|off the track|collision|incident"


def race_control_incidents(events: DataFrame, messages: DataFrame, drivers: DataFrame, types: list[str] | None = None, most: int = 200) -> DataFrame:
    """Non-clear status periods and messages of spins, excursions, collisions and incidents, by time (nulls last), ``most`` of a session.

    safety_periods counts safety-car and virtual safety-car periods before the type filter.
    """
    periods = track_status_periods(events).where("status_code in ('2', '4', '5', '6', '7')")
    kind = F.expr("case status_code when '2' then 'yellow' when '4' then 'safety_car' when '5' then 'red' else 'vsc' end")
    text = F.when(F.trim(F.coalesce("message", F.lit(""))) == "", status_sentence(F.col("status_name"))).otherwise(F.col("message"))
    a = periods.select("session_id", kind.alias("type"), F.lit(None).cast("int").alias("lap_number"), F.col("start_time_ms").alias("session_time_ms"), text.alias("message"), F.lit(None).cast("string").alias("driver_code"), F.when(F.col("status_code").isin("4", "5"), "high").otherwise("info").alias("severity"), F.lit(0).cast("long").alias("seq"))
    said = top_n(messages.where(F.col("message").rlike(INCIDENT)), ["session_id"], ["session_time_ms", "race_control_message_id"], most)
    named = said.join(drivers.select("session_id", F.col("driver_number").alias("racing_number"), "driver_code"), ["session_id", "racing_number"], "left")
    b = named.select("session_id", F.when(F.lower("message").contains("spin"), "spin").otherwise("off_track").alias("type"), "lap_number", "session_time_ms", "message", "driver_code", F.lit("info").alias("severity"), F.col("race_control_message_id").cast("long").alias("seq"))
    safety = a.groupBy("session_id").agg(F.count_if(F.col("type").isin("safety_car", "vsc")).alias("safety_periods"))
    rows = a.unionByName(b)
    if types:
        rows = rows.where(F.col("type").isin([t.lower() for t in types]))
    rows = top_n(rows, ["session_id"], ["session_time_ms", "seq", "type", "message"], most)
    return rows.join(safety, "session_id", "left").fillna(0, ["safety_periods"])


def race_story(sessions: DataFrame, laps: DataFrame, samples: DataFrame, weather: DataFrame, events: DataFrame, messages: DataFrame, most_messages: int = 50) -> DataFrame:
    """One row a session: weather, stints, pit laps, status periods, first messages as arrays, and insights."""
    stints = stint_summaries(laps).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("driver_code", "stint_number", "compound", "laps"))).alias("stints"), F.array_join(F.array_sort(F.collect_set("compound")), ", ").alias("compounds"))
    pits = pit_laps(laps, samples).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("session_time_ms", "driver_code", "lap_number", "kind"))).alias("pit_events"))
    periods = track_status_periods(events).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_time_ms", "status_name"))).alias("periods"), F.count_if(F.col("status_code") != "1").alias("neutral"))
    said = top_n(messages, ["session_id"], ["session_time_ms", "race_control_message_id"], most_messages).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("session_time_ms", "message"))).alias("messages"))
    out = reduce(lambda x, y: x.join(y, "session_id", "left"), (weather_summary(weather).select("session_id", "any_rain", "avg_track_temp_c"), stints, pits, periods, said), sessions.select("session_id", "event_name"))
    number = lambda c: F.coalesce(F.size(c), F.lit(0))
    lists = insights(
        (number("stints") > 0, insight("tyre_strategy", F.concat(F.lit("Stint data contains "), number("stints").cast("string"), F.lit(" stints across compounds: "), F.col("compounds"), F.lit(".")), number("stints"), "stints")),
        (number("pit_events") > 0, insight("pit_stops", F.concat(F.lit("Detected "), number("pit_events").cast("string"), F.lit(" pit-in/out lap markers.")), number("pit_events"), "events")),
        (F.col("neutral") > 0, insight("track_status", F.concat(F.lit("Track status includes "), F.col("neutral").cast("string"), F.lit(" non-clear period(s).")), F.col("neutral"), "periods")),
        (number("messages") > 0, insight("race_control", F.concat(F.lit("Included "), number("messages").cast("string"), F.lit(" race-control messages for narrative context.")), number("messages"), "messages")),
    )
    return out.withColumn("insights", lists).drop("neutral", "compounds")


def _fact_text() -> Column:
    lane, mean = F.col("pit_lane_time_ms"), F.col("field_average_ms")
    seconds = lambda c: F.concat(F.floor(c / 1000).cast("string"), F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"), F.lit("s"))
    delta = lane - mean
    gain = F.col("position_gain")
    return F.concat(
        F.col("driver_code"), F.lit(" stopped on lap "), F.col("lap_number").cast("string"), F.lit(" for "), F.coalesce("to_compound", F.lit("an unknown compound")),
        F.when(lane.isNotNull(), F.concat(F.lit(" in "), seconds(lane))).otherwise(""),
        F.when(delta.isNotNull(), F.concat(F.lit(", "), seconds(F.abs(delta)), F.when(delta <= 0, " faster").otherwise(" slower"), F.lit(" than the field average"))).otherwise(""),
        F.when(F.col("label").isin("undercut", "overcut"), F.concat(F.lit("; the "), F.col("label"), F.lit(" on "), F.col("rival"), F.lit(" changed track position"))).when(gain.isNotNull() & (gain != 0), F.concat(F.lit("; net position change "), F.when(gain > 0, "+").otherwise(""), gain.cast("string"))).otherwise(""),
        F.lit("."),
    )


FACT = ["session_id", "fact_id", "kind", "text", "value", "unit", "evidence", "quality", "policy"]


def narrative_facts(laps: DataFrame, drivers: DataFrame, events: DataFrame, messages: DataFrame, weather: DataFrame, incidents: int = 10) -> DataFrame:
    """Facts on the winner, every stop, the first incidents and the weather, with their evidence, quality and whether to assert them."""
    evidence = lambda *names: F.array(*map(F.lit, names))
    length = laps.where("not is_deleted").groupBy("session_id").agg(F.max("lap_number").alias("race_laps"))
    win = standings(laps, drivers).where("position = 1").join(length, "session_id")
    winner = win.select("session_id", F.lit("debrief-winner").alias("fact_id"), F.lit("winner").alias("kind"), F.concat(F.col("driver_code"), F.lit(" was classified first after "), F.col("race_laps").cast("string"), F.lit(" laps.")).alias("text"), F.lit(1.0).alias("value"), F.lit("position").alias("unit"), evidence("standings").alias("evidence"), F.lit("supported").alias("quality"), F.lit("assert").alias("policy"))
    stop = strategy_summary(laps, events).select("session_id", F.concat(F.lit("strategy-"), F.lower("driver_code"), F.lit("-"), F.col("lap_number").cast("string")).alias("fact_id"), F.lit("strategy_stop").alias("kind"), _fact_text().alias("text"), F.col("pit_lane_time_ms").cast("double").alias("value"), F.lit("ms").alias("unit"), evidence("strategy/summarize", "positions").alias("evidence"), "quality", F.when(F.col("quality") == "supported", "assert").otherwise("caveat").alias("policy"))
    found = race_control_incidents(events, messages, drivers)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("session_time_ms").asc_nulls_last(), "seq", "type", "message"))
    first = found.withColumn("k", number).where(F.col("k") <= incidents)
    text = F.when(F.col("lap_number").isNull(), F.col("message")).otherwise(F.concat(F.lit("Lap "), F.col("lap_number").cast("string"), F.lit(": "), F.col("message")))
    incident = first.select("session_id", F.concat(F.lit("incident-"), F.col("k").cast("string")).alias("fact_id"), F.lit("incident").alias("kind"), text.alias("text"), F.col("lap_number").cast("double").alias("value"), F.when(F.col("lap_number").isNotNull(), "lap").alias("unit"), evidence("incidents").alias("evidence"), F.lit("supported").alias("quality"), F.lit("assert").alias("policy"))
    rain = weather_summary(weather).select("session_id", F.lit("debrief-weather").alias("fact_id"), F.lit("weather").alias("kind"), F.when(F.col("any_rain"), "Rainfall was observed during the session.").otherwise("No rainfall was observed during the session.").alias("text"), F.col("any_rain").cast("int").cast("double").alias("value"), F.lit("boolean").alias("unit"), evidence("weather/trend").alias("evidence"), F.lit("supported").alias("quality"), F.lit("assert").alias("policy"))
    return reduce(DataFrame.unionByName, (winner, stop, incident, rain)).select(*FACT)


def story_quality(facts: DataFrame) -> DataFrame:
    """Per session: supported, degraded and omitted facts, the status they give, and warnings."""
    told = F.col("policy") != "omit"
    out = facts.groupBy("session_id").agg(F.count_if((F.col("quality") == "supported") & told).alias("supported"), F.count_if((F.col("quality") == "degraded") & told).alias("degraded"), F.count_if(~told).alias("omitted"))
    status = F.when(F.col("degraded") > 0, "degraded").when(F.col("supported") > 0, "supported").otherwise("unavailable")
    return out.withColumns({"status": status, "warnings": F.when(F.col("degraded") > 0, F.array(F.lit("Some facts require a data-quality caveat."))).otherwise(F.array().cast("array<string>"))})


SECTIONS = ("strategy", "incidents", "weather")


def race_debrief(sessions: DataFrame, laps: DataFrame, drivers: DataFrame, events: DataFrame, messages: DataFrame, weather: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """One row a session: headline, facts of the chosen sections in order, their quality, and how many incidents (50 at most)."""
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    kinds = {"strategy": "strategy_stop", "incidents": "incident", "weather": "weather"}
    facts = narrative_facts(laps, drivers, events, messages, weather).where(F.col("kind").isin("winner", *(kinds[s] for s in sections)))
    by = facts.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "winner", F.col("text"))).alias("headline"), F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))
    number = race_control_incidents(events, messages, drivers).groupBy("session_id").agg(F.least(F.count(F.lit(1)), F.lit(50)).alias("incidents"))
    out = sessions.select("session_id", "event_name").join(by, "session_id", "left").join(story_quality(facts), "session_id", "left").join(number, "session_id", "left")
    return out.fillna(0, ["incidents"])


def winner_report(laps: DataFrame, drivers: DataFrame) -> DataFrame:
    """One row a session: winner, fastest lap, the winner's stints as shares of laps, stops, largest gain and loss since lap 1."""
    end = standings(laps, drivers)
    one = standings(laps, drivers, 1).select("session_id", "driver_code", F.col("position").alias("p0"))
    win = end.where("position = 1").select("session_id", F.col("driver_code").alias("winner"))
    fast = end.where("best_lap_ms is not null").groupBy("session_id").agg(F.min(F.struct("best_lap_ms", "position", "driver_code")).alias("f"))
    stints = stint_summaries(laps).join(win, "session_id").where("driver_code = winner")
    share = F.round(100.0 * F.col("laps") / F.sum("laps").over(Window.partitionBy("session_id")), 1)
    shares = stints.withColumn("share", share).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("stint_number", "compound", "share"))).alias("stints"), (F.count(F.lit(1)) - 1).alias("stops"))
    moves = end.join(one, ["session_id", "driver_code"]).withColumn("delta", F.col("p0") - F.col("position"))
    ends = moves.groupBy("session_id").agg(F.min(F.struct((-F.col("delta")).alias("d"), "position", "driver_code")).alias("g"), F.min(F.struct(F.col("delta").alias("d"), "position", "driver_code")).alias("l"))
    out = win.join(fast, "session_id", "left").join(shares, "session_id", "left").join(ends, "session_id", "left")
    return out.select("session_id", "winner", F.col("f.driver_code").alias("fastest_driver"), F.col("f.best_lap_ms").alias("fastest_lap_ms"), "stints", "stops", F.col("g.driver_code").alias("largest_gain_driver"), (-F.col("g.d")).alias("largest_gain"), F.col("l.driver_code").alias("largest_loss_driver"), F.col("l.d").alias("largest_loss"))
