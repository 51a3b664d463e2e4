"""Interval, as-of and nearest joins. None compares all rows of a session with all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import status_name


def track_status_periods(events: DataFrame) -> DataFrame:
    """Status events as periods: each ends where the session's next begins, the last is open."""
    after = Window.partitionBy("session_id").orderBy("event_time_ms", "status_code")
    return events.select("session_id", "status_code", status_name(F.col("status_code")).alias("status_name"), F.col("event_time_ms").alias("start_time_ms"), F.lead("event_time_ms").over(after).alias("end_time_ms"), "message")


def asof_backward(probes: DataFrame, states: DataFrame, by: list[str], probe_time: str, state_time: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """Each probe with the columns of the last state at or before its time, by union and a running last.

    States at the probe's time count. Of states at one time the greatest ``tie`` wins. Probes without
    a time, or before every state, get nulls.
    """
    held = F.struct(*columns)
    top = states.groupBy(*by, F.col(state_time).alias("_t")).agg((F.max_by(held, tie) if tie else F.max(held)).alias("_s"))
    empty = F.lit(None).cast(top.schema["_s"].dataType)
    rows = F.struct(*probes.columns)
    both = probes.select(*by, F.col(probe_time).alias("_t"), F.lit(1).alias("_o"), rows.alias("_p"), empty.alias("_s")).unionByName(top.select(*by, "_t", F.lit(0).alias("_o"), "_s"), allowMissingColumns=True)
    run = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_s", ignorenulls=True).over(run)).where("_o = 1")
    kept = F.when(F.col("_t").isNotNull(), F.col("_f"))
    return found.select("_p.*", *(kept[c].alias(c) for c in columns))


def asof_status(samples: DataFrame, events: DataFrame, time: str = "session_time_ms") -> DataFrame:
    """``samples`` with track_status: the name of the period that holds their time, ``unknown`` before the first."""
    periods = events.select("session_id", "event_time_ms", "status_code")
    found = asof_backward(samples, periods, ["session_id"], time, "event_time_ms", ["status_code"], "status_code")
    return found.withColumn("track_status", F.when(F.col("status_code").isNull(), "unknown").otherwise(status_name(F.col("status_code")))).drop("status_code")


def window_start_position(windows: DataFrame, positions: DataFrame, time: str = "start_sample_time_utc") -> DataFrame:
    """``windows`` with x and y of the position sample at exactly their first time."""
    at = positions.select("session_id", "driver_code", F.col("sample_time_utc").alias(time), "x", "y")
    return windows.join(at, ["session_id", "driver_code", time], "left")


def nearest_position(samples: DataFrame, positions: DataFrame, within_ms: int = 500) -> DataFrame:
    """``samples`` with x, y, z and offset_ms of the position nearest in time, at most ``within_ms`` away; of two the earlier, of two at one time the first by source order."""
    ms = F.unix_millis("sample_time_utc")
    # distances are whole milliseconds; within one the time itself decides
    own_order = [c for c in ["source_sample_index"] if c in positions.columns]
    own = samples.withColumn("_ms", ms).withColumn("_slot", F.floor(F.col("_ms") / within_ms))
    spread = positions.select("session_id", "driver_code", ms.alias("_pms"), F.unix_micros("sample_time_utc").alias("_pus"), *own_order, "x", "y", "z").withColumn("_slot", F.explode(F.array(*(F.floor(F.col("_pms") / within_ms) + k for k in (-1, 0, 1)))))
    near = own.select("session_id", "driver_code", "_ms", "_slot").distinct().join(spread, ["session_id", "driver_code", "_slot"]).withColumn("_d", F.abs(F.col("_pms") - F.col("_ms"))).where(F.col("_d") <= within_ms)
    best = near.groupBy("session_id", "driver_code", "_ms").agg(F.min(F.struct("_d", "_pus", *own_order, "_pms", "x", "y", "z")).alias("_b"))
    joined = own.join(best, ["session_id", "driver_code", "_ms"], "left")
    return joined.select(*samples.columns, F.col("_b.x").alias("x"), F.col("_b.y").alias("y"), F.col("_b.z").alias("z"), (F.col("_b._pms") - F.col("_ms")).alias("offset_ms"))


def nearest_corner(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """``rows`` (session_id, x, y) with marker_number, marker_letter and distance_to_corner of the session's nearest corner; ties to the lowest number."""
    corners = markers.where("marker_type = 'corner'").groupBy("session_id").agg(F.collect_list(F.struct("marker_number", "marker_letter", "x", "y")).alias("_c"))
    distance = F.transform("_c", lambda c: F.struct(F.sqrt(F.pow(c["x"] - F.col("x"), 2) + F.pow(c["y"] - F.col("y"), 2)).alias("d"), c["marker_number"].alias("n"), c["marker_letter"].alias("l")))
    best = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array_min(F.filter(distance, lambda s: s["d"].isNotNull())))
    return rows.join(corners, "session_id", "left").withColumn("_b", best).select(*rows.columns, F.col("_b.n").alias("marker_number"), F.col("_b.l").alias("marker_letter"), F.col("_b.d").alias("distance_to_corner"))


def overlap_counts(rows: DataFrame, keys: list[str], start: str, end: str, periods: DataFrame, kinds: dict[str, Column], by: list[str] = ("session_id",), closed: bool = True, width: int = 600_000) -> DataFrame:
    """Per row (``keys``) how many periods (start_time_ms, end_time_ms or null) of its ``by`` overlap [start, end], by kind (conditions on periods).

    A sweep over time: periods that overlap are those that began by the row's end less those that
    were over before its start, so two running sums answer, and nothing is copied. Sums run within
    time slots of ``width`` and start from the slots before, so a large session is many tasks.
    ``closed``: touching ends count; without it rows need some length. A period that ends before it
    starts is a point. Rows with a null or reversed range have zeros; ``keys`` tell rows apart.
    """
    by, zero = list(by), F.lit(0).cast("long")
    begun, over = [f"_begun_{k}" for k in kinds], [f"_over_{k}" for k in kinds]
    sums = [*begun, *over]
    ones = [F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("long").alias(k) for k, c in kinds.items()]
    known = periods.where("start_time_ms is not null").select(*by, "start_time_ms", F.greatest("start_time_ms", "end_time_ms").alias("_end"), F.col("end_time_ms").isNull().alias("_open"), *ones)

    def at(df: DataFrame, time: str, order: int, own: list[str], *more: Column) -> DataFrame:
        """Points in time; those of periods count in the sums ``own``."""
        values = [F.col(c.split("_", 2)[2]).alias(c) if c in own else zero.alias(c) for c in sums]
        return df.select(*by, F.col(time).alias("_t"), F.lit(order).alias("_o"), *values, *more)

    # at one time: closed, a start counts for rows that end there and an end does not; open, the other way round
    starts, ends = at(known, "start_time_ms", 0 if closed else 2, begun), at(known.where("not _open"), "_end", 2 if closed else 0, over)
    asked = rows.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("_from"), F.col(end).alias("_to"), F.struct(*keys).alias("_row"))
    probes = [at(asked, t, 1, [], F.col("_row"), F.lit(t == "_to").alias("_last")) for t in ("_from", "_to")]
    points = starts.unionByName(ends).unionByName(probes[0].unionByName(probes[1]), allowMissingColumns=True).withColumn("_slot", F.floor(F.col("_t") / width))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = points.groupBy(*by, "_slot").agg(*(F.sum(c).alias(c) for c in sums)).select(*by, "_slot", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_before") for c in sums))
    inside = Window.partitionBy(*by, "_slot").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({c: F.sum(c).over(inside) for c in sums}).where("_row is not null").join(slots, [*by, "_slot"])
    total = lambda c: F.col(c) + F.col(f"{c}_before")
    met = run.groupBy("_row").agg(*(F.sum(F.when(F.col("_last"), total(f"_begun_{k}")).otherwise(-total(f"_over_{k}"))).alias(k) for k in kinds)).select("_row.*", *kinds)
    return rows.select(*keys).distinct().join(met, keys, "left").fillna(0, list(kinds))


def lap_status_overlap(laps: DataFrame, events: DataFrame, width: int = 600_000) -> DataFrame:
    """Per lap (lap_id, lap_start_ms, lap_end_ms): overlapping periods by kind, and the distinct codes in order; ends are inclusive."""
    codes = events.where("status_code is not null").groupBy("session_id").agg(F.collect_set("status_code").alias("_codes"))
    # a row for each code of its session: there are as many as kinds of status
    own = laps.select("session_id", "lap_id", "lap_start_ms", "lap_end_ms").join(codes, "session_id").withColumn("status_code", F.explode("_codes")).drop("_codes")
    met = overlap_counts(own, ["lap_id", "status_code"], "lap_start_ms", "lap_end_ms", track_status_periods(events), {"n": F.lit(True)}, ["session_id", "status_code"], width=width)
    of = lambda *names: F.sum(F.when(F.col("status_code").isin(*names), F.col("n")).otherwise(0))
    counts = met.where("n > 0").groupBy("lap_id").agg(of("4").alias("safety_car_periods"), of("6", "7").alias("virtual_safety_car_periods"), of("5").alias("red_flag_periods"), F.array_join(F.array_sort(F.collect_set("status_code")), ",").alias("track_status_codes"))
    zero = {c: 0 for c in ("safety_car_periods", "virtual_safety_car_periods", "red_flag_periods")}
    return laps.select("lap_id").join(counts, "lap_id", "left").fillna(zero)


def lap_race_control(laps: DataFrame, drivers: DataFrame, messages: DataFrame) -> DataFrame:
    """Per lap: messages of its number that are global or for its driver, and those of them that speak of flags."""
    own = laps.join(drivers.select("session_id", "driver_code", "driver_number"), ["session_id", "driver_code"], "left").select("lap_id", "session_id", "lap_number", "driver_number")
    said = F.lower("message")
    flag = F.coalesce(F.lower("category").contains("flag"), F.lit(False)) | F.coalesce(said.contains("yellow") | said.contains("safety car") | said.contains("red flag"), F.lit(False))
    # one row for each lap of a session and for each driver on it
    shared = messages.where("racing_number is null").groupBy("session_id", "lap_number").agg(F.count(F.lit(1)).alias("a"), F.count_if(flag).alias("b"))
    named = messages.where("racing_number is not null").groupBy("session_id", "lap_number", F.col("racing_number").alias("driver_number")).agg(F.count(F.lit(1)).alias("c"), F.count_if(flag).alias("d"))
    joined = own.join(shared, ["session_id", "lap_number"], "left").join(named, ["session_id", "lap_number", "driver_number"], "left").fillna(0, ["a", "b", "c", "d"])
    return joined.select("lap_id", (F.col("a") + F.col("c")).alias("race_control_messages"), (F.col("b") + F.col("d")).alias("race_control_flag_messages"))


def messages_with_driver(messages: DataFrame, drivers: DataFrame) -> DataFrame:
    """``messages`` with the code of the driver that their racing number names."""
    named = drivers.select("session_id", F.col("driver_number").alias("racing_number"), "driver_code")
    return messages.join(named, ["session_id", "racing_number"], "left")


def window_context(windows: DataFrame, messages: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Windows (session_id, window_start_ms, window_end_ms) with messages in [start, end) and status kinds that overlap them."""
    keys = ["session_id", "window_start_ms"]
    bucket = (F.floor(F.col("session_time_ms") / width) * width).cast("long")
    said = messages.where("session_time_ms is not null").groupBy("session_id", bucket.alias("window_start_ms")).agg(F.count(F.lit(1)).alias("messages"))
    code = F.col("status_code")
    kinds = {"safety_car": code == "4", "vsc": code.isin("6", "7"), "red_flag": code == "5", "yellow": code == "2"}
    met = overlap_counts(windows, keys, "window_start_ms", "window_end_ms", track_status_periods(events), kinds, closed=False, width=width * 20)
    met = met.withColumns({k: F.col(k) > 0 for k in kinds})
    return windows.join(said, keys, "left").join(met, keys, "left").fillna(0, ["messages"]).fillna(False, list(kinds))


def markers_against_bounds(markers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Markers with their session's coordinate bounds (min_x, max_x, min_y, max_y) and whether they lie inside; null without bounds."""
    joined = markers.join(bounds, "session_id", "left")
    return joined.withColumn("inside", F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
