"""Normalisation of raw session data, lap assignment, constraints and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits as one dash, none at the ends; empty: ``session``."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "session").otherwise(out)


def session_key(session_id: Column) -> Column:
    """31 bits of the id's crc32."""
    return F.crc32(session_id).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def normalize_sessions(raw: DataFrame) -> DataFrame:
    """(year, event_name, session_type, ...) with session_id year-slug-code and its integer key."""
    session_id = F.concat(F.col("year").cast("string"), F.lit("-"), slug(F.col("event_name")), F.lit("-"), F.lower("session_type"))
    return raw.withColumn("session_id", session_id).withColumn("session_key", session_key(F.col("session_id")))


def normalize_drivers(raw: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Codes in upper case, falling back to the source's reference; only ``selected`` (driver_code) if given. Rows without either are dropped."""
    code = F.upper(F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.col("reference")))
    out = raw.withColumn("driver_code", code).where("driver_code is not null").drop("code", "reference")
    return out if selected is None else out.join(selected.select(F.upper("driver_code").alias("driver_code")).distinct(), "driver_code", "left_semi")


def normalize_laps(raw: DataFrame) -> DataFrame:
    """Lap ids, ends (start + lap time, null if either is missing or 0), pit flags from pit times, deleted without nulls; accurate keeps three states."""
    lap_id = F.concat_ws("-", "session_id", F.lower("driver_code"), F.col("lap_number").cast("string"))
    end = F.when(F.col("lap_time_ms") > 0, F.timestamp_millis(F.unix_millis("lap_start_utc") + F.col("lap_time_ms")))
    return raw.withColumns({"lap_id": lap_id, "lap_end_utc": end, "is_pit_in_lap": F.col("pit_in_session_time_ms").isNotNull(), "is_pit_out_lap": F.col("pit_out_session_time_ms").isNotNull(), "is_deleted": F.coalesce("is_deleted", F.lit(False))})


def assign_samples_to_laps(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """``samples`` with the lap whose window (start_ms, end_ms; both inclusive) holds their session time, the earlier of two, and lap time.

    Samples in gaps are dropped. A late sample of an earlier lap is kept. Windows of a driver may touch
    but not nest: the last window that begins before a time, or the one before it, holds it.
    """
    keys = ["session_id", "driver_code"]
    order = Window.partitionBy(*keys).orderBy("start_ms", "lap_number")
    w = windows.select(*keys, "lap_number", "start_ms", "end_ms").where("start_ms is not null and end_ms is not null")
    w = w.withColumn("before", F.lag(F.struct("lap_number", "start_ms", "end_ms")).over(order))
    state = w.select(*keys, F.col("start_ms").alias("_t"), F.lit(0).alias("_o"), F.struct("lap_number", "start_ms", "end_ms", "before").alias("_w"))
    rows = samples.where("session_time_ms is not null").drop("lap_number", "lap_time_ms")
    both = rows.select(*keys, F.col("session_time_ms").alias("_t"), F.lit(1).alias("_o"), F.struct(*rows.columns).alias("_p")).unionByName(state, allowMissingColumns=True)
    run = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_w", ignorenulls=True).over(run)).where("_o = 1")
    earlier = F.col("_f.before.end_ms") >= F.col("_t")
    lap = F.when(earlier, F.struct(F.col("_f.before.lap_number").alias("n"), F.col("_f.before.start_ms").alias("s"))).when(F.col("_f.end_ms") >= F.col("_t"), F.struct(F.col("_f.lap_number").alias("n"), F.col("_f.start_ms").alias("s")))
    return found.withColumn("_l", lap).where("_l is not null").select("_p.*", F.col("_l.n").alias("lap_number"), (F.col("_t") - F.col("_l.s")).alias("lap_time_ms"))


def _clean(c: str) -> Column:
    return F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))


def normalize_telemetry(raw: DataFrame) -> DataFrame:
    """Boolean brake as 0 or 100, percentages within 0 to 100, NaN as null; rows without an absolute time are dropped."""
    brake = F.when(F.col("brake"), 100.0).otherwise(0.0) if raw.schema["brake"].dataType.typeName() == "boolean" else F.least(F.greatest(_clean("brake"), F.lit(0.0)), F.lit(100.0))
    out = raw.where("sample_time_utc is not null").withColumns({"brake_pct": F.when(F.col("brake").isNotNull(), brake), "throttle_pct": F.when(_clean("throttle_pct").isNotNull(), F.least(F.greatest(_clean("throttle_pct"), F.lit(0.0)), F.lit(100.0))), "speed_kmh": _clean("speed_kmh"), "rpm": _clean("rpm")})
    return out.drop("brake")


def normalize_positions(raw: DataFrame) -> DataFrame:
    return raw.where("sample_time_utc is not null").withColumns({c: _clean(c) for c in "xyz"})


def normalize_weather(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Absolute times from the session's start and the session time; rows that lack either are dropped."""
    at = F.timestamp_millis(F.unix_millis("session_start_utc") + F.col("session_time_ms"))
    return raw.join(sessions.select("session_id", "session_start_utc"), "session_id").withColumn("sample_time_utc", at).where("sample_time_utc is not null").drop("session_start_utc")


def normalize_status_events(raw: DataFrame) -> DataFrame:
    return raw.where("event_time_ms is not null and status_code is not null and trim(status_code) <> ''")


def normalize_race_control(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session times from absolute ones (negative: null), laps over 0, no blank messages."""
    ms = F.unix_millis("message_time_utc") - F.unix_millis("session_start_utc")
    out = raw.where("trim(coalesce(message, '')) <> ''").join(sessions.select("session_id", "session_start_utc"), "session_id", "left")
    return out.withColumns({"session_time_ms": F.when(ms >= 0, ms), "lap_number": F.when(F.col("lap_number") > 0, F.col("lap_number"))}).drop("session_start_utc")


def normalize_circuit_markers(corners: DataFrame, lights: DataFrame, sectors: DataFrame) -> DataFrame:
    """The three lists as one table with marker_type; rows without x or y are dropped."""
    tagged = [df.withColumn("marker_type", F.lit(t)) for df, t in ((corners, "corner"), (lights, "marshal_light"), (sectors, "marshal_sector"))]
    return reduce(DataFrame.unionByName, tagged).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def enrich_grid_position(drivers: DataFrame, results: DataFrame) -> DataFrame:
    """Grid positions from results (session_id, driver_code, grid); missing, negative and NaN change nothing; 0 is the pit lane."""
    grid = F.when(~F.isnan("grid") & (F.col("grid") >= 0), F.col("grid").cast("int"))
    own = results.select("session_id", "driver_code", grid.alias("_g"))
    return drivers.join(own, ["session_id", "driver_code"], "left").withColumn("grid_position", F.coalesce("_g", "grid_position")).drop("_g")


def dedupe_first_by_key(rows: DataFrame, keys: list[str], order: str = "source_sample_index") -> DataFrame:
    """The first row of each key by source order, and how many more there were."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"_r": F.row_number().over(w.orderBy(order)), "duplicates": F.count(F.lit(1)).over(w) - 1}).where("_r = 1").drop("_r")


RULES = {
    "sessions": {"year_range": "year between 1950 and 2100", "type_known": "session_type in ('R', 'Q', 'S', 'SQ', 'FP1', 'FP2', 'FP3')"},
    "drivers": {"code_shape": "driver_code rlike '^[A-Z0-9]{2,4}$'", "grid_not_negative": "grid_position >= 0"},
    "laps": {"lap_positive": "lap_number > 0", "time_not_negative": "lap_time_ms >= 0", "end_after_start": "lap_end_utc >= lap_start_utc", "pit_in_not_negative": "pit_in_session_time_ms >= 0"},
    "telemetry": {"throttle_range": "throttle_pct between 0 and 100", "brake_range": "brake_pct between 0 and 100", "speed_not_negative": "speed_kmh >= 0", "gear_range": "gear between -1 and 9"},
    "weather": {"humidity_range": "humidity_pct between 0 and 100", "wind_range": "wind_direction_deg between 0 and 359"},
    "track_status": {"code_known": "status_code in ('1', '2', '3', '4', '5', '6', '7')"},
    "markers": {"type_known": "marker_type in ('corner', 'marshal_light', 'marshal_sector')"},
}
KEYS = {"sessions": ["session_id"], "drivers": ["session_id", "driver_code"], "laps": ["session_id", "driver_code", "lap_number"], "telemetry": ["session_id", "driver_code", "sample_time_utc"]}


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations) of value rules, primary keys and references to sessions; rules that hold are left out. Null meets a value rule."""
    parts = []
    for name, df in tables.items():
        rules = RULES.get(name, {})
        if rules:
            counts = df.agg(*(F.count_if(~F.expr(r)).alias(k) for k, r in rules.items()))
            parts.append(counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))).alias("x")).select(F.lit(name).alias("table_name"), "x.*"))
        if name in KEYS:
            again = df.groupBy(*KEYS[name]).count().where("count > 1")
            parts.append(again.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("table_name"), F.lit("primary_key").alias("rule"), "violations"))
        if name != "sessions" and "sessions" in tables and "session_id" in df.columns:
            orphans = df.groupBy("session_id").count().join(tables["sessions"].select("session_id"), "session_id", "left_anti")
            parts.append(orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(F.lit(name).alias("table_name"), F.lit("session_reference").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def ingest_manifest(laps: DataFrame, samples: DataFrame, positions: DataFrame) -> DataFrame:
    """Per driver: laps, samples, and the laps without car samples or positions in order; session_empty: the session has none at all."""
    keys = ["session_id", "driver_code", "lap_number"]
    one = F.count(F.lit(1))
    rows = laps.select(*keys).join(samples.groupBy(*keys).agg(one.alias("t")), keys, "left").join(positions.groupBy(*keys).agg(one.alias("p")), keys, "left").fillna(0, ["t", "p"])
    lists = {n: F.array_sort(F.collect_list(F.when(F.col(c) == 0, F.col("lap_number")))).alias(n) for n, c in (("laps_without_telemetry", "t"), ("laps_without_positions", "p"))}
    out = rows.groupBy("session_id", "driver_code").agg(one.alias("laps"), F.sum("t").alias("telemetry_samples"), F.sum("p").alias("position_samples"), *lists.values())
    whole = Window.partitionBy("session_id")
    return out.withColumn("session_empty", (F.sum("telemetry_samples").over(whole) == 0) | (F.sum("position_samples").over(whole) == 0))


def first_laps(laps: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id", "driver_code").orderBy("lap_number")
    return laps.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
