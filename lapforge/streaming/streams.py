"""Structured Streaming forms of operators. Each gives its batch twin's rows on the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quality_family
from ..operators.lookups import event_candidates


def stream_event_candidates(samples: DataFrame) -> DataFrame:
    """Labelled samples, without state."""
    return event_candidates(samples)


def stream_tumbling_metrics(samples: DataFrame, width: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Samples, mean and peak speed and throttle lifts of each driver and window; late rows are dropped after ``late``."""
    rows = samples.withWatermark("sample_time_utc", late)
    by = rows.groupBy(F.window("sample_time_utc", width), "session_id", "driver_code")
    out = by.agg(F.count(F.lit(1)).alias("samples"), F.avg("speed_kmh").alias("avg_speed_kmh"), F.max("speed_kmh").alias("max_speed_kmh"), F.count_if((F.col("throttle_pct") <= 10) & (F.col("speed_kmh") >= 150)).alias("throttle_lifts"))
    return out.select("session_id", "driver_code", F.col("window.start").alias("window_start"), "samples", "avg_speed_kmh", "max_speed_kmh", "throttle_lifts")


def stream_degraded_segments(aligned: DataFrame, gap: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """Runs of a driver's rows that are not OK; a row exactly ``gap`` after the last one still belongs to its run."""
    rows = aligned.withColumn("family", quality_family(F.col("quality_flags"))).where("family <> 'OK'").withWatermark("sample_time_utc", late)
    out = rows.groupBy(F.session_window("sample_time_utc", gap), "session_id", "driver_code").agg(F.min("session_time_ms").alias("start_ms"), F.max("session_time_ms").alias("end_ms"), F.count(F.lit(1)).alias("samples"))
    return out.select("session_id", "driver_code", "start_ms", "end_ms", "samples")


def stream_dedupe(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each (session, driver, time); state is dropped with the watermark."""
    keys = ["session_id", "driver_code", "sample_time_utc"]
    if not samples.isStreaming:
        return samples.dropDuplicates(keys)
    return samples.withWatermark("sample_time_utc", late).dropDuplicatesWithinWatermark(keys)


def stream_pair_positions(samples: DataFrame, positions: DataFrame, within_ms: int = 500, late: str = "1 minute") -> DataFrame:
    """All pairs of a driver's samples and positions at most ``within_ms`` apart; both sides keep rows no longer than that and ``late``.

    Samples and positions meet in time slots, for a streaming join compares all rows of equal keys: a
    sample lies in one slot, a position is copied to those that its pairs can lie in, two at most.
    """
    # rows without a session or driver pair with none; a streaming join would hold them equal
    samples, positions = (df.where("session_id is not null and driver_code is not null") for df in (samples, positions))
    reach = int(within_ms) * 1000
    us, width = F.unix_micros("sample_time_utc"), max(4 * reach, 1000)
    slot = lambda t: F.floor(t / width)
    a = samples.withWatermark("sample_time_utc", late).select("session_id", "driver_code", slot(us).alias("slot"), F.col("sample_time_utc").alias("car_time"), F.col("source_sample_index").alias("car_index"))
    b = positions.withWatermark("sample_time_utc", late).select(F.col("session_id").alias("s2"), F.col("driver_code").alias("d2"), F.explode(F.sequence(slot(us - reach), slot(us + reach))).alias("slot2"), F.col("sample_time_utc").alias("place_time"), "x", "y")
    gap = F.expr(f"interval {int(within_ms)} milliseconds")
    on = (F.col("session_id") == F.col("s2")) & (F.col("driver_code") == F.col("d2")) & (F.col("slot") == F.col("slot2")) & (F.col("place_time") >= F.col("car_time") - gap) & (F.col("place_time") <= F.col("car_time") + gap)
    return a.join(b, on).drop("s2", "d2", "slot", "slot2")
