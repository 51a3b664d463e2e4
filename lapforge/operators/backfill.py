"""Backfill of the distance grid and its quality reports into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import commits
from .grids import choose_sessions, lap_quality_report, project_distance_grid

#: Tables of a backfill, with what their files are ordered by within a session.
TABLES = {"lap_distance": ["driver_code", "lap_number", "distance_m"], "lap_quality": ["driver_code", "lap_number"]}


def run_backfill(
    root: str, sessions: DataFrame, drivers: DataFrame, samples: DataFrame, laps: DataFrame, positions: DataFrame, only_missing: bool = True, ids: list[str] | None = None, year: int | None = None, session_type: str | None = None,
    limit: int | None = None, step_m: float = 5.0, max_gap_ms: int = 1000, max_position_gap_ms: int = 1000, max_age_ms: int = 750, tolerance_ms: int = 100,
) -> DataFrame:
    """Stores the distance rows (with positions) and quality rows of chosen sessions: (session_id, distance_rows, quality_rows) of what was done.

    Both tables of a session are replaced together (:mod:`..sources.commits`): a run that is lost
    between them changes nothing that readers see, and the next run does its sessions again. With
    ``only_missing`` sessions that are committed already are left out, after ``limit`` has counted
    them. Sessions without drivers or laps are an error. Sessions are done together, not one after another.
    """
    spark = sessions.sparkSession
    chosen = choose_sessions(sessions, ids, year, session_type, limit).select("session_id")
    if only_missing:
        chosen = chosen.join(commits.commits(spark, root).select("session_id"), "session_id", "left_anti")
    # the list is one row a session; kept, so that what is committed is what was written
    chosen = spark.createDataFrame(chosen.distinct().collect(), "session_id string")
    parents = drivers.select("session_id").distinct().join(laps.select("session_id").distinct(), "session_id")
    bare = chosen.join(parents, "session_id", "left_anti").limit(10).collect()
    if bare:
        raise ValueError(f"sessions without drivers or laps: {sorted(r['session_id'] for r in bare)}")
    # without the hint, all rows of a session would meet in one task
    s, l, p = (df.join(F.broadcast(chosen), "session_id", "left_semi") for df in (samples, laps, positions))
    grid = project_distance_grid(s, l, p, step_m, max_gap_ms, max_age_ms, max_position_gap_ms)
    version = commits.stage({"lap_distance": grid}, root, TABLES)
    # the report reads the distance rows that are stored
    stored = spark.read.schema(grid.schema).parquet(f"{root}/lap_distance/version={version}")
    quality = lap_quality_report(s, l, stored, max_gap_ms, max_age_ms, tolerance_ms)
    commits.stage({"lap_quality": quality}, root, TABLES, version)
    commits.commit(chosen, root, version)
    written = spark.read.schema(quality.schema).parquet(f"{root}/lap_quality/version={version}")
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    done = chosen.join(count(stored, "distance_rows"), "session_id", "left").join(count(written, "quality_rows"), "session_id", "left")
    return done.fillna(0, ["distance_rows", "quality_rows"])
