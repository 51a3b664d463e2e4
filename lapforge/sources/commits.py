"""Tables that change together: staged versions of sessions, and a list of commits that says which version counts.

A write goes to a folder of its own in each table and is listed last, by one small file. Readers join
the list, so they see all tables of a session change at once or not at all; what a lost write has left
is never read and can be removed.
"""

from __future__ import annotations

import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
#: One row a session and commit; of a session's rows the latest counts.
COMMIT_SCHEMA = "session_id string, version string, committed_ms long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The version of each session that counts: session_id, version, committed_ms. Empty where nothing is committed."""
    path = f"{root}/{COMMITS}"
    if not _exists(spark, path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    last = F.max(F.struct("committed_ms", "version")).alias("c")
    return spark.read.schema(COMMIT_SCHEMA).parquet(path).groupBy("session_id").agg(last).select("session_id", "c.version", "c.committed_ms")


def stage(tables: dict[str, DataFrame], root: str, sort: dict[str, list[str]] | None = None, version: str | None = None) -> str:
    """Writes the tables under a new version (or one more table under a given one) that no reader sees yet; returns the version.

    Each table is cut by ranges of session and its ``sort`` columns, so a large session is many tasks
    and files, and each file holds a short range of them. Ranges are found by a pass of their own, so
    rows are kept on the executors' disks until they are written, and derived once.
    """
    version = version or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        order = ["session_id", *(sort or {}).get(name, [])]
        held = df.storageLevel.useDisk or df.storageLevel.useMemory
        kept = df if held else df.persist(StorageLevel.DISK_ONLY)
        try:
            kept.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("session_id").parquet(f"{root}/{name}/version={version}")
        finally:
            if not held:
                kept.unpersist()
    return version


def commit(sessions: DataFrame, root: str, version: str) -> None:
    """Makes a staged version the one that counts for ``sessions`` (session_id), also for those without a row in any table."""
    rows = sessions.select("session_id").distinct()
    rows.select("session_id", F.lit(version).alias("version"), F.lit(time.time_ns() // 1_000_000).alias("committed_ms")).coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")


def replace_together(sessions: DataFrame, tables: dict[str, DataFrame], root: str, sort: dict[str, list[str]] | None = None) -> str:
    """Replaces the sessions' rows in all tables, at once for readers. Rows of other sessions in ``tables`` are an error of the caller."""
    version = stage(tables, root, sort)
    commit(sessions, root, version)
    return version


def read_committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the versions that count; filters on session_id prune its folders. ``schema``: its columns, session_id among them."""
    path = f"{root}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    columns = spark.createDataFrame([], schema).columns
    stored = spark.read.schema(f"{schema}, version string").parquet(path)
    return stored.join(commits(spark, root).select("session_id", "version"), ["session_id", "version"], "left_semi").select(columns)


def remove_unlisted(spark: SparkSession, root: str, names: list[str]) -> int:
    """Removes versions that count for no session: lost writes, and those that later commits replaced whole. No write may be under way."""
    kept = {r["version"] for r in commits(spark, root).select("version").distinct().toLocalIterator()}
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    removed = 0
    for name in names:
        if _exists(spark, f"{root}/{name}"):
            for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")):
                at = s.getPath()
                if at.getName().startswith("version=") and at.getName().removeprefix("version=") not in kept:
                    removed += files.delete(at, True)
    return removed
