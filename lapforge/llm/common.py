"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the membership bitmaps that :func:`maybe_in` broadcasts: 2**23 bits are 2**17 words.
BITMAP_BITS = 1 << 23
#: Rows and bytes of a batch that crosses into Python: long texts must not add up.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Bytes of a batch where texts are encoded: each batch's distinct words are encoded once.
ENCODE_BYTES = 4 << 20
#: Characters of a plan's text that the driver keeps.
PLAN_CHARS = 10_000


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Small Arrow batches, so that a worker's memory does not depend on the length of texts; short plan texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    # the driver keeps the text of every plan, and some plans are long
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)


def tidy(run: Callable) -> Callable:
    """A function from batches to batches that gives free memory back when its task ends: workers are kept, and an executor's add up."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def documents(spark: SparkSession, sf_dir: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    prepare(spark, batch_bytes)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests on one machine) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lapforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lapforge/{name}-{uuid.uuid4().hex}"


def forget_later(spark: SparkSession, path: str) -> None:
    """The file system removes the path when the driver ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    forget_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Removes what :func:`materialize` has written, once nothing that is still to run reads it."""
    jvm = stored.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    at.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def input_partitions(df: DataFrame, least: int = 8) -> int:
    """Partitions that follow the input's size, as Spark splits its files."""
    return max(least, df.rdd.getNumPartitions())


def marked(df: DataFrame, key: str, ids: DataFrame, name: str = "_maybe") -> DataFrame:
    """``df`` with ``name``: whether the key's bit is set in a bitmap of fixed size over ``ids``."""
    at, word, bits = (free_name(df, x) for x in ("at", "word", "bits"))
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_BITS))
    words = (
        ids.select(bit.alias(at))
        .groupBy((F.col(at) / 64).cast("int").alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} % 64 as int))")).alias(bits))
    )
    found = df.withColumn(at, bit).withColumn(word, (F.col(at) / 64).cast("int"))
    # at most BITMAP_BITS / 64 rows of 12 bytes
    joined = found.join(F.broadcast(words), word, "left")
    return joined.withColumn(name, F.expr(f"coalesce(getbit({bits}, cast({at} % 64 as int)) = 1, false)")).drop(word, bits, at)


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids`` (same column name).

    A bitmap of fixed size is broadcast, so no key of ``ids`` is missed; a few others pass, and an
    exact join or filter has to follow. It keeps long rows out of that join's shuffle.
    """
    name = free_name(df, "maybe")
    return marked(df, key, ids, name).where(name).drop(name)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among ``ids``; rows with a null key stay. Only rows whose key may be among them are shuffled."""
    name = free_name(df, "maybe")
    rows = marked(df, key, ids, name)
    sure = rows.where(f"not {name}").drop(name)
    return sure.unionByName(rows.where(name).drop(name).join(ids.select(key).distinct(), key, "left_anti").select(df.columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), the smallest node's id.

    ``edges`` has two long columns ``a`` and ``b``. Large-star and small-star steps alternate, so the
    rounds grow with the logarithm of the longest chain; each is cut by a written table.
    Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    n = 0
    while True:
        n += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, f"{name}-{n}")
        # a forest of depth one does not change any more
        if after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            break
        now = after
    nodes = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
