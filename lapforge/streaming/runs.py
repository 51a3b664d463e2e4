"""Running streams over files: a folder of arrivals in, a folder of results out, state and progress in a checkpoint.

Every run takes what has arrived since the last one and stops; the checkpoint says where it was, so a
run that is lost is done again and no arrival counts twice. Results go to Spark's file sink, whose own
list of batches is what readers follow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time of the row that closes all windows of an input that has ended.
END = "9999-01-01 00:00:00"


def arrive(rows: DataFrame, folder: str) -> None:
    """Adds rows to a folder of arrivals: whole files, which appear at once."""
    rows.write.mode("append").parquet(folder)


def arrivals(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """A folder of arrivals as a stream; ``files_a_batch`` bounds what one micro-batch takes."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder)


def close(spark: SparkSession, folder: str, schema: str, time: str = "sample_time_utc") -> None:
    """Ends an input: one row at END, nulls otherwise, lifts the watermark over everything before it. Its own windows never close; plans that give rows out at once do give out this one, and need no end."""
    empty = spark.createDataFrame([], schema)
    row = spark.range(1).select(*(F.lit(END if c == time else None).cast(kind).alias(c) for c, kind in empty.dtypes))
    arrive(row, folder)


@dataclass
class Run:
    """What one run did: micro-batches, rows in, rows that came too late for their window, rows in the state afterwards."""

    batches: int
    rows: int
    late: int
    state: int


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> Run:
    """Takes all that has arrived, in as many micro-batches as the source makes of it, and stops."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = query.recentProgress
    operators = [o for p in done for o in p["stateOperators"]]
    last = done[-1]["stateOperators"] if done else []
    return Run(len({p["batchId"] for p in done}), sum(p["numInputRows"] for p in done), sum(o["numRowsDroppedByWatermark"] for o in operators), sum(o["numRowsTotal"] for o in last))


def results(spark: SparkSession, sink: str, schema) -> DataFrame:
    """What all runs have written; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)


def replay(inputs: dict[str, DataFrame], plan: Callable[..., DataFrame], folder: str, parts: int = 3, time: str = "sample_time_utc", closing: bool = True) -> DataFrame:
    """Stored tables as streams: rows arrive in ``parts`` slices by time, each is run through ``plan`` with the state of those before, and the results are returned.

    ``plan`` takes one stream for each of ``inputs``. Slices are cut at equal times, the same for all
    inputs. With ``closing`` the inputs end after the last slice, so that open windows are given out.
    """
    spark = next(iter(inputs.values())).sparkSession
    at = {k: f"{folder}/arrivals-{k}" for k in inputs}
    schemas = {k: ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) for k, df in inputs.items()}
    ends = [df.select(F.min(F.unix_micros(time)).alias("a"), F.max(F.unix_micros(time)).alias("b")).first() for df in inputs.values()]
    ends = [e for e in ends if e["a"] is not None]
    low, high = min((e["a"] for e in ends), default=0), max((e["b"] for e in ends), default=0) + 1
    cut = lambda n: low + (high - low) * n // parts
    for part in range(parts + closing):
        for k, df in inputs.items():
            if part == parts:
                close(spark, at[k], schemas[k], time)
            else:
                arrive(df.where((F.unix_micros(time) >= cut(part)) & (F.unix_micros(time) < cut(part + 1))), at[k])
        stream = plan(*(arrivals(spark, at[k], schemas[k]) for k in inputs))
        run_available(stream, f"{folder}/results", f"{folder}/checkpoint")
    return results(spark, f"{folder}/results", stream.schema)
