"""Embedding whitening with a covariance by polarisation.

Entries become whole numbers, so the sums of squares of every dimension and of every sum of two
dimensions are exact. Half of what the second exceeds the first by is the covariance of the two. Each
task squares its own rows, Spark adds the tasks' sums up, and only as many numbers as pairs of
dimensions reach the driver, where the eigenvectors are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Whole steps that an entry's unit is cut into.
SCALE = 256
#: Components returned.
COMPONENTS = 4
#: A component counts from this share of the largest eigenvalue on, times the dimensions: less is rounding.
LEAST_SHARE = 2.0**-52
#: Exact sums travel as decimals of so many digits.
DIGITS = 38


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, as long. Null where the vector is null or empty, or an entry is null, not finite or too large for a long."""
    largest = 2.0**63 / scale
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < largest))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def square_sums(centred: np.ndarray) -> list[int]:
    """Sums over the rows of the squares of every column i, and then of every sum of two columns i < j, exactly.

    ``centred``: whole numbers, of 64 bits or as Python's own. Numbers too large to be squared in 64
    bits are split into a high and a low half, whose three products are summed by themselves.
    """
    d = centred.shape[1]
    most = 2 * int(np.abs(centred).max()) if centred.size else 0
    if most >= 1 << 60:  # beyond what two halves hold
        parts = [centred.astype(object)]
        rows = len(centred)
        half = 0
    elif most * most * len(centred) < 1 << 62:
        parts, rows, half = [centred.astype(np.int64)], len(centred), 0
    else:
        half = most.bit_length() // 2
        low = centred.astype(np.int64) & ((1 << half) - 1)
        parts = [centred.astype(np.int64) >> half, low]
        # either half of a sum of two is below 2 ** (bits - half + 1)
        rows = max(1, (1 << 62) >> 2 * (most.bit_length() - half + 1))
    total = [0] * (d * (d + 1) // 2)
    for at in range(0, len(centred), max(rows, 1)):
        block = [p[at : at + rows] for p in parts]
        k = 0
        for i in range(-1, d):
            # first the columns themselves, then each with those behind it
            pairs = block if i < 0 else [p[:, i : i + 1] + p[:, i + 1 :] for p in block]
            if len(pairs) == 1:
                sums = (pairs[0] * pairs[0]).sum(axis=0).tolist()
            else:
                high, low = pairs
                sums = [(int(a) << 2 * half) + (int(b) << half + 1) + int(c) for a, b, c in zip((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))]
            for s in sums:
                total[k] += int(s)
                k += 1
    return total


def rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A batch's vectors of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where that is enough."""
    most = int(np.abs(x.astype(object)).max()) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


class Fit:
    """What whitening needs: n, sums (exact), values and vectors (columns) by falling eigenvalue, and the trace."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        d = len(sums)
        self.n, self.sums = n, sums
        cov = np.zeros((d, d))
        k = d
        for i in range(d):
            cov[i, i] = squares[i] / n**3  # n * x - sums is n times the centred value
            for j in range(i + 1, d):
                cov[i, j] = cov[j, i] = (squares[k] - squares[i] - squares[j]) / (2 * n**3)
                k += 1
        self.covariance = cov
        values, vectors = np.linalg.eigh(cov)
        self.values, self.vectors = values[::-1], vectors[:, ::-1]
        self.trace = sum(squares[:d]) / n**3
        self.rank = int((self.values > max(self.values[0], 0) * LEAST_SHARE * d).sum())

    def whitened(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The centred rows (exact, times n), and their whitened first ``k`` components."""
        own = centre(x, self.n, self.sums)
        return own, (own / self.n).astype(np.float64) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(listed: DataFrame) -> Fit:
    """Fit over the vectors of the column ``x`` (whole numbers, one length), of which there is one at least."""
    unit = f"decimal({DIGITS},0)"
    # d sums and a count, from as many rows a task
    sums = listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = sums[0]["n"], [int(r["s"]) for r in sorted(sums)]

    @common.tidy
    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = square_sums(centre(rows_of(batch, "x"), n, sums))
                total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(DIGITS, 0))], ["k", "s"])

    squares = listed.mapInArrow(squared, f"k int, s {unit}").groupBy("k").agg(F.sum("s").alias("s"))
    return Fit(n, sums, [int(r["s"]) for r in sorted(squares.collect())])


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every vector's first components, whitened: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(``scale`` * entry). The fit list is each distinct x once: ``n`` of them.
    ``deviation`` is the sum over the dimensions of (n * x - sums)^2, exact, as decimal(38,0).
    ``component`` counts from 1 by falling eigenvalue of the fit list's covariance (divisor n);
    ``whitened`` is the centred x along it, over the eigenvalue's root; ``explained`` is its share of
    the trace. ``identity_error`` is measured: the largest entry of the fit list's whitened
    covariance minus the identity.

    Left out are vectors that are null or empty, that hold null, not finite or entries beyond a long,
    and those of another length than the most frequent one among the rest (of equally frequent ones
    the longest). Components without variance are left out: equal vectors alone give an empty result,
    as does an empty table. Repeated rows and rows with a null id stay; rows of one id are not merged.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).where("x is not null")
    rows = common.materialize(rows, "vectors")
    # as many rows as there are lengths
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == usual["d"])
    listed = common.materialize(rows.select("x").distinct(), "fit")
    found = fit(listed)
    k = min(components, found.rank)
    if not k:
        return spark.createDataFrame([], schema)

    @common.tidy
    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                w = found.whitened(rows_of(batch, "x"), k)[1]
                yield pa.record_batch([pa.array([len(w)]), pa.array([w.sum(axis=0).tolist()]), pa.array([(w.T @ w).ravel().tolist()])], ["n", "first", "second"])

    moments = listed.mapInArrow(second_moments, "n long, first array<double>, second array<double>")
    n, *sums = moments.select(F.sum("n"), *[F.sum(F.col("first")[i]) for i in range(k)], *[F.sum(F.col("second")[i]) for i in range(k * k)]).first()
    mean, second = np.array(sums[:k]) / n, np.array(sums[k:]).reshape(k, k) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    @common.tidy
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, w = found.whitened(rows_of(batch, "x"), k)
            big = own.dtype == object or int(np.abs(own).max()) ** 2 * own.shape[1] >= 1 << 62
            squares = own.astype(object) if big else own
            deviation = [Decimal(int(v)) for v in (squares * squares).sum(axis=1)]
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(batch)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                    pa.array(np.full(len(batch) * k, found.n)),
                    pa.array([v for v in deviation for _ in range(k)], pa.decimal128(DIGITS, 0)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(found.values[:k] / found.trace, len(batch))),
                    pa.array(np.full(len(batch) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(projected, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """All embeddings along their first four components."""
    common.prepare(spark)
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
