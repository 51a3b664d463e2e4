"""k-means of many models at once: one pass over the points a step, whatever the number of models.

Starts are k-means++ by keyed hashing, so they depend on the points and a seed alone, not on how the
points lie in partitions. A step is one aggregation of counts and sums by model and cluster; models
that no longer move leave. Silhouettes (squared Euclidean) come from clusters' sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


@dataclass
class Model:
    """One set of centres: k, seed, its centres (rows), steps taken, and after :func:`assess` sizes, inertia and silhouette."""

    k: int
    seed: int
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    steps: int = 0
    moving: bool = True
    sizes: list[int] = field(default_factory=list)
    inertia: float = 0.0
    silhouette: float | None = None


def uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) by hashed id, seed and step."""
    key = ((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK) | 1
    h = ids.astype(np.uint64) ^ np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def prepared(points: DataFrame, id_col: str, features_col: str = "features") -> DataFrame:
    """(id, hash, features): the columns that the steps read. Points with a null vector, or a null in it, are left out."""
    whole = F.col(features_col).isNotNull() & ~F.exists(features_col, lambda v: v.isNull() | F.isnan(v))
    return points.where(whole).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("hash"), F.col(features_col).cast("array<double>").alias("features"))


def start(points: DataFrame, models: list[Model]) -> None:
    """First centres: at each step every model draws one more point, with odds by its squared distance to the nearest centre so far.

    A draw is the least -ln(u) / distance over all points, with u by hash, so all models draw in one
    aggregation. With fewer distinct points than centres a model keeps those that there are.
    """
    for step in range(max((m.k for m in models), default=0)):
        asked = [(i, m) for i, m in enumerate(models) if m.k > step and len(m.centres) == step]

        def draw(batches: Iterator[pa.RecordBatch], asked=asked, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                if not len(batch):
                    continue
                x, hashes = _matrix(batch), batch.column("hash").to_numpy()
                for i, m in asked:
                    d = gaps(x, m.centres).min(axis=1) if step else np.ones(len(x))
                    odds = np.where(d > 0, -np.log(uniform(hashes, m.seed, step)) / np.maximum(d, 1e-300), np.inf)
                    at = np.lexsort((hashes, odds))[0]
                    if np.isfinite(odds[at]):
                        found = (float(odds[at]), int(hashes[at]), x[at].tolist())
                        best[i] = min(best.get(i, found), found)
            if best:
                rows = [(i, *b) for i, b in sorted(best.items())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["model", "odds", "hash", "features"])

        drawn = points.select("hash", "features").mapInArrow(draw, "model int, odds double, hash long, features array<double>")
        # one row a model
        for r in drawn.groupBy("model").agg(F.min_by("features", F.struct("odds", "hash", "features")).alias("f")).collect():
            m, own = models[r["model"]], np.array([r["f"]])
            m.centres = np.concatenate([m.centres, own]) if step else own


def sums(points: DataFrame, models: list[Model]) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """By model and cluster: points, and about the centre the sum of them and of their squared lengths. One pass for all models."""
    asked = [(i, m.centres) for i, m in enumerate(models) if len(m.centres)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            for i, centres in asked:
                d = gaps(x, centres)
                label = d.argmin(axis=1)
                own = np.zeros((len(centres), x.shape[1] + 2))
                np.add.at(own, label, np.concatenate([np.ones((len(x), 1)), d.min(axis=1)[:, None], x - centres[label]], axis=1))
                total[i] = total.get(i, 0) + own
        rows = [(i, c, v.tolist()) for i, t in total.items() for c, v in enumerate(t)]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["model", "cluster", "v"])

    # (dimensions + 2) numbers a cluster, whatever the number of points
    added = points.select("features").mapInArrow(add, "model int, cluster int, v array<double>").select("model", "cluster", F.posexplode("v").alias("i", "v"))
    out: dict[tuple[int, int], dict[int, float]] = {}
    for r in added.groupBy("model", "cluster", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r["model"], r["cluster"]), {})[r["i"]] = r["v"]
    return {k: (round(v[0]), np.array([v[i] for i in range(2, len(v))]), v[1]) for k, v in out.items()}


def step(points: DataFrame, models: list[Model], tolerance: float = 1e-4) -> None:
    """Moves the centres of all models that still move to their clusters' means. A centre without points stays."""
    moving = [m for m in models if m.moving and len(m.centres)]
    found = sums(points, moving)
    for i, m in enumerate(moving):
        new = np.array([m.centres[c] + (found[i, c][1] / found[i, c][0] if found.get((i, c), (0,))[0] else 0) for c in range(len(m.centres))])
        m.moving = bool(((new - m.centres) ** 2).sum(axis=1).max() > tolerance**2)
        m.centres, m.steps = new, m.steps + 1


def fit(points: DataFrame, models: list[Model], steps: int = 20, tolerance: float = 1e-4) -> list[Model]:
    """Fits all models to the same points (:func:`prepared`): as many passes as centres and steps, not as models."""
    start(points, models)
    for _ in range(steps):
        if not any(m.moving and len(m.centres) for m in models):
            break
        step(points, models, tolerance)
    return models


def labelled(points: DataFrame, models: list[Model]) -> DataFrame:
    """(id, labels, distances): each point's cluster in every model and its distance to that centre, as arrays in the models' order."""
    asked = [m.centres for m in models]
    kind = points.schema["id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = [gaps(_matrix(batch), c) for c in asked]
                labels, near = np.stack([x.argmin(axis=1) for x in d], axis=1), np.sqrt(np.stack([x.min(axis=1) for x in d], axis=1))
                yield pa.record_batch([batch.column("id"), pa.array(labels.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(near.tolist(), pa.list_(pa.float64()))], ["id", "labels", "distances"])

    return points.select("id", "features").mapInArrow(label, f"id {kind}, labels array<int>, distances array<double>")


def silhouettes(x: np.ndarray, centres: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Silhouette of rows by squared Euclidean distance, from each cluster's points and their sums about its centre. Single points and single clusters: 0."""
    own, some, d = np.arange(len(x)), n > 0, gaps(x, centres)
    label = d.argmin(axis=1)
    # the mean squared distance to a cluster's points
    shift = np.stack([(x - c) @ t for c, t in zip(centres, total / np.maximum(n, 1)[:, None])], axis=1)
    mean = np.maximum(d + (squares / np.maximum(n, 1))[None, :] - 2 * shift, 0)
    inner = mean[own, label] * n[label] / np.maximum(n[label] - 1, 1)
    mean[:, ~some] = np.inf
    mean[own, label] = np.inf
    outer = mean.min(axis=1)
    both = np.maximum(inner, outer)
    good = (n[label] > 1) & np.isfinite(outer) & (both > 0)
    return np.where(good, (outer - inner) / np.where(good, both, 1), 0.0)


def assess(points: DataFrame, models: list[Model]) -> None:
    """Fills in sizes, inertia and the mean silhouette of every model in two passes. A model of one cluster has no silhouette."""
    found = sums(points, models)
    d = next((len(v[1]) for v in found.values()), 0)
    tables = []
    for i, m in enumerate(models):
        rows = [found.get((i, c), (0, np.zeros(d), 0.0)) for c in range(len(m.centres))]
        n, total, squares = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        tables.append((m.centres, n, total, squares))
        m.sizes = n.tolist()
        m.inertia = float(squares.sum())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, rows = np.zeros(len(tables)), 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                rows += len(x)
                added += [silhouettes(x, c, n, t, q).sum() if len(c) else 0.0 for c, n, t, q in tables]
        yield pa.record_batch([pa.array(range(len(tables)), pa.int32()), pa.array(added), pa.array([rows] * len(tables))], ["model", "s", "n"])

    for r in points.select("features").mapInArrow(judge, "model int, s double, n long").groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        m = models[r["model"]]
        m.silhouette = r["s"] / r["n"] if r["n"] and sum(k > 0 for k in m.sizes) > 1 else None
