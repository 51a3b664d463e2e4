"""Many k-means models at once against one at a time in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.operators import lloyd


def plain(x, hashes, k, seed, steps=20):
    """Starts, then steps, of one model."""
    c = np.zeros((0, x.shape[1]))
    for s in range(k):
        d = np.array([min(((p - q) ** 2).sum() for q in c) for p in x]) if s else np.ones(len(x))
        odds = [-np.log(u) / g if g > 0 else np.inf for u, g in zip(lloyd.uniform(hashes, seed, s), d)]
        first = min(range(len(x)), key=lambda i: (odds[i], hashes[i]))
        if not np.isfinite(odds[first]):
            break
        c = np.concatenate([c, x[first : first + 1]])
    for _ in range(steps):
        label = np.array([((p - c) ** 2).sum(axis=1).argmin() for p in x])
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        still = ((new - c) ** 2).sum(axis=1).max() <= 1e-8
        c = new
        if still:
            break
    return c, np.array([((p - c) ** 2).sum(axis=1).argmin() for p in x])


def plain_silhouette(x, label):
    out = []
    for i, p in enumerate(x):
        d = ((x - p) ** 2).sum(axis=1)
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[own].sum() / (own.sum() - 1), min(d[label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) + 6 * rng.normal(size=3) for _ in range(5)]) + 1000
    rows = [(f"p{i}", [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame([*rows, ("none", None), ("part", [1.0, None, 2.0]), ("nan", [1.0, float("nan"), 2.0])], "name string, features array<double>")


def test_models_equal_single_fits(spark, cloud):
    points = lloyd.prepared(cloud.repartition(5), "name")
    rows = points.collect()
    assert len(rows) == 300
    x, hashes, ids = np.array([r["features"] for r in rows]), np.array([r["hash"] for r in rows]), [r["id"] for r in rows]
    models = lloyd.fit(points, [lloyd.Model(k, seed) for k in (2, 5, 7) for seed in (1, 2)])
    lloyd.assess(points, models)
    found = {r["id"]: r for r in lloyd.labelled(points, models).collect()}
    for i, m in enumerate(models):
        c, label = plain(x, hashes, m.k, m.seed)
        assert np.allclose(m.centres, c) and [found[p]["labels"][i] for p in ids] == label.tolist()
        assert np.allclose([found[p]["distances"][i] for p in ids], np.sqrt(((x - c[label]) ** 2).sum(axis=1)))
        assert m.sizes == np.bincount(label, minlength=m.k).tolist() and np.isclose(m.inertia, ((x - c[label]) ** 2).sum())
        assert abs(m.silhouette - plain_silhouette(x, label)) < 1e-9
    # other partitions, the same fits
    again = lloyd.fit(lloyd.prepared(cloud.repartition(2), "name"), [lloyd.Model(m.k, m.seed) for m in models])
    assert all(np.allclose(a.centres, b.centres) for a, b in zip(models, again))


def test_jobs_follow_steps_and_not_models(spark, cloud):
    points = lloyd.prepared(cloud, "name")
    status = spark.sparkContext.statusTracker()

    def jobs(models):
        group = f"fit-{len(models)}"
        spark.sparkContext.setJobGroup(group, "")
        lloyd.fit(points, models, steps=4)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(status.getJobIdsForGroup(group))

    assert jobs([lloyd.Model(4, s) for s in range(12)]) <= 1.5 * jobs([lloyd.Model(4, 0)])


def test_few_points_and_one_cluster(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(6)], "i int, features array<double>")
    points = lloyd.prepared(rows, "i")
    models = lloyd.fit(points, [lloyd.Model(5, 1), lloyd.Model(1, 1)])
    lloyd.assess(points, models)
    assert sorted(map(tuple, models[0].centres)) == [(0, 0), (1, 0)] and models[0].silhouette == 1 and models[1].silhouette is None
    none = lloyd.fit(lloyd.prepared(rows.limit(0), "i"), [lloyd.Model(3, 1)])
    lloyd.assess(lloyd.prepared(rows.limit(0), "i"), none)
    assert len(none[0].centres) == 0 and none[0].silhouette is None


def test_draws_follow_squared_distances():
    """Starts fall on far points more often, as their squared distance says."""
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 3)
    x, n = np.array([0.0, 1.0, 3.0]), 4000
    won = np.bincount([int(np.argmin(-np.log(lloyd.uniform(hashes, s, 1))[1:] / x[1:] ** 2)) for s in range(n)], minlength=2)
    assert abs(won[1] / n - 0.9) < 0.02
