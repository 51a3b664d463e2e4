"""Clusters of lap shapes read their laps, which are derived from all samples, once."""

import pytest
from pyspark.sql import functions as F

from lapforge.operators import clusters as M
from lapforge.operators.quality import BINS


@pytest.mark.parametrize("call", ["stability", "clusters"])
def test_laps_are_derived_once(spark, call):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    names = [*M.SHAPE_FEATURES, *BINS, "speed_shape_rms_kmh", "speed_shape_excess_kmh"]
    values = [((F.xxhash64("id", F.lit(n)) % 1000) / 10.0).alias(n) for n in dict.fromkeys(names)]
    flags = [(F.col("id") % 5 == k).alias(c) for k, c in enumerate(M.PROFILE) if c not in names]
    laps = spark.range(60).select(F.col("id").cast("string").alias("lap_id"), F.lit("valid").alias("primary_category"), *values, *flags)
    laps = laps.mapInArrow(count, laps.schema)
    if call == "stability":
        assert M.cluster_stability(laps, (2, 3), (1, 2)).count() == 4
    else:
        rows, profile = M.lap_shape_clusters(laps, 3, starts=2)
        assert rows.count() == 60 and sum(r["laps"] for r in profile.collect()) == 60
    assert read.value == 60
