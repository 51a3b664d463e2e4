"""Exact percentiles of groups of any size: a sketch brackets each rank, a second pass counts and picks within the bracket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's rows are dealt to where they meet their brackets.
PARTS = 16


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Per group the percentiles of ``value`` (name -> share of 0 to 1), linear between the two nearest ranks, as ``percentile`` gives them.

    No group's values are held at once. A sketch of ``accuracy`` finds two values that a rank surely
    lies between, about a share of 4 / ``accuracy`` of the group apart; the distinct values in there are
    counted, and those below. Groups up to ``accuracy`` rows are counted whole. Null values and NaN
    are left out, groups without any other have no row; without ``by`` there is one row in any case.
    ``by`` columns may be null.
    """
    by, names = list(by), list(shares)
    valid = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    # the sketch is off by a share of 1 / accuracy at most
    margin = 2.0 / accuracy
    cuts = [min(max(p + side * margin, 0.0), 1.0) for p in shares.values() for side in (-1, 1)]
    q = F.percentile_approx("_v", [float(c) for c in cuts], accuracy)
    sketch = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), q.alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = F.col("_n") <= accuracy
    rank = [(F.col("_n") - 1) * F.lit(float(p)) for p in shares.values()]
    low = F.array(*(F.when(whole | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_q")[2 * i]) for i, p in enumerate(shares.values())))
    high = F.array(*(F.when(whole | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]) for i, p in enumerate(shares.values())))
    asked = sketch.select(*by, F.array(*rank).alias("_rank"), low.alias("_low"), high.alias("_high"))
    # rows of one large group meet their brackets in several parts
    part = F.pmod(F.xxhash64("_v"), F.lit(PARTS))
    keys = [F.coalesce(F.xxhash64(*by), F.lit(0)).alias("_g")] if by else [F.lit(0).alias("_g")]
    left = valid.select("*", part.alias("_part"), *keys)
    right = asked.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_low", "_high", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part"))
    same = (F.col("l._g") == F.col("r._g")) & (F.col("l._part") == F.col("r._part"))
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r._by_{c}"))
    met = left.alias("l").join(right.alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in by), "_v", "_low", "_high")
    # below a bracket: counted together; inside: by value
    place = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("_v") <= F.element_at("_high", i + 1))
    cells = met.select(*by, "_v", "_low", F.explode(place).alias("_i"))
    cells = cells.withColumn("_cell", F.when(F.col("_v") >= F.element_at("_low", F.col("_i") + 1), F.col("_v"))).groupBy(*by, "_i", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*by, "_i").orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_to", F.sum("_c").over(run)).where("_cell is not null")
    named = asked.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.posexplode("_rank").alias("_j", "_rank"))
    same = F.col("_i") == F.col("_j")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    at = F.floor("_rank")
    # the first values whose running count exceeds the rank, and the one after it
    picked = cells.join(named, same).groupBy(*by, "_i").agg(F.min(F.when(F.col("_to") > at, F.col("_cell"))).alias("_a"), F.min(F.when(F.col("_to") > at + 1, F.col("_cell"))).alias("_b"), F.first("_rank").alias("_rank"))
    share = F.col("_rank") - at
    picked = picked.withColumn("_p", F.when(share > 0, (at + 1 - F.col("_rank")) * F.col("_a") + share * F.col("_b")).otherwise(F.col("_a")))
    return picked.groupBy(*by).agg(*(F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(name) for i, name in enumerate(names)))
