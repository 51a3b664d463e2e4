"""Text and lap clusters with Spark ML, and how stable they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Imputer, NGram, Normalizer, RegexTokenizer, RobustScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import normalize_message_text
from ..sources.tables import shared_path
from . import lloyd
from .quality import BINS, with_taxonomy


def cluster_messages(messages: DataFrame, k: int = 10, seed: int = 42, vocabulary: int = 20_000) -> DataFrame:
    """Messages (race_control_message_id, message) with cluster_id and cluster_terms.

    TF-IDF of one- and two-word terms of the text without numbers, at least in two messages, then
    k-means with at most as many clusters as there are distinct texts; terms are a centre's six
    heaviest. Blank messages are left out. With fewer than two texts, or no shared term, each distinct
    text is a cluster, numbered by its hash.
    """
    rows = messages.withColumn("text", normalize_message_text(F.col("message"))).where("text <> ''").select("race_control_message_id", "text")
    distinct = rows.select("text").distinct()
    n = distinct.limit(k).count()
    if n >= 2:
        stages = [
            RegexTokenizer(inputCol="text", outputCol="all", pattern=r"[^a-z0-9]+", minTokenLength=2),
            StopWordsRemover(inputCol="all", outputCol="one"),
            NGram(n=2, inputCol="one", outputCol="two"),
        ]
        terms = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("terms", F.concat("one", "two"))
        if not terms.select(F.explode("terms").alias("t"), "race_control_message_id").distinct().groupBy("t").count().where("count >= 2").isEmpty():
            counted = CountVectorizer(inputCol="terms", outputCol="counts", minDF=2, vocabSize=vocabulary).fit(terms)
            weigh = Pipeline(stages=[IDF(inputCol="counts", outputCol="weights"), Normalizer(inputCol="weights", outputCol="features"), KMeans(k=max(2, min(k, n)), seed=seed, predictionCol="cluster_id")])
            vectors = counted.transform(terms)
            model = weigh.fit(vectors)
            names = [", ".join(counted.vocabulary[i] for i in sorted(range(len(c)), key=lambda i: (-c[i], counted.vocabulary[i]))[:6]) for c in model.stages[-1].clusterCenters()]
            labels = F.array(*map(F.lit, names))
            return model.transform(vectors).select("race_control_message_id", "text", F.col("cluster_id").cast("long").alias("cluster_id"), F.element_at(labels, F.col("cluster_id") + 1).alias("cluster_terms"))
    # fewer texts than clusters or no shared term: a text's hash names its cluster, however many there are
    return rows.select("race_control_message_id", "text", F.xxhash64("text").alias("cluster_id"), F.col("text").alias("cluster_terms"))


def message_cluster_summary(messages: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: messages, sessions, labels, and the share that names a driver or a lap."""
    rows = with_taxonomy(messages).join(clusters, "race_control_message_id")
    pct = lambda c: 100.0 * F.count_if(F.col(c).isNotNull()) / F.count(F.lit(1))
    return rows.groupBy("cluster_id").agg(F.first("cluster_terms").alias("cluster_terms"), F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"), F.array_join(F.array_sort(F.collect_set("taxonomy")), ",").alias("taxonomies"), pct("racing_number").alias("driver_scoped_pct"), pct("lap_number").alias("lap_scoped_pct"))


#: What lap shapes are clustered by, besides the speed bins (fixed names).
SHAPE_FEATURES = ["lap_time_ms", "car_samples", "position_samples", "car_coverage_ratio", "car_p95_gap_ms", "car_max_gap_ms", "position_path_ratio", "position_max_segment_units", "speed_shape_rms_kmh", "telemetry_null_rate", "position_null_rate", "safety_car_periods", "virtual_safety_car_periods", "red_flag_periods"]


#: What the profile of clusters tells of its laps, besides the features.
PROFILE = ["bad_lap_any_category", "speed_shape_rms_kmh", "pit_lane_or_safety_car_influenced", "import_or_source_data_anomaly", "position_trace_discontinuity"]


def _kept(laps: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``laps``, written once: laps are derived from all samples, and every fit and pass reads them."""
    out, path = laps.select(*dict.fromkeys(columns)), shared_path(laps.sparkSession, "laps")
    out.write.parquet(path)
    return laps.sparkSession.read.schema(out.schema).parquet(path)


@dataclass
class Shapes:
    """points: (id, hash, features) of laps; plane: (lap_id, component_1, component_2); explained: shares of variance of the two components."""

    points: DataFrame
    plane: DataFrame
    explained: tuple[float, float]


def lap_shapes(laps: DataFrame) -> Shapes:
    """Laps as scaled vectors: missing and infinite values take the column's median, columns are centred and divided by their quartile range (those without one are 0), columns without any value are left out."""
    names = [*SHAPE_FEATURES, *BINS]
    fine = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c)
    rows = laps.select("lap_id", *map(fine, names))
    known = rows.agg(*(F.count(c).alias(c) for c in names)).first()
    used = [c for c in names if known[c]]
    steps = [
        Imputer(strategy="median", inputCols=used, outputCols=[f"{c}_f" for c in used]),
        VectorAssembler(inputCols=[f"{c}_f" for c in used], outputCol="raw"),
        RobustScaler(withCentering=True, inputCol="raw", outputCol="scaled"),
        PCA(k=2, inputCol="scaled", outputCol="plane"),
    ]
    model = Pipeline(stages=steps).fit(rows)
    # written once, read by every pass
    path = shared_path(laps.sparkSession, "shapes")
    plane = vector_to_array("plane")
    out = model.transform(rows).select("lap_id", vector_to_array("scaled").alias("features"), plane[0].alias("component_1"), plane[1].alias("component_2"))
    out.write.parquet(path)
    stored = laps.sparkSession.read.schema(out.schema).parquet(path)
    return Shapes(lloyd.prepared(stored, "lap_id"), stored.select("lap_id", "component_1", "component_2"), tuple(map(float, model.stages[-1].explainedVariance)))


def lap_shape_clusters(laps: DataFrame, k: int = 7, seed: int = 0, starts: int = 20) -> tuple[DataFrame, DataFrame]:
    """Classified laps with their shape's cluster, and a profile of the clusters. Of ``starts`` fits the one of least inertia counts.

    Laps: cluster_id, component_1, component_2 and distance_to_centre beside lap_id, primary_category
    and speed_shape_excess_kmh. Profile: laps, shares (per cent) that are flagged, in the pit lane or
    under a safety car, of anomalous source, with jumps in position; medians of shape rms, lap time
    and coverage; and for all clusters alike the silhouette and the shares of variance in the plane.
    """
    laps = _kept(laps, ["lap_id", "primary_category", "speed_shape_excess_kmh", *SHAPE_FEATURES, *BINS, *PROFILE])
    shapes = lap_shapes(laps)
    models = lloyd.fit(shapes.points, [lloyd.Model(k, seed * starts + i) for i in range(starts)])
    lloyd.assess(shapes.points, models)
    best = min(models, key=lambda m: (m.inertia, m.seed))
    own = lloyd.labelled(shapes.points, [best]).select(F.col("id").alias("lap_id"), F.col("labels")[0].alias("cluster_id"), F.col("distances")[0].alias("distance_to_centre"))
    out = laps.join(own, "lap_id").join(shapes.plane, "lap_id")
    return out.select("lap_id", "primary_category", "speed_shape_excess_kmh", "cluster_id", "component_1", "component_2", "distance_to_centre"), cluster_profile(laps, own, best.silhouette, shapes.explained)


def cluster_profile(laps: DataFrame, labels: DataFrame, silhouette: float | None, explained: tuple[float, float]) -> DataFrame:
    """Per cluster of ``labels`` (lap_id, cluster_id) what its laps are like."""
    pct = lambda c: (100.0 * F.avg(F.col(c).cast("double")))
    by = laps.join(labels.select("lap_id", "cluster_id"), "lap_id").groupBy("cluster_id")
    out = by.agg(
        F.count(F.lit(1)).alias("laps"),
        pct("bad_lap_any_category").alias("bad_pct"),
        F.median("speed_shape_rms_kmh").alias("median_shape_rms"),
        F.median("lap_time_ms").alias("median_lap_time_ms"),
        F.median("car_coverage_ratio").alias("median_car_coverage"),
        pct("pit_lane_or_safety_car_influenced").alias("pit_sc_pct"),
        pct("import_or_source_data_anomaly").alias("source_anomaly_pct"),
        pct("position_trace_discontinuity").alias("position_discontinuity_pct"),
    )
    return out.withColumns({"pca_variance_1": F.lit(explained[0]), "pca_variance_2": F.lit(explained[1]), "silhouette": F.lit(silhouette).cast("double")})


def cluster_exemplars(clusters: DataFrame) -> DataFrame:
    """Per cluster: the lap nearest to the centre, the most severe one, and one of its most common category."""
    common = clusters.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id", "primary_category")))
    picks = {"nearest_centre": (clusters, [F.col("distance_to_centre")]), "most_severe": (clusters, [F.desc("speed_shape_excess_kmh")]), "common_category": (common, [F.desc("_n"), F.col("primary_category"), F.col("distance_to_centre")])}
    parts = [df.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order, "lap_id"))).where("_r = 1").select(F.lit(name).alias("exemplar"), "cluster_id", "lap_id", "primary_category") for name, (df, order) in picks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def adjusted_rand(labels: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows, from their contingency table; ``by``: of each group."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by = list(by)
    cells = labels.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias(name))
    both = cells.groupBy(*by).agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    # without groups, three rows of one
    one = both.join(side(a, "x"), by).join(side(b, "y"), by) if by else both.crossJoin(side(a, "x")).crossJoin(side(b, "y"))
    expected, most = F.expr("x * y / nullif(n * (n - 1) / 2, 0)"), F.expr("(x + y) / 2")
    return one.select(*by, F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def cluster_stability(laps: DataFrame, ks: tuple[int, ...] = (5, 6, 7, 8, 9), seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per number of clusters and seed: silhouette, and the adjusted Rand index against the first seed. All models are fitted together."""
    points = lap_shapes(_kept(laps, ["lap_id", *SHAPE_FEATURES, *BINS])).points
    models = lloyd.fit(points, [lloyd.Model(k, seed) for k in ks for seed in seeds])
    lloyd.assess(points, models)
    at = {(m.k, m.seed): i for i, m in enumerate(models)}
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(seed).alias("seed"), F.col("labels")[at[k, seeds[0]]].alias("a"), F.col("labels")[at[k, seed]].alias("b")) for k in ks for seed in seeds))
    pairs = lloyd.labelled(points, models).select(F.explode(each).alias("x")).select("x.*")
    rand = {(r["k"], r["seed"]): r["ari"] for r in adjusted_rand(pairs, "a", "b", ["k", "seed"]).collect()}
    return laps.sparkSession.createDataFrame([(m.k, m.seed, m.silhouette, rand.get((m.k, m.seed))) for m in models], "k int, seed int, silhouette double, ari double")
