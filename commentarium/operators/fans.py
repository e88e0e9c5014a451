"""Features of fans, their segments by k-means, and the rules that name segments."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentarium.functions.scalars import iso_week, whole_days
from commentarium.operators.sentiment import rounded
from commentarium.session import written

FEATURES = ("comment_count", "videos_commented", "avg_sentiment", "likes_earned", "recency", "consistency")
LOGGED = ("comment_count", "videos_commented", "likes_earned")
K_RANGE, FANS_PER_K, MIN_FANS, SEED, DEFAULT_K = range(2, 9), 8, 16, 42, 3
# The rules in their order; (feature, at least or at most, standard deviations).
RULES = (
    ("Advocates", (("likes_earned", ">=", 0.4), ("avg_sentiment", ">=", 0.3), ("recency", "<=", 0.3))),
    ("Engaged Critics", (("likes_earned", ">=", 0.4), ("avg_sentiment", "<=", -0.2))),
    ("Loyal Regulars", (("consistency", ">=", 0.3), ("avg_sentiment", ">=", -0.1), ("comment_count", ">=", 0.2))),
    ("Rising Stars", (("recency", "<=", -0.3), ("comment_count", ">=", 0.2), ("likes_earned", "<=", 0.3))),
    ("Lapsed Regulars", (("recency", ">=", 0.5), ("videos_commented", ">=", 0.2))),
    ("Casual Fans", (("comment_count", "<=", 0.2), ("avg_sentiment", ">=", -0.3))),
)
FALLBACK = "Needs Review"


def fan_features(scored: DataFrame) -> DataFrame:
    """One row per author and channel id, in one pass: counts, distinct videos and weeks, likes, days since the last comment, mean confident sentiment (0 if none)."""
    rows = scored.filter(F.col("author").isNotNull() & F.col("author_channel_id").isNotNull())
    end = rows.agg(F.max("published").alias("end"))
    sure = F.when(~F.col("sentiment_label").eqNullSafe("Uncertain"), F.col("sentiment_score"))
    per = rows.groupBy("author", "author_channel_id").agg(
        F.count("*").alias("comment_count"), F.countDistinct("video_id").alias("videos_commented"), F.sum("like_count").alias("likes_earned"),
        F.countDistinct(iso_week(F.col("published"))).alias("consistency"), F.max("published").alias("last"), F.avg(sure).alias("mean"),
    )
    days = F.greatest(F.coalesce(whole_days(F.col("end"), F.col("last")), F.lit(0)), F.lit(0)).cast("int")
    return per.join(F.broadcast(end)).select(
        "author", "author_channel_id", "comment_count", "videos_commented", "likes_earned", "consistency", days.alias("recency"),
        rounded(F.coalesce("mean", F.lit(0.0)), 4).alias("avg_sentiment"),
    )


def standard_scores(fans: DataFrame) -> DataFrame:
    """Adds z_ columns: population z-scores, of log(1 + x) for the skewed features; a constant feature gives 0."""
    logs = {f: F.log1p(F.greatest(F.coalesce(F.col(f), F.lit(0)), F.lit(0)).cast("double")) if f in LOGGED else F.coalesce(F.col(f), F.lit(0)).cast("double") for f in FEATURES}
    stats = fans.agg(*[F.avg(x).alias(f"m_{f}") for f, x in logs.items()], *[F.stddev_pop(x).alias(f"s_{f}") for f, x in logs.items()])
    wide = fans.join(F.broadcast(stats))
    z = {f"z_{f}": F.when(F.col(f"s_{f}") > 0, (x - F.col(f"m_{f}")) / F.col(f"s_{f}")).otherwise(0.0) for f, x in logs.items()}
    return wide.withColumns(z).drop(*[f"{p}_{f}" for p in "ms" for f in FEATURES])


def rule_label(prefix: str = "z_"):
    """The first rule that a row of z-scores meets."""
    out = None
    for label, conditions in RULES:
        test = F.lit(True)
        for feature, op, bound in conditions:
            c = F.col(prefix + feature)
            test = test & ((c >= bound) if op == ">=" else (c <= bound))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(FALLBACK)


def segment(fans: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fans with cluster and label, clusters, log of the k tried). k with the best silhouette, the first of equals, unless given.

    Fewer than ``MIN_FANS`` fans give no rows; fans that no k tells apart are fitted with ``DEFAULT_K``. Centres are found by k-means|| on the cluster; the silhouette is the simplified one, so both are linear in the rows.
    """
    spark = fans.sparkSession
    z = [f"z_{f}" for f in FEATURES]
    rows = written(standard_scores(fans).withColumn("features", array_to_vector(F.array(*z))).drop("features"), "fans")
    rows = rows.withColumn("features", array_to_vector(F.array(*z))).cache()
    n = rows.count()
    log, best, chosen = [], None, k or DEFAULT_K
    columns = "k int, silhouette double, inertia double, chosen boolean"
    if n < MIN_FANS:
        empty = rows.drop("features").withColumn("cluster_id", F.lit(0)).withColumn("cluster_label", F.lit("")).limit(0)
        rows.unpersist()
        return empty, cluster_records(empty), spark.createDataFrame([], columns)
    for tried in [k] if k else [x for x in K_RANGE if x <= n // FANS_PER_K]:
        model = KMeans(k=tried, seed=SEED, featuresCol="features").fit(rows)
        if sum(size > 0 for size in model.summary.clusterSizes) < 2:
            continue
        silhouette = ClusteringEvaluator(featuresCol="features").evaluate(model.transform(rows))
        log.append((tried, round(float(silhouette), 4), round(float(model.summary.trainingCost), 4)))
        if best is None or silhouette > best[0]:
            best, chosen = (silhouette, model), tried
    model = best[1] if best else KMeans(k=chosen, seed=SEED, featuresCol="features").fit(rows)
    tries = spark.createDataFrame([(*row, row[0] == chosen) for row in log], columns)
    rows.unpersist()
    placed = model.transform(rows).withColumnRenamed("prediction", "cluster_id").drop("features")
    means = placed.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in z]).withColumn("cluster_label", rule_label())
    placed = placed.join(F.broadcast(means.select("cluster_id", "cluster_label")), "cluster_id")
    return placed, cluster_records(placed), tries


def cluster_records(placed: DataFrame, examples: int = 5) -> DataFrame:
    """Per cluster: size, its share of all fans in per cent, mean sentiment, centre in the features' own units, the fans nearest to the centre."""
    z = [f"z_{f}" for f in FEATURES]
    own = [F.round(F.expm1(F.greatest(F.avg(F.log1p(F.col(f).cast("double"))), F.lit(0.0))) if f in LOGGED else F.avg(f), 3).alias(f"centre_{f}") for f in FEATURES]
    centres = placed.groupBy("cluster_id", "cluster_label").agg(F.count("*").alias("size"), rounded(F.avg("avg_sentiment"), 4).alias("mean_sentiment"), *own, *[F.avg(c).alias(f"m{c}") for c in z])
    apart = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in z), F.lit(0.0))
    order = Window.partitionBy("cluster_id").orderBy("apart", "author_channel_id")
    near = placed.join(F.broadcast(centres.select("cluster_id", *[f"m{c}" for c in z])), "cluster_id").withColumn("apart", apart).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= examples)
    tops = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "author"))), lambda x: x["author"]).alias("examples"))
    total = centres.agg(F.sum("size").alias("fans"))
    share = F.round(F.col("size") / F.col("fans") * 100 + 1e-9, 2)
    return centres.drop(*[f"m{c}" for c in z]).join(tops, "cluster_id").join(F.broadcast(total)).withColumn("fans_pct", share).drop("fans")
