"""Topics of comments: vectors, reduced, grouped, named by the words that set each group apart."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentarium.functions.scalars import topic_label
from commentarium.operators.terms import STOPWORDS
from commentarium.session import written

DIMENSIONS, TOPICS, SMALLEST, SEED = 10, 25, 20, 42
HASHED = 512
#: A comment further from its centre than this many times the typical distance belongs to no topic.
FARTHEST = 2.5


def content_words(text):
    """Runs of at least three letters that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{3,}"), 0), lambda t: ~t.isin(STOPWORDS))


def embed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``vector``: hashed words weighted by rarity, on the unit sphere. Any other embedding may take its place."""
    words = df.withColumn("words", content_words(F.col(text)))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=HASHED).transform(words)
    weighted = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="vector").transform(weighted).drop("tf", "idf")


def topic_model(df: DataFrame, ident: str, text: str, topics: int = TOPICS) -> DataFrame:
    """``ident, topic_id``: comments grouped by their vectors in few dimensions; -1 for comments far from every centre or in small groups.

    A density clustering has no counterpart in Spark; k-means with a distance limit stands in for it. With fewer
    than twice the smallest group's rows all get -1.
    """
    rows = df.select(ident, text)
    n = rows.count()
    if n < 2 * SMALLEST:
        return rows.select(ident, F.lit(-1).alias("topic_id"))
    vectors = embed(rows, text).select(ident, "vector")
    reduced = PCA(k=DIMENSIONS, inputCol="vector", outputCol="features").fit(vectors).transform(vectors).select(ident, "features")
    reduced = reduced.cache()
    model = KMeans(k=min(topics, n // SMALLEST), seed=SEED, featuresCol="features").fit(reduced)
    centres = df.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "topic_id int, centre array<double>")
    placed = model.transform(reduced).withColumnRenamed("prediction", "topic_id").withColumn("v", vector_to_array("features")).join(F.broadcast(centres), "topic_id")
    apart = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    placed = placed.select(ident, "topic_id", apart.alias("apart"))
    per = placed.groupBy("topic_id").agg(F.count("*").alias("size"), F.percentile_approx("apart", 0.5, 1000).alias("usual"))
    judged = placed.join(F.broadcast(per), "topic_id")
    inside = (F.col("size") >= SMALLEST) & (F.col("apart") <= FARTHEST * F.col("usual") + 1e-9)
    return judged.select(ident, F.when(inside, F.col("topic_id")).otherwise(-1).alias("topic_id"))


def topic_names(assigned: DataFrame, texts: DataFrame, ident: str, text: str, top: int = 4) -> DataFrame:
    """``topic_id, n_comments, keywords, label``: the words with the highest class-based TF-IDF name each topic."""
    words = assigned.filter("topic_id >= 0").join(texts.select(ident, text), ident).select("topic_id", F.explode(content_words(F.col(text))).alias("word"))
    counts = words.groupBy("topic_id", "word").agg(F.count("*").alias("n"))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("all"))
    sizes = counts.groupBy("topic_id").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    scored = counts.join(everywhere, "word").join(F.broadcast(sizes), "topic_id").join(F.broadcast(mean))
    scored = scored.withColumn("score", F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.col("all")))
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"), "word")
    best = scored.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    named = best.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("keywords"))
    n = assigned.groupBy("topic_id").agg(F.count("*").alias("n_comments"))
    return named.join(n, "topic_id").select("topic_id", "n_comments", "keywords", topic_label(F.col("keywords")).alias("label"))


def topics(df: DataFrame, ident: str, text: str) -> DataFrame:
    assigned = written(topic_model(df, ident, text), "topics")
    return topic_names(assigned, df, ident, text)
