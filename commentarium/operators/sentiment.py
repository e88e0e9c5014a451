"""Aggregates of sentiment, weighted by likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def rounded(x: Column, digits: int) -> Column:
    """Rounding where exact halves always go up, so that every engine rounds alike."""
    return F.round(x + EPS, digits)


def like_weight(likes: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(likes, F.lit(0)), F.lit(0)).cast("double"))


def weighted_mean(score: Column, likes: Column) -> Column:
    """Mean weighted by log(1 + likes); the plain mean where nothing has likes; 0 of nothing."""
    w = F.when(score.isNotNull(), like_weight(likes))
    return F.coalesce(F.when(F.sum(w) == 0, F.avg(score)).otherwise(F.sum(score * w) / F.sum(w)), F.lit(0.0))


def share_of(column: str, value: str) -> Column:
    return F.avg(F.coalesce(F.col(column) == value, F.lit(False)).cast("double")) * 100


def confident(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sentiment_score").isNotNull() & ~F.col("sentiment_label").eqNullSafe("Uncertain"))


def sentiment_per_video(scored: DataFrame) -> DataFrame:
    return (
        confident(scored).filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(
            rounded(weighted_mean(F.col("sentiment_score"), F.col("like_count")), 4).alias("avg_sentiment"),
            rounded(F.avg("sentiment_score"), 4).alias("flat_sentiment"),
            F.count("*").alias("n_comments"),
            rounded(share_of("sentiment_label", "Positive"), 1).alias("positive_pct"),
            rounded(share_of("sentiment_label", "Negative"), 1).alias("negative_pct"),
        )
    )


def keyword_hits(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """A row per comment and keyword found in it; each keyword is a constant pattern, compiled once a task."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.lower(F.col(text)).rlike("(?iu)" + p), F.lit(False)), F.lit(k)) for k, p in patterns.items()]).cast("array<string>"))
    return df.withColumn("keyword", F.explode(found))


def per_topic(rows: DataFrame, topic: str, least: int = 20, examples: int = 3) -> DataFrame:
    """Per topic: comments, those with a certain label, prominence by likes, sentiment where ``least`` are certain, most liked comments."""
    sure = ~F.col("sentiment_label").eqNullSafe("Uncertain")
    score = F.when(sure, F.col("sentiment_score"))
    per = rows.groupBy(topic).agg(
        F.count("*").alias("n_comments"), F.count_if(sure).alias("n_certain"), F.round(F.sum(like_weight(F.col("like_count"))) + EPS, 3).alias("prominence"),
        rounded(weighted_mean(score, F.col("like_count")), 4).alias("weighted"), rounded(F.avg(score), 4).alias("flat"),
    )
    w = Window.partitionBy(topic).orderBy(F.desc("like_count"), "ordinal")
    first = rows.select(topic, "comment_id", "like_count", "ordinal").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples)
    tops = first.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("k", "comment_id"))).alias("e"))
    enough = F.col("n_certain") >= least
    return per.join(tops, topic).select(
        topic, "n_comments", "n_certain", "prominence", F.when(enough, F.col("weighted")).alias("weighted_sentiment"), F.when(enough, F.col("flat")).alias("flat_sentiment"),
        enough.alias("has_sentiment"), F.array_join(F.transform("e", lambda x: x["comment_id"]), ",").alias("examples"),
    )
