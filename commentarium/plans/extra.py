"""Queries on topics, streams, fan look-up and filters of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions.scalars import topic_label
from commentarium.operators import topics as P
from commentarium.operators.cleaning import clean_mask
from commentarium.plans import views as V
from commentarium.streaming import comments as S
from commentarium.tables import distinct_fans, load


def ml8_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of the clean comments with their size and name."""
    return P.topics(V.cleaned(spark, sf).filter(clean_mask()).select("comment_id", "cleaned_text"), "comment_id", "cleaned_text")


def f18_labels_of_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A label made of each video's tags as keywords."""
    rows = V.videos(spark, sf).filter(F.col("tags").isNotNull())
    return rows.select("video_id", topic_label(F.filter("tags", lambda t: t.isNotNull())).alias("label"))


def stream_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Comments per week, counted by a stream over the table's files."""
    return S.drained(S.weekly_counts(S.read_comments(spark, f"{sf}/comments.parquet")), "complete")


def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Comments per label, scored by a stream; each comment once."""
    rows = S.drained(S.score_new(S.read_comments(spark, f"{sf}/comments.parquet")), "append")
    return rows.groupBy("sentiment_label").agg(F.count("*").alias("n"))


def dq17_fan_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_fans(load(spark, sf, "fans"))
    return rows.select("author", F.concat(F.lit("https://video.example/channel/"), F.coalesce("author_channel_id", F.lit(""))).alias("link"), "comment_count", "likes_earned").orderBy(F.desc("comment_count"), "author_channel_id")


def dq22_explorer(spark: SparkSession, sf: str) -> DataFrame:
    """Clean comments that are positive or negative and show joy or surprise."""
    rows = V.scored(spark, sf).filter(F.col("sentiment_label").isin("Positive", "Negative") & F.col("emotion").isin("joy", "surprise"))
    return rows.select("comment_id", "sentiment_label", "emotion", "like_count")


QUERIES = {f.__name__: f for f in (ml8_topics, f18_labels_of_tags, stream_weekly, stream_scores, dq17_fan_lookup, dq22_explorer)}

SQL = {
    "f18_labels_of_tags": "WITH" + V.VIDEOS_SQL + """, k AS (SELECT video_id, list_filter(list_filter(tags, lambda t: t IS NOT NULL)[1:4], lambda t: length(t) > 2) AS k FROM vid WHERE tags IS NOT NULL)
        SELECT video_id, CASE WHEN len(k) = 0 THEN 'General' ELSE array_to_string(list_transform(k, lambda t: upper(left(t, 1)) || lower(substr(t, 2))), ' · ') END AS label FROM k""",
    "stream_weekly": """WITH d AS (SELECT comment_id, any_value(try_cast(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC') AS ts FROM comments WHERE comment_id IS NOT NULL AND regexp_matches(published_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') GROUP BY comment_id)
        SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS comments FROM d WHERE ts IS NOT NULL GROUP BY 1""",
    "stream_scores": "WITH" + V.COMMENTS_SQL + f""", cl AS (SELECT *, regexp_extract_all(lower(cleaned_text), '[\\p{{L}}\\p{{N}}]+') AS w, false AS is_spam, false AS is_duplicate FROM (
        SELECT *, {V.CLEANED_SQL.split('c1 AS (SELECT *, ')[1].split(' AS cleaned_text')[0]} AS cleaned_text FROM cur WHERE published IS NOT NULL))""" + V.SCORED_SQL.replace(V.CLEANED_SQL, "") + " SELECT sentiment_label, count(*) AS n FROM sc GROUP BY sentiment_label",
    "dq17_fan_lookup": "SELECT DISTINCT author, 'https://video.example/channel/' || author_channel_id AS link, comment_count, likes_earned FROM fans WHERE author_channel_id IS NOT NULL",
    "dq22_explorer": "WITH" + V.SCORED_SQL + "SELECT comment_id, sentiment_label, emotion, like_count FROM sc WHERE sentiment_label IN ('Positive', 'Negative') AND emotion IN ('joy', 'surprise')",
}
