"""Queries for tables that are shown, and on scores by routed models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions import scalars as X
from commentarium.operators import routing, scoring
from commentarium.operators.cleaning import clean_mask
from commentarium.operators.sentiment import rounded
from commentarium.plans import sentiment as P
from commentarium.plans import views as V


def dq20_all_videos(spark: SparkSession, sf: str) -> DataFrame:
    """All videos with their numbers as text, under titles in words."""
    rate = X.engagement_rate(F.col("like_count"), F.col("comment_count"), F.col("view_count"))
    rows = V.videos(spark, sf).select(
        "video_id", "title", F.date_format("published", "yyyy-MM-dd").alias("published"), *[X.grouped(F.col(f"{c}_count")).alias(f"{c}s") for c in ("view", "like", "comment")],
        F.format_string("%.2f%%", rate).alias("engagement"), X.duration_text(F.col("duration_secs").cast("bigint")).alias("duration"),
        F.concat(F.lit("https://video.example/watch?v="), F.col("video_id")).alias("watch_link"),
    )
    return X.titled(rows)


def dq10_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment per video for a line by time: rounded to four digits, then to three."""
    rows = P.agg2_sentiment_over_time(spark, sf)
    return rows.select("video_id", "published", rounded(F.col("avg_sentiment"), 3).alias("avg_sentiment"), rounded(F.col("flat_sentiment"), 3).alias("flat_sentiment"), "n_comments")


def flt9_scores_on_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every comment, spam and repeats too; only clean ones have scores."""
    return scoring.scores_where(V.cleaned(spark, sf), clean_mask()).select("comment_id", clean_mask().alias("is_clean"), "sentiment_score", "sentiment_label", "emotion")


def x3_emotion_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.emotion_shares(V.cleaned(spark, sf).filter(clean_mask()))
    return rows.select("comment_id", *[f"emotion_{e}" for e in scoring.EMOTIONS])


def x5_routed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Clean comments scored by the model of their language."""
    return routing.routed_scores(V.cleaned(spark, sf).filter(clean_mask()), "comment_id", "cleaned_text", F.col("language"))


QUERIES = {f.__name__: f for f in (dq20_all_videos, dq10_trend, flt9_scores_on_all, x3_emotion_shares, x5_routed_scores)}


def _n(words) -> str:
    return f"len(list_filter(w, lambda t: t IN {V.words_in(words)}))"


_COUNTS = ", ".join(f"{_n(s) if s else '0'} AS n_{e}" for e, s in scoring.EMOTIONS.items())
_ALL = " + ".join(f"n_{e}" for e in scoring.EMOTIONS)
_SHARES = ", ".join(f"CASE WHEN {_ALL} = 0 THEN {'1.0' if e == 'neutral' else '0.0'}::DOUBLE ELSE round(n_{e} / ({_ALL}) + 1e-9, 4) END AS emotion_{e}" for e in scoring.EMOTIONS)
_BY_LANGUAGE = "CASE WHEN language IN ('en', 'und') THEN {} ELSE {} END"
SQL = {
    "dq20_all_videos": "WITH" + V.VIDEOS_SQL + f""" SELECT video_id AS "Video Id", title AS "Title", strftime(published, '%Y-%m-%d') AS "Published", format('{{:,}}', view_count) AS "Views", format('{{:,}}', like_count) AS "Likes",
        format('{{:,}}', comment_count) AS "Comments", printf('%.2f%%', CAST({P._RATE} AS DOUBLE)) AS "Engagement", CASE WHEN duration_secs > 0 THEN (duration_secs // 60) || 'm ' || (duration_secs % 60) || 's' ELSE 'N/A' END AS "Duration",
        'https://video.example/watch?v=' || video_id AS "Watch Link" FROM vid""",
    "dq10_trend": f"SELECT video_id, published, round(avg_sentiment + 1e-9, 3) AS avg_sentiment, round(flat_sentiment + 1e-9, 3) AS flat_sentiment, n_comments FROM ({P.SQL['agg2_sentiment_over_time']})",
    "flt9_scores_on_all": "WITH" + V.SCORED_SQL + "SELECT comment_id, NOT is_spam AND NOT is_duplicate AS is_clean, sc.sentiment_score, sc.sentiment_label, sc.emotion FROM cl LEFT JOIN sc USING (comment_id)".replace("is_spam", "cl.is_spam").replace("is_duplicate", "cl.is_duplicate"),
    "x3_emotion_shares": "WITH" + V.CLEANED_SQL + f", n AS (SELECT comment_id, {_COUNTS} FROM cl WHERE NOT is_spam AND NOT is_duplicate) SELECT comment_id, {_SHARES} FROM n",
    "x5_routed_scores": "WITH" + V.CLEANED_SQL + f""", n AS (SELECT comment_id, {_BY_LANGUAGE.format("'first'", "'other'")} AS route, {_BY_LANGUAGE.format(_n(sorted(routing.ENGLISH[0])), _n(scoring.POSITIVE))} AS pos, {_BY_LANGUAGE.format(_n(sorted(routing.ENGLISH[1])), _n(scoring.NEGATIVE))} AS neg FROM cl WHERE NOT is_spam AND NOT is_duplicate),
        r AS (SELECT *, CASE WHEN pos + neg = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS rest FROM n),
        p AS (SELECT comment_id, route, round((neg + 0.1::DOUBLE) / (pos + neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS neg_prob, round(rest / (pos + neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS neu_prob, round((pos + 0.1::DOUBLE) / (pos + neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS pos_prob FROM r)
        SELECT *, round(pos_prob - neg_prob, 4) AS sentiment_score, CASE WHEN greatest(neg_prob, neu_prob, pos_prob) < 0.55 THEN 'Uncertain' WHEN pos_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Positive'
        WHEN neg_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Negative' ELSE 'Neutral' END AS sentiment_label FROM p""",
}
