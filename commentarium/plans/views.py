"""The views that most queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions import text as T
from commentarium.functions.scalars import parse_time
from commentarium.operators import scoring
from commentarium.operators.cleaning import STOPWORDS, clean_comments, clean_mask
from commentarium.tables import current_comments, current_videos, load

COLUMNS = ["comment_id", "video_id", "author", "author_channel_id", "text", "like_count", "reply_count", "published_at", "ordinal"]


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_comments(load(spark, sf_dir, "comments"), COLUMNS)
    return rows.withColumn("like_count", F.coalesce("like_count", F.lit(0))).withColumn("published", parse_time(F.col("published_at"))).drop("published_at")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_videos(load(spark, sf_dir, "videos"), ["video_id", "title", "published_at", "view_count", "like_count", "comment_count", "duration_secs", "tags"])
    return rows.withColumn("published", parse_time(F.col("published_at"))).drop("published_at")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_comments(comments(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean comments with their scores."""
    return scoring.lexicon_scores(cleaned(spark, sf_dir).filter(clean_mask()))


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def words_in(words: list[str] | str) -> str:
    words = words.split() if isinstance(words, str) else words
    return "(" + ", ".join(q(w) for w in dict.fromkeys(words)) + ")" if words else "('')"


_REASONS = " ".join(f"WHEN regexp_matches(text, {q(p)}, 'i') THEN {q(why)}" for p, why, _ in T.SPAM_RULES)
_COUNTS = ", ".join(f"{{'n': len(list_filter(w, lambda t: t IN {words_in(s)})), 'k': {-k}, 'code': '{c}'}}" for k, (c, s) in enumerate(STOPWORDS.items()))
_EMOTIONS = ", ".join(
    f"{{'n': {'0' if not s else f'len(list_filter(w, lambda t: t IN {words_in(s)}))'}, 'k': {-k}, 'name': '{e}'}}" for k, (e, s) in enumerate(scoring.EMOTIONS.items())
)
_POS, _NEG, _NO = words_in(scoring.POSITIVE), words_in(scoring.NEGATIVE), words_in(scoring.DENIAL)

COMMENTS_SQL = f"""
    cur AS (
        SELECT comment_id, video_id, author, author_channel_id, coalesce(text, '') AS text, coalesce(like_count, 0) AS like_count, reply_count,
               CASE WHEN regexp_matches(published_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS published, ordinal
        FROM comments WHERE comment_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY ordinal DESC NULLS LAST) = 1)"""
VIDEOS_SQL = """
    vid AS (
        SELECT video_id, title, view_count, like_count, comment_count, duration_secs, tags,
               CASE WHEN regexp_matches(published_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS published
        FROM videos WHERE video_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY fetched_at DESC NULLS LAST, view_count DESC NULLS LAST) = 1)"""
CLEANED_SQL = (
    COMMENTS_SQL
    + f""",
    c1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), {q(T.URL)}, ' ', 'gi'), {q(T.HANDLE)}, ' ', 'g'), '[{T.WS}]+', ' ', 'g'), ' ') AS cleaned_text FROM cur),
    c2 AS (SELECT *, regexp_extract_all(lower(cleaned_text), '[\\p{{L}}\\p{{N}}]+') AS w,
           md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(cleaned_text), '[\\p{{So}}\\p{{Sk}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_{T.WS}]', '', 'g'), '[{T.WS}]+', ' ', 'g'), ' ')) AS repeat_key,
           CASE WHEN length(cleaned_text) < 4 OR len(regexp_extract_all(cleaned_text, '[a-zA-Z]{{2,}}')) < 2 THEN 'too little text' {_REASONS} END AS spam_reason
           FROM c1),
    cl AS (SELECT * EXCLUDE (w), spam_reason IS NOT NULL AS is_spam, ordinal <> min(ordinal) OVER (PARTITION BY repeat_key) AS is_duplicate, w,
           CASE WHEN length(cleaned_text) < 20 THEN 'und'
                WHEN len(list_filter(w, lambda t: regexp_matches(t, '^\\p{{Cyrillic}}+$'))) * 2 > len(w) THEN 'ru'
                WHEN list_max([{_COUNTS}]).n > 0 THEN list_max([{_COUNTS}]).code ELSE 'und' END AS language
           FROM c2)"""
)
SCORED_SQL = (
    CLEANED_SQL
    + f""",
    s1 AS (SELECT *, len(list_filter(w, lambda t, i: (t IN {_POS} AND coalesce(w[i - 1], '') NOT IN {_NO}) OR (t IN {_NEG} AND coalesce(w[i - 1], '') IN {_NO}))) AS n_pos,
           len(list_filter(w, lambda t, i: (t IN {_NEG} AND coalesce(w[i - 1], '') NOT IN {_NO}) OR (t IN {_POS} AND coalesce(w[i - 1], '') IN {_NO}))) AS n_neg,
           list_max([{_EMOTIONS}]) AS e
           FROM cl WHERE NOT is_spam AND NOT is_duplicate),
    s2 AS (SELECT *, CASE WHEN n_pos + n_neg = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS rest FROM s1),
    s3 AS (SELECT *, round((n_neg + 0.1::DOUBLE) / (n_pos + n_neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS neg_prob, round((n_pos + 0.1::DOUBLE) / (n_pos + n_neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS pos_prob,
           round(rest / (n_pos + n_neg + 0.2::DOUBLE + rest) + 1e-9, 4) AS neu_prob FROM s2),
    sc AS (SELECT *, round(pos_prob - neg_prob, 4) AS sentiment_score,
           CASE WHEN greatest(neg_prob, neu_prob, pos_prob) < 0.55 THEN 'Uncertain' WHEN pos_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Positive'
                WHEN neg_prob = greatest(neg_prob, neu_prob, pos_prob) THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
           CASE WHEN e.n > 0 THEN e.name ELSE 'neutral' END AS emotion FROM s3),
    cdf AS (SELECT * FROM sc WHERE sentiment_label <> 'Uncertain')"""
)
WEIGHTED = "coalesce(CASE WHEN sum(ln(1 + greatest(like_count, 0))) = 0 THEN avg(sentiment_score) ELSE sum(sentiment_score * ln(1 + greatest(like_count, 0))) / sum(ln(1 + greatest(like_count, 0))) END, 0)"
