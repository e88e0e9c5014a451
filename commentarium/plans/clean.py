"""Queries on cleaning, filters, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.functions import scalars as X
from commentarium.functions import text as T
from commentarium.operators.cleaning import clean_mask, delta
from commentarium.plans import views as V
from commentarium.tables import load

WINDOWS = (7, 28, 90)
AS_OF = "2024-12-01 00:00:00"


def cln_comments(spark: SparkSession, sf: str) -> DataFrame:
    return V.cleaned(spark, sf).select("comment_id", "cleaned_text", "is_spam", "spam_reason", "is_duplicate", "language", "repeat_key")


def flt1_clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.cleaned(spark, sf).filter(clean_mask()).select("comment_id", "video_id", "like_count")


def dq21_pipeline_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c: F.sum(c.cast("long"))
    return V.cleaned(spark, sf).agg(F.count("*").alias("total"), one(clean_mask()).alias("used"), one(F.col("is_spam")).alias("spam"), one(F.col("is_duplicate")).alias("duplicates"))


def flt6_explorer_modes(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.cleaned(spark, sf)
    modes = F.array_compact(F.array(F.lit("All"), F.when(clean_mask(), "Clean only"), F.when(~clean_mask(), "Spam only")))
    return rows.select(F.explode(modes).alias("mode"), "like_count").groupBy("mode").agg(F.count("*").alias("n"), F.sum("like_count").alias("likes"))


def flt4_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Videos published in the last 7, 28 and 90 days before a given day, and the comments on them (semi-join)."""
    videos, comments = V.videos(spark, sf), V.comments(spark, sf)
    recent = [videos.filter(F.col("published") >= F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(n))).select("video_id", F.lit(n).alias("days")) for n in WINDOWS]
    ids = recent[0].unionByName(recent[1]).unionByName(recent[2])
    per = comments.groupBy("video_id").agg(F.count("*").alias("comments"))
    return ids.join(per, "video_id", "left").groupBy("days").agg(F.count("*").alias("videos"), F.sum(F.coalesce("comments", F.lit(0))).alias("comments"))


def jn4_comments_of_known_videos(spark: SparkSession, sf: str) -> DataFrame:
    return V.comments(spark, sf).join(V.videos(spark, sf), "video_id", "left_semi").select("comment_id", "video_id")


def jn6_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Comments per video with its title, or its id where it has none."""
    per = V.comments(spark, sf).filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.count("*").alias("n"))
    return per.join(V.videos(spark, sf).select("video_id", "title"), "video_id", "left").select("video_id", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("video_id")).alias("title"), "n")


def flt10_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Which comments still wait for a score if the labelled ones are done."""
    rows = V.comments(spark, sf).select("comment_id")
    todo, done = delta(rows, load(spark, sf, "human_labels"), "comment_id")
    return todo.withColumn("state", F.lit("to score")).unionByName(done.withColumn("state", F.lit("passed on")))


def prj1_engagement(spark: SparkSession, sf: str) -> DataFrame:
    return V.videos(spark, sf).select("video_id", X.engagement_rate(F.col("like_count"), F.col("comment_count"), F.col("view_count")).alias("engagement_rate"))


def f_video_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Durations, dates, weeks, shortened titles and links of all videos."""
    rows = V.videos(spark, sf)
    iso = F.format_string("PT%dH%dM%dS", (F.col("duration_secs") / 3600).cast("int"), (F.col("duration_secs") % 3600 / 60).cast("int"), (F.col("duration_secs") % 60).cast("int"))
    return rows.select(
        "video_id", iso.alias("iso_duration"), X.parse_duration(iso).alias("secs"), X.duration_text(F.col("duration_secs").cast("bigint")).alias("duration"),
        F.date_format("published", "yyyy-MM-dd").alias("day"), X.iso_week(F.col("published")).alias("iso_week"),
        X.shortened(F.col("title"), 35).alias("short_title"), F.concat(F.lit("https://video.example/watch?v="), F.coalesce("video_id", F.lit(""))).alias("link"),
        X.whole_days(F.lit(AS_OF).cast("timestamp"), F.col("published")).alias("age_days"),
    )


def win1_first_of_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """The first comment of every repeated text and how often it was repeated."""
    rows = V.cleaned(spark, sf)
    per = rows.groupBy("repeat_key").agg(F.count("*").alias("copies"), F.min(F.struct("ordinal", "comment_id")).alias("first"))
    return per.filter("copies > 1").select("repeat_key", "copies", F.col("first.comment_id").alias("comment_id"))


def win7_cap_per_video(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred comments of each video in input order."""
    w = Window.partitionBy("video_id").orderBy("ordinal")
    rows = V.comments(spark, sf).filter(F.col("video_id").isNotNull())
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= 100).select("video_id", "comment_id", "position")


def set4_routes(spark: SparkSession, sf: str) -> DataFrame:
    """How many comments go to the English and to the multilingual model."""
    rows = V.cleaned(spark, sf).filter(clean_mask())
    return rows.groupBy(F.when(F.col("language").isin("en", "und"), "english").otherwise("multilingual").alias("route"), "language").agg(F.count("*").alias("n"))


def agg9_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Comments per language with their share of all."""
    per = V.cleaned(spark, sf).groupBy("language").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(total)).select("language", "n", F.round(F.col("n") / F.col("all") * 100 + 1e-9, 2).alias("pct"))


def agg13_distinct_titles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "videos").select("video_id", "title").filter(F.col("video_id").isNotNull()).dropDuplicates()


def agg15_sarcasm(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.cleaned(spark, sf).filter(clean_mask())
    return rows.agg(F.count_if(T.matches(F.col("text"), T.SARCASM)).alias("sarcastic"), F.count_if(T.matches(F.col("text"), T.SARCASM_SLICE)).alias("slice"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    cln_comments, flt1_clean_rows, dq21_pipeline_counts, flt6_explorer_modes, flt4_windows, jn4_comments_of_known_videos, jn6_titles, flt10_delta, prj1_engagement,
    f_video_texts, win1_first_of_repeats, win7_cap_per_video, set4_routes, agg9_languages, agg13_distinct_titles, agg15_sarcasm,
)}

_CLEAN = "WITH" + V.CLEANED_SQL
SQL = {
    "cln_comments": _CLEAN + "SELECT comment_id, cleaned_text, is_spam, spam_reason, is_duplicate, language, repeat_key FROM cl",
    "flt1_clean_rows": _CLEAN + "SELECT comment_id, video_id, like_count FROM cl WHERE NOT is_spam AND NOT is_duplicate",
    "dq21_pipeline_counts": _CLEAN + "SELECT count(*) AS total, CAST(sum(CAST(NOT is_spam AND NOT is_duplicate AS INT)) AS BIGINT) AS used, CAST(sum(CAST(is_spam AS INT)) AS BIGINT) AS spam, CAST(sum(CAST(is_duplicate AS INT)) AS BIGINT) AS duplicates FROM cl",
    "flt6_explorer_modes": _CLEAN + """, m AS (SELECT 'All' AS mode, like_count FROM cl UNION ALL SELECT CASE WHEN is_spam OR is_duplicate THEN 'Spam only' ELSE 'Clean only' END, like_count FROM cl)
        SELECT mode, count(*) AS n, CAST(sum(like_count) AS BIGINT) AS likes FROM m GROUP BY mode""",
    "flt4_windows": "WITH" + V.COMMENTS_SQL + "," + V.VIDEOS_SQL + f""", d AS (SELECT unnest([7, 28, 90]) AS days), ids AS (SELECT video_id, CAST(days AS INT) AS days FROM vid, d WHERE published >= TIMESTAMP '{AS_OF}' - to_days(CAST(days AS INT))),
        per AS (SELECT video_id, count(*) AS comments FROM cur GROUP BY video_id)
        SELECT days, count(*) AS videos, CAST(sum(coalesce(comments, 0)) AS BIGINT) AS comments FROM ids LEFT JOIN per USING (video_id) GROUP BY days""",
    "jn4_comments_of_known_videos": "WITH" + V.COMMENTS_SQL + " SELECT comment_id, video_id FROM cur WHERE video_id IN (SELECT video_id FROM videos)",
    "jn6_titles": "WITH" + V.COMMENTS_SQL + "," + V.VIDEOS_SQL + """, per AS (SELECT video_id, count(*) AS n FROM cur WHERE video_id IS NOT NULL GROUP BY video_id)
        SELECT video_id, coalesce(CASE WHEN trim(title, ' ') <> '' THEN title END, video_id) AS title, n FROM per LEFT JOIN vid USING (video_id)""",
    "flt10_delta": "WITH" + V.COMMENTS_SQL + """ SELECT comment_id, CASE WHEN comment_id IN (SELECT comment_id FROM human_labels WHERE comment_id IS NOT NULL) THEN 'passed on' ELSE 'to score' END AS state FROM cur""",
    "prj1_engagement": "WITH" + V.VIDEOS_SQL + " SELECT video_id, round((coalesce(like_count, 0) + coalesce(comment_count, 0)) / CASE WHEN coalesce(view_count, 0) = 0 THEN 1 ELSE view_count END * 100, 2) AS engagement_rate FROM vid",
    "f_video_texts": "WITH" + V.VIDEOS_SQL + f""" SELECT video_id, 'PT' || duration_secs // 3600 || 'H' || duration_secs % 3600 // 60 || 'M' || duration_secs % 60 || 'S' AS iso_duration, coalesce(CAST(duration_secs AS BIGINT), 0) AS secs,
        CASE WHEN duration_secs > 0 THEN duration_secs // 60 || 'm ' || duration_secs % 60 || 's' ELSE 'N/A' END AS duration, strftime(published, '%Y-%m-%d') AS day, strftime(published, '%G-W%V') AS iso_week,
        CASE WHEN length(title) > 35 THEN left(title, 35) || '…' ELSE title END AS short_title, 'https://video.example/watch?v=' || video_id AS link,
        CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published)) / 86400000000) AS BIGINT) AS age_days FROM vid""",
    "win1_first_of_repeats": _CLEAN + "SELECT repeat_key, count(*) AS copies, arg_min(comment_id, ordinal) AS comment_id FROM cl GROUP BY repeat_key HAVING count(*) > 1",
    "win7_cap_per_video": "WITH" + V.COMMENTS_SQL + " SELECT video_id, comment_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ordinal) AS INT) AS position FROM cur WHERE video_id IS NOT NULL QUALIFY position <= 100",
    "set4_routes": _CLEAN + "SELECT CASE WHEN language IN ('en', 'und') THEN 'english' ELSE 'multilingual' END AS route, language, count(*) AS n FROM cl WHERE NOT is_spam AND NOT is_duplicate GROUP BY ALL",
    "agg9_languages": _CLEAN + "SELECT language, count(*) AS n, round(count(*) / (SELECT count(*) FROM cl) * 100 + 1e-9, 2) AS pct FROM cl GROUP BY language",
    "agg13_distinct_titles": "SELECT DISTINCT video_id, title FROM videos WHERE video_id IS NOT NULL",
    "agg15_sarcasm": _CLEAN + f"SELECT count(*) FILTER (regexp_matches(text, {V.q(T.SARCASM)}, 'i')) AS sarcastic, count(*) FILTER (regexp_matches(text, {V.q(T.SARCASM_SLICE)}, 'i')) AS slice, count(*) AS n FROM cl WHERE NOT is_spam AND NOT is_duplicate",
}
