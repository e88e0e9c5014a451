"""Queries on scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.functions import scalars as X
from commentarium.functions import text as T
from commentarium.operators import scoring, sentiment, terms, topics
from commentarium.operators.sentiment import rounded
from commentarium.plans import views as V
from commentarium.session import written

KEYWORDS = ("sourdough experiment", "drone shot", "boss fight", "soundtrack", "pottery lesson", "chess endgame", "second chapter")
_TOPIC_COLUMNS = ("comment_id", "video_id", "like_count", "ordinal", "sentiment_score", "sentiment_label")


def x1_scores(spark: SparkSession, sf: str) -> DataFrame:
    return V.scored(spark, sf).select("comment_id", "neg_prob", "neu_prob", "pos_prob", "sentiment_score", "sentiment_label", "emotion", scoring.label_of_compound(F.col("sentiment_score")).alias("compound_label"))


def agg1_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentiment.confident(V.scored(spark, sf))
    return rows.agg(rounded(sentiment.weighted_mean(F.col("sentiment_score"), F.col("like_count")), 3).alias("weighted"), rounded(F.avg("sentiment_score"), 3).alias("flat"), F.count("*").alias("n"))


def f17_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Like-weighted less plain sentiment per video, and whether the difference is a signal."""
    per = sentiment.confident(V.scored(spark, sf)).filter(F.col("video_id").isNotNull()).groupBy("video_id").agg(
        (sentiment.weighted_mean(F.col("sentiment_score"), F.col("like_count")) - F.avg("sentiment_score")).alias("gap"))
    return per.select("video_id", rounded(F.col("gap"), 4).alias("gap"), (F.abs("gap") >= 0.1).alias("signal"))


def agg2_sentiment_over_time(spark: SparkSession, sf: str) -> DataFrame:
    per = sentiment.sentiment_per_video(V.scored(spark, sf))
    videos = V.videos(spark, sf).select("video_id", "title", "published")
    joined = per.join(videos, "video_id").withColumn("short_title", X.shortened(F.col("title"), 35))
    return joined.select("video_id", "short_title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "avg_sentiment", "flat_sentiment", "n_comments", "positive_pct", "negative_pct").orderBy("published", "video_id")


def agg3_top_fans(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.scored(spark, sf).filter(F.col("author").isNotNull() & F.col("author_channel_id").isNotNull())
    sure = F.when(~F.col("sentiment_label").eqNullSafe("Uncertain"), F.col("sentiment_score"))
    per = rows.groupBy("author", "author_channel_id").agg(F.count("*").alias("comments"), F.countDistinct("video_id").alias("videos"), F.sum("like_count").alias("likes"), rounded(F.avg(sure), 3).alias("avg_sentiment"))
    return per.orderBy(F.desc("comments"), "author", "author_channel_id").limit(20)


def agg4_keywords(spark: SparkSession, sf: str) -> DataFrame:
    hits = sentiment.keyword_hits(V.scored(spark, sf), "text", {k: T.keyword_pattern(k) for k in KEYWORDS})
    return hits.groupBy("keyword").agg(F.count("*").alias("mentions"), rounded(F.avg("sentiment_score"), 3).alias("avg_sentiment"), rounded(sentiment.share_of("sentiment_label", "Positive"), 1).alias("positive_pct"))


def dq8_label_shares(spark: SparkSession, sf: str) -> DataFrame:
    per = V.scored(spark, sf).groupBy("sentiment_label").agg(F.count("*").alias("n"))
    sums = per.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("sentiment_label") != "Uncertain", F.col("n"))).alias("sure"))
    share = lambda c: F.round(F.col("n") / F.col(c) * 100 + 1e-9, 2)
    return per.join(F.broadcast(sums)).select("sentiment_label", "n", share("all").alias("pct"), F.when(F.col("sentiment_label") != "Uncertain", share("sure")).alias("pct_confident"))


def dq11_emotions(spark: SparkSession, sf: str) -> DataFrame:
    per = V.scored(spark, sf).groupBy("emotion").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("all")))).select("emotion", "n", F.round(F.col("n") / F.col("all") * 100 + 1e-9, 2).alias("pct"))


def dq12_drill_down(spark: SparkSession, sf: str) -> DataFrame:
    """Every video's comments by label and emotion."""
    rows = V.scored(spark, sf).filter(F.col("video_id").isNotNull())
    cells = [F.count_if(F.col("sentiment_label") == x).alias(x.lower()) for x in ("Positive", "Neutral", "Negative", "Uncertain")]
    feelings = [F.count_if(F.col("emotion") == e).alias(e if e != "neutral" else "calm") for e in scoring.EMOTIONS]
    return rows.groupBy("video_id").agg(F.count("*").alias("n"), *cells, *feelings)


def dq13_top_per_emotion(spark: SparkSession, sf: str) -> DataFrame:
    """The five most liked comments of the four most frequent emotions."""
    rows = V.scored(spark, sf)
    top = rows.groupBy("emotion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "emotion").limit(4).select("emotion")
    w = Window.partitionBy("emotion").orderBy(F.desc("like_count"), "ordinal")
    ranked = rows.select("comment_id", "emotion", "like_count", "ordinal").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 5)
    return ranked.join(F.broadcast(top), "emotion", "left_semi").select("emotion", "place", "comment_id", "like_count")


def dq14_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Five most positive, five most critical, five uncertain comments."""
    rows = V.scored(spark, sf).select("comment_id", "sentiment_score", "sentiment_label", "ordinal")
    sure = sentiment.confident(rows)
    best = sure.orderBy(F.desc("sentiment_score"), "ordinal").limit(5).withColumn("kind", F.lit("positive"))
    worst = sure.orderBy("sentiment_score", "ordinal").limit(5).withColumn("kind", F.lit("critical"))
    unsure = rows.filter("sentiment_label = 'Uncertain'").orderBy("ordinal").limit(5).withColumn("kind", F.lit("uncertain"))
    return best.unionByName(worst).unionByName(unsure).select("kind", "comment_id", "sentiment_score")


def dq1_header(spark: SparkSession, sf: str) -> DataFrame:
    """One row: videos, mean engagement, shares of labels, comments analysed."""
    v = V.videos(spark, sf).agg(F.count("*").alias("videos"), rounded(F.avg(X.engagement_rate(F.col("like_count"), F.col("comment_count"), F.col("view_count"))), 2).alias("engagement"),
                                F.avg("view_count").cast("bigint").alias("avg_views"))
    c = sentiment.confident(V.scored(spark, sf)).agg(F.count("*").alias("analysed"), rounded(sentiment.share_of("sentiment_label", "Positive"), 1).alias("positive_pct"), rounded(sentiment.share_of("sentiment_label", "Negative"), 1).alias("negative_pct"))
    return v.join(F.broadcast(c))


def dq5_top_videos(spark: SparkSession, sf: str) -> DataFrame:
    return V.videos(spark, sf).filter(F.col("view_count").isNotNull()).orderBy(F.desc("view_count"), "video_id").limit(10).select("video_id", X.shortened(F.col("title"), 40).alias("title"), "view_count")


def agg14_best_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The most viewed video and the one with the best engagement."""
    rows = V.videos(spark, sf).withColumn("rate", X.engagement_rate(F.col("like_count"), F.col("comment_count"), F.col("view_count")))
    pick = lambda c, what: rows.filter(F.col(c).isNotNull()).orderBy(F.desc(c), "video_id").limit(1).select(F.lit(what).alias("what"), "video_id", F.col(c).cast("double").alias("value"))
    return pick("view_count", "views").unionByName(pick("rate", "engagement"))


def agg6_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics given by the videos' tags, each distinct one: comments, prominence, sentiment where at least twenty are certain, three most liked."""
    names = F.array_distinct(F.transform(F.array_compact("tags"), lambda t: F.lower(F.trim(t))))
    tags = V.videos(spark, sf).select("video_id", F.explode(names).alias("topic")).filter("topic <> ''")
    rows = written(V.scored(spark, sf).select(*_TOPIC_COLUMNS), "scored")  # read twice
    return sentiment.per_topic(rows.join(tags, "video_id"), "topic")


def agg6_modelled_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the topics found in the comments themselves."""
    rows = written(V.scored(spark, sf).select(*_TOPIC_COLUMNS, "cleaned_text"), "scored")
    found = written(topics.topic_model(rows, "comment_id", "cleaned_text"), "topics").filter("topic_id >= 0")
    return sentiment.per_topic(rows.drop("cleaned_text").join(found, "comment_id"), "topic_id")


def agg16_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the videos' numbers, cut to whole ones."""
    return V.videos(spark, sf).agg(*[F.avg(c).cast("bigint").alias(f"avg_{c}") for c in ("view_count", "like_count", "comment_count", "duration_secs")])


def _insights(spark: SparkSession, sf: str, rows: DataFrame, keywords: tuple[str, ...] | list[str]) -> DataFrame:
    hits = sentiment.keyword_hits(rows, "text", {k: T.keyword_pattern(k) for k in keywords})
    keyword = hits.groupBy(F.col("keyword").alias("item")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "item").limit(1)
    fans = rows.filter(F.col("author").isNotNull() & F.col("author_channel_id").isNotNull())
    fan = fans.groupBy(F.col("author").alias("item"), "author_channel_id").agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "item", "author_channel_id").limit(1).select("item", "value")
    video = V.videos(spark, sf).filter(F.col("view_count").isNotNull()).orderBy(F.desc("view_count"), "video_id").limit(1).select(F.col("video_id").alias("item"), F.col("view_count").cast("double").alias("value"))
    parts = [x.withColumn("what", F.lit(what)) for what, x in (("keyword", keyword), ("fan", fan), ("video", video))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("what", "item", "value")


def dq3_insights(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword, the fan and the video that stand out most, each with its number; the keyword is one of seven fixed ones, as the SQL has them."""
    return _insights(spark, sf, V.scored(spark, sf), KEYWORDS)


def dq3_trending_insights(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the term that stands out most in the comments themselves."""
    rows = written(V.scored(spark, sf).select("comment_id", "author", "author_channel_id", "text"), "scored")  # read four times
    return _insights(spark, sf, rows, terms.keywords(rows, "comment_id", "text", 1))


def dq4_views_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """Views, likes and engagement of each video by its time, for the plots."""
    rate = X.engagement_rate(F.col("like_count"), F.col("comment_count"), F.col("view_count")).alias("engagement_rate")
    return V.videos(spark, sf).select("video_id", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "view_count", "like_count", rate).orderBy("published", "video_id")


QUERIES = {f.__name__: f for f in (
    agg16_averages, dq3_insights, dq3_trending_insights, dq4_views_over_time,
    x1_scores, agg1_weighted_mean, f17_gap, agg2_sentiment_over_time, agg3_top_fans, agg4_keywords, dq8_label_shares, dq11_emotions, dq12_drill_down,
    dq13_top_per_emotion, dq14_extremes, dq1_header, dq5_top_videos, agg14_best_videos, agg6_topics, agg6_modelled_topics,
)}

_SC = "WITH" + V.SCORED_SQL
_SCV = _SC + "," + V.VIDEOS_SQL
_RATE = "round((coalesce(like_count, 0) + coalesce(comment_count, 0)) / CASE WHEN coalesce(view_count, 0) = 0 THEN 1 ELSE view_count END * 100, 2)"
_PCT = "round(avg(CASE WHEN sentiment_label = '{}' THEN 1.0::DOUBLE ELSE 0 END) * 100 + 1e-9, 1)"
_HITS = ", ".join(f"CASE WHEN regexp_matches(lower(text), {V.q(T.keyword_pattern(k))}, 'i') THEN '{k}' END" for k in KEYWORDS)
_W6 = "sum(CASE WHEN sentiment_label <> 'Uncertain' THEN ln(1 + greatest(like_count, 0)) END)"
SQL = {
    "agg16_averages": "WITH" + V.VIDEOS_SQL + " SELECT " + ", ".join(f"CAST(trunc(avg({c})) AS BIGINT) AS avg_{c}" for c in ("view_count", "like_count", "comment_count", "duration_secs")) + " FROM vid",
    "dq4_views_over_time": "WITH" + V.VIDEOS_SQL + f" SELECT video_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, view_count, like_count, {_RATE} AS engagement_rate FROM vid",
    "dq3_insights": _SCV + f""", h AS (SELECT unnest([{_HITS}]) AS item FROM sc), k AS (SELECT 'keyword' AS what, item, CAST(count(*) AS DOUBLE) AS value FROM h WHERE item IS NOT NULL GROUP BY item ORDER BY value DESC, item LIMIT 1),
        f AS (SELECT 'fan' AS what, author AS item, CAST(count(*) AS DOUBLE) AS value FROM sc WHERE author IS NOT NULL AND author_channel_id IS NOT NULL GROUP BY author, author_channel_id ORDER BY value DESC, author, author_channel_id LIMIT 1),
        v AS (SELECT 'video' AS what, video_id AS item, CAST(view_count AS DOUBLE) AS value FROM vid WHERE view_count IS NOT NULL ORDER BY view_count DESC, video_id LIMIT 1) SELECT * FROM k UNION ALL SELECT * FROM f UNION ALL SELECT * FROM v""",
    "x1_scores": _SC + "SELECT comment_id, neg_prob, neu_prob, pos_prob, sentiment_score, sentiment_label, emotion, CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS compound_label FROM sc",
    "agg1_weighted_mean": _SC + f"SELECT round({V.WEIGHTED} + 1e-9, 3) AS weighted, round(avg(sentiment_score) + 1e-9, 3) AS flat, count(*) AS n FROM cdf",
    "f17_gap": _SC + f", g AS (SELECT video_id, {V.WEIGHTED} - avg(sentiment_score) AS gap FROM cdf WHERE video_id IS NOT NULL GROUP BY video_id) SELECT video_id, round(gap + 1e-9, 4) AS gap, abs(gap) >= 0.1 AS signal FROM g",
    "agg2_sentiment_over_time": _SCV + f""", p AS (SELECT video_id, round({V.WEIGHTED} + 1e-9, 4) AS avg_sentiment, round(avg(sentiment_score) + 1e-9, 4) AS flat_sentiment, count(*) AS n_comments, {_PCT.format('Positive')} AS positive_pct, {_PCT.format('Negative')} AS negative_pct FROM cdf WHERE video_id IS NOT NULL GROUP BY video_id)
        SELECT video_id, CASE WHEN length(title) > 35 THEN left(title, 35) || '…' ELSE title END AS short_title, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, avg_sentiment, flat_sentiment, n_comments, positive_pct, negative_pct FROM p JOIN vid USING (video_id)""",
    "agg3_top_fans": _SC + "SELECT author, author_channel_id, count(*) AS comments, count(DISTINCT video_id) AS videos, CAST(sum(like_count) AS BIGINT) AS likes, round(avg(CASE WHEN sentiment_label <> 'Uncertain' THEN sentiment_score END) + 1e-9, 3) AS avg_sentiment FROM sc WHERE author IS NOT NULL AND author_channel_id IS NOT NULL GROUP BY ALL ORDER BY comments DESC, author, author_channel_id LIMIT 20",
    "agg4_keywords": _SC + f", h AS (SELECT unnest([{_HITS}]) AS keyword, sentiment_score, sentiment_label FROM sc) SELECT keyword, count(*) AS mentions, round(avg(sentiment_score) + 1e-9, 3) AS avg_sentiment, {_PCT.format('Positive')} AS positive_pct FROM h WHERE keyword IS NOT NULL GROUP BY keyword",
    "dq8_label_shares": _SC + "SELECT sentiment_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM sc) * 100 + 1e-9, 2) AS pct, CASE WHEN sentiment_label <> 'Uncertain' THEN round(count(*) / (SELECT count(*) FROM cdf) * 100 + 1e-9, 2) END AS pct_confident FROM sc GROUP BY sentiment_label",
    "dq11_emotions": _SC + "SELECT emotion, count(*) AS n, round(count(*) / (SELECT count(*) FROM sc) * 100 + 1e-9, 2) AS pct FROM sc GROUP BY emotion",
    "dq12_drill_down": _SC + "SELECT video_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (sentiment_label = '{x}') AS {x.lower()}" for x in ("Positive", "Neutral", "Negative", "Uncertain")) + ", " + ", ".join(f"count(*) FILTER (emotion = '{e}') AS {e if e != 'neutral' else 'calm'}" for e in scoring.EMOTIONS) + " FROM sc WHERE video_id IS NOT NULL GROUP BY video_id",
    "dq13_top_per_emotion": _SC + ", t AS (SELECT emotion FROM sc GROUP BY emotion ORDER BY count(*) DESC, emotion LIMIT 4) SELECT emotion, CAST(row_number() OVER (PARTITION BY emotion ORDER BY like_count DESC, ordinal) AS INT) AS place, comment_id, like_count FROM sc WHERE emotion IN (SELECT emotion FROM t) QUALIFY place <= 5",
    "dq14_extremes": _SC + """, a AS (SELECT 'positive' AS kind, comment_id, sentiment_score FROM cdf ORDER BY sentiment_score DESC, ordinal LIMIT 5), b AS (SELECT 'critical' AS kind, comment_id, sentiment_score FROM cdf ORDER BY sentiment_score, ordinal LIMIT 5),
        c AS (SELECT 'uncertain' AS kind, comment_id, sentiment_score FROM sc WHERE sentiment_label = 'Uncertain' ORDER BY ordinal LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
    "dq1_header": _SCV + f"""SELECT * FROM (SELECT count(*) AS videos, round(avg({_RATE}) + 1e-9, 2) AS engagement, CAST(floor(avg(view_count)) AS BIGINT) AS avg_views FROM vid),
        (SELECT count(*) AS analysed, {_PCT.format('Positive')} AS positive_pct, {_PCT.format('Negative')} AS negative_pct FROM cdf)""",
    "dq5_top_videos": "WITH" + V.VIDEOS_SQL + " SELECT video_id, CASE WHEN length(title) > 40 THEN left(title, 40) || '…' ELSE title END AS title, view_count FROM vid WHERE view_count IS NOT NULL ORDER BY view_count DESC, video_id LIMIT 10",
    "agg14_best_videos": "WITH" + V.VIDEOS_SQL + f", r AS (SELECT *, {_RATE} AS rate FROM vid), a AS (SELECT 'views' AS what, video_id, CAST(view_count AS DOUBLE) AS value FROM r WHERE view_count IS NOT NULL ORDER BY view_count DESC, video_id LIMIT 1), b AS (SELECT 'engagement' AS what, video_id, CAST(rate AS DOUBLE) AS value FROM r WHERE rate IS NOT NULL ORDER BY rate DESC, video_id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b",
    "agg6_topics": _SCV + f""", tg AS (SELECT DISTINCT * FROM (SELECT video_id, lower(trim(unnest(tags), ' ')) AS topic FROM vid) WHERE topic <> ''), r AS (SELECT sc.*, topic FROM sc JOIN tg USING (video_id)),
        p AS (SELECT topic, count(*) AS n_comments, count(*) FILTER (sentiment_label <> 'Uncertain') AS n_certain, round(sum(ln(1 + greatest(like_count, 0))) + 1e-9, 3) AS prominence,
              round(coalesce(CASE WHEN {_W6} = 0 THEN avg(CASE WHEN sentiment_label <> 'Uncertain' THEN sentiment_score END) ELSE sum(CASE WHEN sentiment_label <> 'Uncertain' THEN sentiment_score * ln(1 + greatest(like_count, 0)) END) / {_W6} END, 0) + 1e-9, 4) AS weighted,
              round(avg(CASE WHEN sentiment_label <> 'Uncertain' THEN sentiment_score END) + 1e-9, 4) AS flat FROM r GROUP BY topic),
        e AS (SELECT topic, string_agg(comment_id, ',' ORDER BY k) AS examples FROM (SELECT topic, comment_id, row_number() OVER (PARTITION BY topic ORDER BY like_count DESC, ordinal) AS k FROM r) WHERE k <= 3 GROUP BY topic)
        SELECT topic, n_comments, n_certain, prominence, CASE WHEN n_certain >= 20 THEN weighted END AS weighted_sentiment, CASE WHEN n_certain >= 20 THEN flat END AS flat_sentiment, n_certain >= 20 AS has_sentiment, examples FROM p JOIN e USING (topic)""",
}
