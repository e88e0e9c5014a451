"""Files that a fetch has landed: nested JSON pages of channels, videos and comments, and labelled CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentarium.functions.scalars import parse_duration

VIDEO_PAGES = (
    "id string, snippet struct<title string, publishedAt string, tags array<string>, thumbnails struct<medium struct<url string>>>, "
    "statistics struct<viewCount string, likeCount string, commentCount string>, contentDetails struct<duration string>"
)
COMMENT_PAGES = (
    "id string, videoId string, page_pos bigint, snippet struct<totalReplyCount bigint, topLevelComment struct<snippet struct<authorDisplayName string, "
    "authorChannelId struct<value string>, textDisplay string, likeCount bigint, publishedAt string>>>"
)
PLAYLIST_PAGES = "page bigint, nextPageToken string, items array<struct<snippet:struct<resourceId:struct<videoId:string>>>>"
CHANNEL_PAGES = (
    "id string, snippet struct<title string, description string, customUrl string, publishedAt string, thumbnails struct<high struct<url string>>>, "
    "statistics struct<subscriberCount string, viewCount string, videoCount string>, contentDetails struct<relatedPlaylists struct<uploads string>>"
)
LABELS = "comment_id string, video_id string, like_count bigint, language string, text string, cleaned_text string, human_label string"


def _number(path: str) -> Column:
    return F.coalesce(F.col(path).try_cast("bigint"), F.lit(0))


def channel(spark: SparkSession, path: str, channel_id: str | None = None, handle: str | None = None) -> DataFrame:
    """One row a channel; only that of an id or a handle (with or without @), if given."""
    rows = spark.read.schema(CHANNEL_PAGES).json(path)
    if channel_id is not None:
        rows = rows.filter(F.col("id") == channel_id)
    if handle is not None:
        rows = rows.filter(F.ltrim(F.lower("snippet.customUrl"), F.lit("@")) == handle.lower().lstrip("@"))
    return rows.select(
        F.col("id").alias("channel_id"), "snippet.title", "snippet.description", _number("statistics.subscriberCount").alias("subscriber_count"),
        _number("statistics.viewCount").alias("view_count"), _number("statistics.videoCount").alias("video_count"), F.col("snippet.thumbnails.high.url").alias("thumbnail"),
        F.col("contentDetails.relatedPlaylists.uploads").alias("uploads_playlist_id"), F.col("snippet.customUrl").alias("custom_url"), F.col("snippet.publishedAt").alias("published_at"),
    )


def videos(spark: SparkSession, path: str) -> DataFrame:
    """One row a video; missing numbers count 0, missing tags are empty, rows without id are left out."""
    rows = spark.read.schema(VIDEO_PAGES).json(path).filter(F.col("id").isNotNull())
    return rows.select(
        F.col("id").alias("video_id"), "snippet.title", F.col("snippet.publishedAt").alias("published_at"), F.col("snippet.thumbnails.medium.url").alias("thumbnail"),
        _number("statistics.viewCount").alias("view_count"), _number("statistics.likeCount").alias("like_count"), _number("statistics.commentCount").alias("comment_count"),
        parse_duration(F.col("contentDetails.duration")).cast("int").alias("duration_secs"), F.coalesce("snippet.tags", F.array().cast("array<string>")).alias("tags"),
    )


def comments(spark: SparkSession, path: str, per_video: int | None = None) -> DataFrame:
    """One row a comment, at most ``per_video`` of each video in the order of its pages."""
    rows = spark.read.schema(COMMENT_PAGES).json(path)
    s = "snippet.topLevelComment.snippet."
    flat = rows.select(
        F.col("id").alias("comment_id"), F.col("videoId").alias("video_id"), F.coalesce(F.col(s + "authorDisplayName"), F.lit("Unknown")).alias("author"),
        F.coalesce(F.col(s + "authorChannelId.value"), F.lit("")).alias("author_channel_id"), F.col(s + "textDisplay").alias("text"), F.coalesce(F.col(s + "likeCount"), F.lit(0)).alias("like_count"),
        F.col(s + "publishedAt").alias("published_at"), F.coalesce("snippet.totalReplyCount", F.lit(0)).alias("reply_count"), "page_pos",
    )
    if per_video is None:
        return flat
    w = Window.partitionBy("video_id").orderBy("page_pos", "comment_id")
    return flat.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= per_video).drop("__k")


def video_ids(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """``video_id, video_pos``: the first ``limit`` videos of the pages of one list, in their order.

    Pages count up to the first without a token for the next, or before the first that is missing. Entries without id
    are left out and take no place. ``limit`` is the feature: what was asked of the channel.
    """
    pages = spark.read.schema(PLAYLIST_PAGES).json(path).filter(F.col("page").isNotNull())
    # the last page of the list by two minima: the first without a token, the first without a successor
    after = pages.select((F.col("page") - 1).alias("page"), F.lit(True).alias("followed"))
    last = pages.join(after, "page", "left").filter(F.col("nextPageToken").isNull() | F.col("followed").isNull()).agg(F.min("page").alias("last"))
    read = pages.join(F.broadcast(last), F.col("page") <= F.col("last"))
    entries = read.select("page", F.posexplode("items").alias("pos", "item")).select("page", "pos", F.col("item.snippet.resourceId.videoId").alias("video_id"))
    kept = entries.filter(F.coalesce("video_id", F.lit("")) != "").orderBy("page", "pos").limit(limit)
    return kept.select("video_id", (F.row_number().over(Window.orderBy("page", "pos")) - 1).alias("video_pos"))  # at most ``limit`` rows


def all_comments(spark: SparkSession, path: str, videos: DataFrame, per_video: int | None = None) -> DataFrame:
    """The comments of ``videos`` (``video_id, video_pos``), with ``ordinal``: by video, then by page. Cleaning takes the first of repeats by it."""
    rows = comments(spark, path, per_video).join(videos.select("video_id", "video_pos"), "video_id")
    return rows.withColumn("ordinal", F.struct("video_pos", "page_pos", "comment_id"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(LABELS).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV parts with a header, one per partition; existing columns only. Arrays are joined by '|'."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    kinds = dict(df.dtypes)
    flat = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in names]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_labelling_sample(sample: DataFrame, path: str) -> None:
    """The sample as one CSV file with a blank ``human_label`` to be filled in; a sample is small by its quota."""
    names = [c.split()[0] for c in LABELS.split(", ")]
    blank = sample.withColumn("human_label", F.lit(""))
    write_csv(blank.coalesce(1), path, names)
