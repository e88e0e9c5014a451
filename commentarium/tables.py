"""The input tables and the rules for which of their rows count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The one current row of every non-null ``key``: the first in ``order``.

    ``row_number() = 1`` lets Spark drop superseded rows before the shuffle (WindowGroupLimit). Rows with a null
    key identify nothing and are left out. One group holds the deliveries of one key only.
    """
    wanted = columns or df.columns
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.filter(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(w))
    return ranked.filter("__rank = 1").select(*wanted)


def current_comments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current row per comment_id: the greatest ordinal."""
    if columns is not None:
        df = df.select(*dict.fromkeys([*columns, "comment_id", "ordinal"]))
    return latest(df, "comment_id", [F.col("ordinal").desc_nulls_last()], columns)


def current_videos(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current row per video_id: the last fetched, of equal times the one with more views."""
    if columns is not None:
        df = df.select(*dict.fromkeys([*columns, "video_id", "fetched_at", "view_count"]))
    order = [F.col("fetched_at").desc_nulls_last(), F.col("view_count").desc_nulls_last()]
    return latest(df, "video_id", order, columns)


def distinct_fans(df: DataFrame) -> DataFrame:
    """One row per fan; some are repeated exactly."""
    order = [F.col("comment_count").desc_nulls_last(), F.col("likes_earned").desc_nulls_last(), F.col("recency").asc_nulls_last()]
    return latest(df, "author_channel_id", order)


def hashed_sample(df: DataFrame, ident: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``ident``: always the same ones, spread over the whole table.

    Rows are first thinned by the hash to a little more than wanted, so that what is sorted in one place doesn't grow
    with the table.
    """
    n = df.count()
    share = min(1.0, (1.5 * rows + 100) / max(1, n))
    place = F.pmod(F.xxhash64(F.col(ident)), F.lit(1 << 30))
    return df.filter(place <= int(share * (1 << 30))).orderBy(place, ident).limit(rows)
