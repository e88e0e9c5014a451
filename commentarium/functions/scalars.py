"""Scalar expressions on times, durations, titles and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO times in any of their forms as UTC; blank and unreadable ones are null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def parse_duration(text: Column) -> Column:
    """Seconds of an ISO duration with hours, minutes and seconds; anything else, days too, is 0."""
    # Fixed value: the shape of a duration.
    shape = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    part = lambda k: F.coalesce(F.regexp_extract(text, shape, k).try_cast("bigint"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def duration_text(seconds: Column) -> Column:
    # The form of the text, and what stands for none.
    return F.when(seconds > 0, F.format_string("%dm %ds", (seconds / 60).cast("bigint"), seconds % 60)).otherwise("N/A")


def iso_week(ts: Column) -> Column:
    """Year and week of ISO 8601, as 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full periods of 24 hours between two times (not calendar days)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def engagement_rate(likes: Column, comments: Column, views: Column) -> Column:
    """Likes and comments per hundred views; zero views count as one."""
    return F.round((F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0))) / F.when(F.coalesce(views, F.lit(0)) == 0, 1).otherwise(views) * 100, 2)


def topic_label(keywords: Column) -> Column:
    """Of the first four keywords those longer than two letters, capitalised; 'General' if none is left."""
    # Four keywords, the joiner and the label of none.
    kept = F.filter(F.slice(keywords, 1, 4), lambda w: F.length(w) > 2)
    named = F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.when(F.size(kept) == 0, "General").otherwise(F.array_join(named, " · "))


def signed(number: Column, digits: int) -> Column:
    """A number with its sign and a fixed number of digits."""
    return F.format_string(f"%+.{digits}f", number.cast("double"))


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands; null stays null."""
    return F.when(number.isNotNull(), F.format_string("%,d", number.cast("bigint")))


def titled(df: DataFrame) -> DataFrame:
    """All columns renamed from snake_case to words with capitals."""
    return df.withColumnsRenamed({c: c.replace("_", " ").title() for c in df.columns})
