"""Comments as a stream: late rows, repeats within the watermark, counts per week, scores of new comments only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions import text as T
from commentarium.functions.scalars import parse_time
from commentarium.operators.scoring import lexicon_scores
from commentarium.session import shared_dir

#: A comment delivered again so much later than the newest delivery seen isn't told from a new one; older state is dropped.
WATERMARK = "30 days"


def read_comments(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a comments table as they land; rows without id or readable time are left out."""
    schema = spark.read.parquet(path).schema
    place = path[:-1] + "[t]" if path.endswith("t") else path  # a pattern, as the source takes no single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(place)
    rows = rows.withColumn("published", parse_time(F.col("published_at")))
    rows = rows.withColumn("delivered", F.coalesce("fetched_at", "published"))
    return rows.filter(F.col("comment_id").isNotNull() & F.col("published").isNotNull())


def once(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First deliveries only. The watermark follows the time of delivery, so comments published long before count too."""
    return stream.withWatermark("delivered", watermark).dropDuplicatesWithinWatermark(["comment_id"])


def weekly_counts(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Distinct comments and their first known likes per week of publication; a comment delivered again counts once."""
    week = F.window("published", "7 days", startTime="4 days")  # weeks begin on Mondays
    return once(stream, watermark).groupBy(week).agg(F.count("*").alias("comments")).select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "comments")


def score_new(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Scores of comments that weren't delivered before."""
    return lexicon_scores(once(stream, watermark).withColumn("cleaned_text", T.cleaned(F.col("text")))).select("comment_id", "sentiment_score", "sentiment_label")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that has landed and read its result: appended rows, or for 'complete' the last table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
