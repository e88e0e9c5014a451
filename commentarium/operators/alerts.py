"""Groups that differ from the whole, tested and corrected for the number of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.functions import text as T
from commentarium.functions.scalars import grouped, signed
from commentarium.functions.stats import corrected, normal_p_value, t_p_value, t_statistic
from commentarium.operators.sentiment import confident, keyword_hits, rounded

FAMILIES, ITEM_LENGTH = ("sentiment", "velocity", "keyword"), 55
ALPHA, MIN_VIDEO, MIN_MENTIONS, MIN_DELTA, MIN_Z = 0.05, 30, 15, 0.08, 2.5


def mean_shift(rows: DataFrame, key: str, family: str, baseline: DataFrame, min_n: int, correction: str = "bonferroni") -> DataFrame:
    """One-sample t-test of every group of at least ``min_n`` rows against the mean of ``baseline``, corrected over all groups.

    What passes ``correction`` ("bonferroni" or "bh") and is large enough fires.
    """
    per = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n"), F.avg("sentiment_score").alias("mean"), F.stddev_samp("sentiment_score").alias("sd"))
    mu = baseline.agg(F.avg("sentiment_score").alias("mu"))
    tested = per.filter(F.col("n") >= min_n).join(F.broadcast(mu)).withColumn("t", t_statistic(F.col("mean"), F.col("sd"), F.col("n"), F.col("mu")))
    tested = tested.withColumn("p_raw", t_p_value(F.col("t"), F.col("n"))).withColumn("delta", rounded(F.col("mean") - F.col("mu"), 4)).withColumn("family", F.lit(family))
    out = corrected(tested, "p_raw", "family", "item", ALPHA)
    return out.withColumn("fired", F.col(correction) & (F.abs("delta") >= MIN_DELTA))


def volume(rows: DataFrame, key: str, family: str, correction: str = "bonferroni") -> DataFrame:
    """z-score of every group's number of rows; needs three groups and some spread."""
    per = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n"))
    stats = per.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count("*").alias("groups"))
    z = (F.col("n") - F.col("mean")) / F.col("sd")
    tested = per.join(F.broadcast(stats)).filter((F.col("groups") >= 3) & (F.col("sd") > 0)).withColumn("t", z)
    tested = tested.withColumn("p_raw", normal_p_value(F.col("t"))).withColumn("delta", rounded(F.col("t"), 4)).withColumn("family", F.lit(family))
    out = corrected(tested.drop("groups"), "p_raw", "family", "item", ALPHA).withColumn("mu", F.lit(0.0))
    return out.withColumn("fired", F.col(correction) & (F.abs("t") >= MIN_Z))


def all_alerts(scored: DataFrame, keywords: list[str], min_video: int = MIN_VIDEO, min_mentions: int = MIN_MENTIONS, correction: str = "bonferroni") -> DataFrame:
    """The three families in one table: sentiment per video, comments per video, sentiment per keyword."""
    sure = confident(scored)
    hits = keyword_hits(sure, "text", {k: T.keyword_pattern(k, flexible_space=False) for k in keywords})
    parts = [
        mean_shift(sure, "video_id", "sentiment", sure, min_video, correction), volume(scored, "video_id", "velocity", correction),
        mean_shift(hits, "keyword", "keyword", sure, min_mentions, correction),
    ]
    columns = ["family", "item", "n", "t", "delta", "p_raw", "m", "rank", "bonferroni", "bonferroni_p", "bh", "bh_p", "fired"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def family_summary(alerts: DataFrame) -> DataFrame:
    """Per family: tests, those below 0.05 uncorrected, those that pass each correction, those that Bonferroni blocks, those that fire."""
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    per = alerts.groupBy("family").agg(
        F.count("*").alias("m"), one(F.when(F.col("family") == "velocity", F.abs("t") > 2).otherwise(F.col("p_raw") < 0.05)).alias("naive_pass"),
        one(F.col("bonferroni")).alias("bonferroni_pass"), one(F.col("bh")).alias("bh_pass"), one(F.col("fired")).alias("fired"),
    )
    return per.withColumn("blocked", F.col("naive_pass") - F.col("bonferroni_pass"))


def first_alerts(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` alerts that come first: by family, then by size of the difference, then by item."""
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    top = alerts.filter("fired").orderBy(order, F.desc(F.abs("delta")), "item").limit(n)
    return top.select("family", F.left("item", F.lit(ITEM_LENGTH)).alias("item"), signed(F.col("delta"), 3).alias("size"), grouped(F.col("n")).alias("comments"))
