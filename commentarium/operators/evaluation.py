"""Sampling for labels, metrics against them, calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentarium.functions.stats import numbered
from commentarium.operators.scoring import label_by_cuts, label_of
from commentarium.operators.sentiment import rounded

# Classes, and the grids of thresholds and cuts.
CLASSES = ("Positive", "Neutral", "Negative")
THRESHOLDS = (0.45, 0.50, 0.52, 0.55, 0.58, 0.60, 0.65, 0.70)
CUTS = (0.02, 0.05, 0.08, 0.10, 0.12, 0.15, 0.20)


def quotas(df: DataFrame, group: str, n: int) -> DataFrame:
    """``group, size, slots``: shares of ``n`` in proportion to size, at least 1, then one more or less from the largest on until they sum to ``n``."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    totals = sizes.agg(F.sum("size").alias("total"), F.count("*").alias("groups"))
    base = sizes.join(F.broadcast(totals)).withColumn("slots", F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("size") / F.col("total")).cast("long")))
    off = base.agg((F.lit(n) - F.sum("slots")).alias("off"))
    ranked = numbered(base, [F.desc("size"), F.col(group).asc()], "place").withColumn("place", F.col("place") - 1).join(F.broadcast(off))
    turns = F.floor((F.abs("off") - F.col("place") + F.col("groups") - 1) / F.col("groups"))
    turns = F.greatest(turns, F.lit(0))
    slots = F.greatest(F.col("slots") + F.signum("off") * turns, F.lit(0)).cast("long")
    return ranked.select(group, "size", slots.alias("slots"))


def stratified_sample(df: DataFrame, group: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """Each group's quota of rows, in the order of a seeded hash of their id.

    No quota exceeds ``n``, so each task keeps no more than ``n`` rows a group before any shuffle.
    """
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.col(ident), F.lit(str(seed)))), ident)
    first = df.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= n)
    return first.join(quotas(df, group, n), group).filter(F.col("__place") <= F.col("slots")).drop("__place", "size", "slots")


def class_counts(df: DataFrame, truth: str, guess: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Per class: true and false positives, false negatives; from a confusion table of nine cells."""
    cells = df.groupBy(*keys, truth, guess).agg(F.count("*").alias("c"))
    long = cells.select(*keys, "c", F.explode(F.array(*[F.struct(F.lit(x).alias("class"), (F.col(truth) == x).alias("t"), (F.col(guess) == x).alias("g")) for x in CLASSES])).alias("x"))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    return long.groupBy(*keys, "x.class").agg(
        s(F.col("x.t") & F.col("x.g")).alias("tp"), s(~F.col("x.t") & F.col("x.g")).alias("fp"), s(F.col("x.t") & ~F.col("x.g")).alias("fn"), F.sum("c").alias("n")
    )


def f1_scores(df: DataFrame, truth: str, guess: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    counts = class_counts(df, truth, guess, keys)
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("f1", rounded(F.when(bottom > 0, 2 * F.col("tp") / bottom).otherwise(0.0), 4))


def metrics(df: DataFrame, truth: str, guess: str, keys: list[str] = [], all_classes: bool = False, digits: int = 4) -> DataFrame:  # noqa: B006
    """Accuracy and macro F1, over the classes that occur or over all three."""
    per = class_counts(df, truth, guess, keys)
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(bottom > 0, 2 * F.col("tp") / bottom).otherwise(0.0 if all_classes else None)
    return per.groupBy(*keys).agg(F.max("n").alias("n"), rounded(F.sum("tp") / F.max("n"), 4).alias("accuracy"), rounded(F.avg(f1), digits).alias("macro_f1"))


def calibrate(df: DataFrame, truth: str, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Macro F1 at each probability threshold (of the rows that are certain then) and at each pair of score cuts."""
    grid = F.explode(F.array(*map(F.lit, THRESHOLDS)))
    swept = df.withColumn("threshold", grid).withColumn("guess", label_of(F.col("neg_prob"), F.col("neu_prob"), F.col("pos_prob"), F.col("threshold")))
    total = df.agg(F.count("*").alias("all_rows"))
    by_threshold = metrics(swept.filter("guess <> 'Uncertain'"), truth, "guess", ["threshold"], True, digits).join(F.broadcast(total))
    by_threshold = by_threshold.select("threshold", "macro_f1", rounded(F.col("n") / F.col("all_rows"), 4).alias("coverage"), F.col("n").alias("n_certain"))
    cuts = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(-q).alias("q")) for p in CUTS for q in CUTS]))
    cut = df.withColumn("cut", cuts).withColumn("pos_cut", F.col("cut.p")).withColumn("neg_cut", F.col("cut.q"))
    cut = cut.withColumn("guess", label_by_cuts(F.col("sentiment_score"), F.col("pos_cut"), F.col("neg_cut")))
    return by_threshold, metrics(cut, truth, "guess", ["pos_cut", "neg_cut"], True, digits).select("pos_cut", "neg_cut", "macro_f1")


def best_settings(df: DataFrame, truth: str) -> DataFrame:
    """``setting, value, macro_f1``: the threshold and the cuts of highest macro F1; of equal ones the first in its grid."""
    by_threshold, by_cuts = calibrate(df, truth, digits=10)
    best = by_threshold.agg(F.max_by(F.struct(F.col("threshold").alias("value"), "macro_f1"), F.struct("macro_f1", -F.col("threshold"))).alias("b"))
    cuts = by_cuts.agg(F.max_by(F.struct("pos_cut", "neg_cut", "macro_f1"), F.struct("macro_f1", -F.col("pos_cut"), "neg_cut")).alias("b"))
    either = F.array(*[F.struct(F.lit(c).alias("setting"), F.col(f"b.{c}").alias("value"), F.col("b.macro_f1").alias("macro_f1")) for c in ("pos_cut", "neg_cut")])
    rows = best.select(F.lit("threshold").alias("setting"), "b.value", "b.macro_f1").unionByName(cuts.select(F.inline(either)))
    return rows.filter(F.col("value").isNotNull()).withColumn("macro_f1", F.round("macro_f1", 4))
