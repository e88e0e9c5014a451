"""Test statistics as expressions; distribution functions come from a library that Spark ships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentarium.session import written

_BETA, _ERF = "org.apache.commons.math3.special.Beta", "org.apache.commons.math3.special.Erf"


def t_statistic(mean: Column, sd: Column, n: Column, mu: Column) -> Column:
    """One-sample t; infinite where the values don't vary and differ from ``mu``, null where they don't vary and don't differ."""
    delta = mean - mu
    flat = F.when(delta == 0, F.lit(None).cast("double")).otherwise(F.signum(delta) * F.lit(float("inf")))
    return F.when(n > 1, F.when(sd == 0, flat).otherwise(delta / (sd / F.sqrt(n))))


def t_p_value(t: Column, n: Column) -> Column:
    """Two-sided p of a t statistic with n - 1 degrees of freedom."""
    v = (n - 1).cast("double")
    x = F.coalesce(v / (v + t * t), F.lit(1.0))
    p = F.reflect(F.lit(_BETA), F.lit("regularizedBeta"), x, F.greatest(v, F.lit(1.0)) / 2, F.lit(0.5)).cast("double")
    return F.when(t.isNotNull(), F.when(F.abs(t) == float("inf"), 0.0).otherwise(p))


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    x = F.coalesce(F.abs(z) / F.sqrt(F.lit(2.0)), F.lit(0.0))
    return F.when(z.isNotNull(), F.reflect(F.lit(_ERF), F.lit("erfc"), x).cast("double"))


def numbered(df: DataFrame, order: list[Column], name: str, family: str | None = None) -> DataFrame:
    """Adds ``name``, the place (from 1) of every row in ``order``, within its family; no task holds a family.

    Rows are partitioned by ranges of the order and stored, numbered within each partition, and the sizes of the
    partitions before are added. Only those sizes, one row a partition and family, are summed up in one place.
    """
    keys = [F.col(family)] if family else []
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    stored = written(ranged, "ranged")
    group = [family, "__part"] if family else ["__part"]
    sizes = stored.groupBy(*group).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    placed = stored.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.join(offsets, group).withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def corrected(df: DataFrame, p: str, family: str, order: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg decisions and adjusted p per family, which may be of any size.

    Null p-values count in the family's size, come last and never pass.
    """
    ranked = numbered(df, [F.col(p).asc_nulls_last(), F.col(order).asc()], "rank", family)
    sizes = df.groupBy(family).agg(F.count("*").alias("m"))
    sized = ranked.join(sizes, family)
    passing = F.when(F.col(p) <= F.col("rank") * F.lit(alpha) / F.col("m"), F.col("rank"))
    last = sized.groupBy(family).agg(F.max(passing).alias("__last"))
    return (
        sized.join(last, family)
        .withColumn("bonferroni", F.coalesce(F.col(p) < F.lit(alpha) / F.col("m"), F.lit(False)))
        .withColumn("bonferroni_p", F.least(F.col(p) * F.col("m"), F.lit(1.0)))
        .withColumn("bh", F.coalesce((F.col("rank") <= F.col("__last")) & F.col(p).isNotNull(), F.lit(False)))
        .withColumn("bh_p", F.least(F.col(p) * F.col("m") / F.col("rank"), F.lit(1.0)))
        .drop("__last")
    )
