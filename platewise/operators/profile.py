"""Profiling aggregates of the analysis notebooks.

Each is one grouped aggregate with map-side combine; shares use the group total from a
scalar subquery rather than a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.lookup import settled, with_scalars
from platewise.operators.quantiles import exact_quantiles


def _n() -> Column:
    return F.count(F.lit(1))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value (share = count / all rows)."""
    counts = df.groupBy(col).agg(_n().alias("n"))
    total = df.agg(_n().alias("total"))
    out, s = with_scalars(counts, total, "__total")
    return out.select(col, "n", (F.col("n") / s["total"]).alias("share"))


def rate_by(df: DataFrame, keys: list[str], indicator: Column) -> DataFrame:
    """Rows and mean of a 0/1 indicator per group."""
    return df.groupBy(*keys).agg(_n().alias("n"), F.sum(indicator.cast("bigint")).alias("n_positive"),
                                 (F.sum(indicator.cast("bigint")) / _n()).alias("rate"))


def mean_by(df: DataFrame, keys: list[str], value: Column, name: str = "mean") -> DataFrame:
    """Group mean."""
    return df.groupBy(*keys).agg(_n().alias("n"), F.avg(value).alias(name))


def labelled_histogram(df: DataFrame, value: str, label: str, bins: int = 40) -> DataFrame:
    """A10: equal-width bins over the joint [min, max] of all rows, count per label;
    the last bin is closed.  Bin edges come from one scalar aggregate."""
    rng = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    d2, s = with_scalars(df.filter(F.col(value).isNotNull()), rng, "__range")
    lo, hi = s["lo"], s["hi"]
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value).cast("double") - lo) * bins / (hi - lo)).cast("int"), F.lit(bins - 1))
    b = F.when(hi == lo, F.lit(0)).otherwise(b)
    binned = d2.withColumns({"bin": b, "__lo": lo, "__w": width})
    return binned.groupBy(label, "bin").agg(
        _n().alias("n"), F.first("__lo").alias("__lo"), F.first("__w").alias("__w")
    ).select(label, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_lo"),
             (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_hi"), "n")


def box_stats(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Per group quartiles, median, whiskers (most extreme values within 1.5 IQR of
    the box) and the number of points beyond them.  The quartiles are exact for values of
    any number (:mod:`platewise.operators.quantiles`)."""
    v = df.select(*keys, value.cast("double").alias("__v"))
    q = exact_quantiles(v, {"v": F.col("__v")}, [0.25, 0.5, 0.75], keys).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    j = v.join(settled(q), keys, "inner")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__v") >= lo) & (F.col("__v") <= hi)
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_fliers"), _n().alias("n"))
