"""Exact quantiles of values with any number of distinct values.

Spark's ``percentile`` keeps a value -> count map per group, which for a continuous value
means that all distinct values of a group meet in one task.  Here rows become (group, value)
counts on both sides of one shuffle, the counts are range-partitioned on (group, value) so
that even a single group is spread, prefix sums give each value the ranks that it holds, and
the two values around each wanted rank are picked out.  Several columns, groups and
quantiles share the one pass; what is collected per group is two values a quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.lookup import settled
from platewise.operators.rank import prefix_sums


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column, n, q0, q1, ...): the quantiles ``probs`` of each of ``values`` per
    group, linearly interpolated, NULLs ignored.  A column without values in a group has no
    row.  Key columns may be NULL."""
    keys = keys or []
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("v")) for n, c in values.items()]))
    long = df.select(*keys, pairs.alias("__p")).select(*keys, F.col("__p.column").alias("column"), F.col("__p.v").alias("__v")).filter(
        F.col("__v").isNotNull())
    by = [*keys, "column"]
    # one text per group: NULL keys would be lost in joins
    counts = long.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__g", F.to_json(F.struct(*by)))
    ranked = prefix_sums(counts.select("__g", "__v", "__c"), ["__v"], {"__before": "__c"}, by=["__g"])
    totals = settled(counts.groupBy("__g", *by).agg(F.sum("__c").alias("__n")))
    # rank of the lower neighbour and the share of the upper one, for every quantile
    place = [F.lit(p) * (F.col("__n") - 1) for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(x).alias("lo"), F.ceil(x).alias("hi"), (x - F.floor(x)).alias("part"))
                       for i, x in enumerate(place)])
    first, end = F.col("__before"), F.col("__before") + F.col("__c")
    hit = F.filter(wanted, lambda w: ((w["lo"] >= first) & (w["lo"] < end)) | ((w["hi"] >= first) & (w["hi"] < end)))
    near = ranked.join(totals, "__g").select("__g", *by, "__n", "__v", "__before", "__c", F.explode(hit).alias("__w"))

    def at(rank: str) -> Column:
        r = F.col(f"__w.{rank}")
        return F.max(F.when((r >= first) & (r < end), F.col("__v")))

    both = near.groupBy("__g", *by, "__n", F.col("__w.i").alias("__i")).agg(
        at("lo").alias("__a"), at("hi").alias("__b"), F.first("__w.part").alias("__part"))
    value = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")
    return both.groupBy("__g", *by, F.col("__n").alias("n")).agg(
        *[F.max(F.when(F.col("__i") == i, value)).alias(f"q{i}") for i in range(len(probs))]).drop("__g")
