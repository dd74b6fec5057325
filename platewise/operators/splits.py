"""Leakage-aware splits and sampling (W7, M20, M21, M9 folds, T9, A12, A13).

* ``time_split``: exact positional split on (time, key) using the distributed global
  rank - no single-task sort; ⌊0.15·n⌋ is computed in DOUBLE arithmetic.
* ``group_split``: whole groups go to one side; groups are ordered by md5(seed||group)
  and the first ⌈test_size·G⌉ form the test side (deterministic in any engine).
* ``stratified_folds``: the fold layout of an unshuffled stratified K-fold - per class,
  contiguous blocks in data order, block sizes from dealing the label-sorted vector
  round-robin over the folds; classes are encoded in order of first appearance.
* ``background_sample``: n rows by md5(seed||key) order, a deterministic top-k.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.lookup import settled, with_scalars
from platewise.operators.rank import global_rank, global_rank_with_total


def time_split(df: DataFrame, ts: str = "rolling_date", key: str = "plate_no",
               valid_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """Add ``pos`` (0-based rank by ts, key) and ``split`` in {train, valid, test}."""
    ranked, n = global_rank_with_total(df, [ts, key], "pos")
    n_test = int(n * float(test_size))      # floor in DOUBLE arithmetic, as published
    n_valid = int(n * float(valid_size))
    n_train = n - n_valid - n_test
    split = (F.when(F.col("pos") < n_train, "train")
             .when(F.col("pos") < n_train + n_valid, "valid").otherwise("test"))
    return ranked.withColumn("split", split)


def split_profile(df: DataFrame, split: str = "split", ts: str = "rolling_date",
                  target: str = "target", group: str = "work_group") -> DataFrame:
    """Rows, date range, defect rate and sorted member groups per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("min_date"), F.max(ts).alias("max_date"),
        F.avg(F.col(target).cast("double")).alias("defect_rate"),
        F.array_join(F.array_sort(F.collect_set(group)), ",").alias("groups"))


def group_split(df: DataFrame, group: str = "work_group", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` in {train, test}; every group lies wholly on one side."""
    groups = df.select(group).distinct().filter(F.col(group).isNotNull())
    hashed = groups.withColumn("__h", F.md5(F.concat(F.lit(str(seed)), F.col(group))))
    ranked, g = global_rank_with_total(hashed, ["__h", group], "__gpos")
    n_test = math.ceil(g * float(test_size))
    side = ranked.select(group, F.when(F.col("__gpos") < n_test, "test").otherwise("train").alias("split"))
    return df.join(settled(side), group, "left")


def _count_mod(x: Column, f: int, k: int) -> Column:
    """#{p in [0, x) : p mod k == f} for x >= 0."""
    return F.floor((x - f + (k - 1)) / k)


def stratified_folds(df: DataFrame, label: str, order: str, k: int = 5) -> DataFrame:
    """M9: add ``fold`` in [0, k) following an unshuffled stratified K-fold."""
    first = df.agg(F.min_by(F.col(label), F.col(order)).alias("first_label"),
                   F.count(F.lit(1)).alias("n"))
    d2, s = with_scalars(df, first, "__first")
    enc = d2.withColumn("__enc", (F.col(label) != s["first_label"]).cast("int")).drop("__first")
    n0 = enc.agg(F.count_if(F.col("__enc") == 0).alias("n0"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(enc, ["__enc", order], "__q")
    ranked, t = with_scalars(ranked, n0, "__n0")
    a = F.when(F.col("__enc") == 0, F.lit(0)).otherwise(t["n0"])
    b = F.when(F.col("__enc") == 0, t["n0"]).otherwise(t["n"])
    r = F.col("__q") - a
    cum = F.lit(0)
    fold = F.lit(0)
    for f in range(k):
        cum = cum + (_count_mod(b, f, k) - _count_mod(a, f, k))
        if f < k - 1:
            fold = fold + (cum <= r).cast("int")
    return ranked.withColumn("fold", fold.cast("int")).drop("__enc", "__q", "__n0")


def background_sample(df: DataFrame, key: str = "plate_no", n: int = 100, seed: int = 42) -> DataFrame:
    """min(n, rows) rows in md5(seed||key) order, with their sample rank."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    top = df.withColumn("__h", h).orderBy("__h", key).limit(n)
    # The window runs over at most n rows (after the top-k limit).
    return top.withColumn("sample_rank", F.row_number().over(Window.orderBy("__h", key))).drop("__h")
