"""Cleaning: sentinel handling, median/mode fills, IQR outlier checks (P1, P2, P16,
P18, P19, A1-A6, J5, M22).

Exact medians and quartiles use Spark's ``percentile`` aggregate, whose partial state is
a value -> count map: its size follows the number of *distinct* values (a few hundred
integer temperatures), not the number of rows, so it combines map-side and never
gathers a group's rows in one task.  Pass ``approx=True`` for continuous columns with
unbounded distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import vocab as V
from platewise.operators.lookup import settled, with_scalars

TEMP_KEYS = ("steel_kind", "rolling_method")


def _median(c: Column, approx: bool = False) -> Column:
    return F.percentile_approx(c, 0.5, 100_000) if approx else F.median(c)


def flag_missing_temp(df: DataFrame, col: str = "rolling_temp",
                      flag: str = "rolling_temp_was_missing") -> DataFrame:
    """1 when the reading is a non-positive sentinel; a NULL reading gives 0."""
    return df.withColumn(flag, F.coalesce(F.col(col) <= 0, F.lit(False)).cast("int"))


def sentinel_to_null(df: DataFrame, col: str = "rolling_temp") -> DataFrame:
    """Non-positive readings become NULL; NULL stays NULL."""
    return df.withColumn(col, F.when(F.col(col) > 0, F.col(col)))


def group_medians(df: DataFrame, col: str = "rolling_temp", keys=TEMP_KEYS,
                  name: str = "group_median", approx: bool = False) -> DataFrame:
    """A1: median of the positive readings per group (NULLs and sentinels ignored)."""
    c = F.col(col)
    return df.groupBy(*keys).agg(_median(F.when(c > 0, c), approx).alias(name))


def global_median(df: DataFrame, col: str = "rolling_temp", approx: bool = False) -> DataFrame:
    """A2: one-row median of the positive readings."""
    c = F.col(col)
    return df.agg(_median(F.when(c > 0, c), approx).alias("global_median"))


def impute_group_median(df: DataFrame, col: str = "rolling_temp", keys=TEMP_KEYS,
                        out: str | None = None, global_after_group: bool = True,
                        medians: DataFrame | None = None, fallback: DataFrame | None = None,
                        approx: bool = False) -> DataFrame:
    """Fill missing/sentinel readings by the group median, else a global median.

    ``global_after_group=True`` (analysis order): the fallback is the median of the
    column *after* the group fill; False (training order): the median of the raw
    positive readings.  ``medians``/``fallback`` may come from a fitted training set
    (see :func:`fit_temp_imputer`) to avoid leakage.  An all-NULL group falls through
    to the fallback (coalesce), never to NaN.
    """
    out = out or col
    c = F.col(col)
    if medians is None and fallback is None and not global_after_group:
        medians, fallback = fit_temp_imputer(df, col, keys, approx)
    med = medians if medians is not None else group_medians(df, col, keys, approx=approx)
    joined = df.join(settled(med) if medians is None else med, list(keys), "left")
    grouped = F.coalesce(F.when(c > 0, c).cast("double"), F.col("group_median").cast("double"))
    if fallback is None:
        if global_after_group:
            fallback = joined.agg(_median(grouped, approx).alias("global_median"))
        else:
            fallback = global_median(df, col, approx)
    joined, s = with_scalars(joined, fallback, "__temp_fallback")
    return (joined.withColumn(out, F.coalesce(grouped, s["global_median"].cast("double")))
            .drop("group_median", "__temp_fallback"))


def fit_temp_imputer(train: DataFrame, col: str = "rolling_temp", keys=TEMP_KEYS,
                     approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """Group and global medians of a training frame from ONE aggregate (grouping sets
    ``(keys), ()``), stored so that every later use reads the same fitted values."""
    c = F.col(col)
    stats = settled(train.groupingSets([list(keys), []], *keys).agg(
        _median(F.when(c > 0, c), approx).alias("m"), F.grouping_id().alias("__gid")))
    return (stats.filter("__gid = 0").select(*keys, F.col("m").alias("group_median")),
            stats.filter("__gid <> 0").agg(F.max("m").alias("global_median")))


def fill_medians(df: DataFrame, cols=V.MEDIAN_FILL_COLUMNS, approx: bool = False) -> DataFrame:
    """NULLs in numeric columns -> that column's median, all in one aggregate.
    Filled columns are DOUBLE (a median of integers may end in .5)."""
    cols = [c for c in cols if c in df.columns]
    med = df.agg(*[_median(F.col(c), approx).alias(c) for c in cols])
    df2, s = with_scalars(df, med, "__medians")
    return df2.withColumns({c: F.coalesce(F.col(c).cast("double"), s[c]) for c in cols}).drop("__medians")


def fill_modes(df: DataFrame, cols=V.MODE_FILL_COLUMNS) -> DataFrame:
    """NULLs in text columns -> most frequent value (smallest on ties)."""
    cols = [c for c in cols if c in df.columns]
    modes = df.agg(*[F.mode(c, deterministic=True).alias(c) for c in cols])
    df2, s = with_scalars(df, modes, "__modes")
    return df2.withColumns({c: F.coalesce(F.col(c), s[c]) for c in cols}).drop("__modes")


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: (column, null_count) for every column, one pass over the data."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def quartiles(df: DataFrame, cols=V.OUTLIER_COLUMNS, approx: bool = False) -> DataFrame:
    """One-row frame with ``<col>__1`` / ``<col>__3`` quartiles (linear interpolation)."""
    def q(c: str, p: float) -> Column:
        return (F.percentile_approx(F.col(c), p, 100_000) if approx else F.percentile(F.col(c), p)).cast("double")
    return df.agg(*[q(c, p).alias(f"{c}__{i}") for c in cols for i, p in ((1, 0.25), (3, 0.75))])


def _fences(qrow, c: str) -> tuple[Column, Column, Column, Column]:
    q1, q3 = qrow[f"{c}__1"], qrow[f"{c}__3"]
    return q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def _bound_rows(qrow, cols, extra=None) -> Column:
    items = []
    for c in cols:
        q1, q3, lo, hi = _fences(qrow, c)
        fields = [F.lit(c).alias("column"), q1.alias("q1"), q3.alias("q3"), lo.alias("lower"), hi.alias("upper")]
        if extra:
            fields.append(extra(c).alias("n_outliers"))
        items.append(F.struct(*fields))
    return F.explode(F.array(*items))


def iqr_bounds(df: DataFrame, cols=V.OUTLIER_COLUMNS, approx: bool = False) -> DataFrame:
    """A4: quartiles and Tukey fences per column (one aggregate pass)."""
    qs = quartiles(df, cols, approx)
    return qs.select(_bound_rows(F.struct(*qs.columns), cols).alias("b")).select("b.*")


def flag_outliers(df: DataFrame, cols=V.OUTLIER_COLUMNS, approx: bool = False) -> DataFrame:
    """Add ``<col>_is_outlier`` flags; rows are counted, never dropped."""
    df2, s = with_scalars(df, quartiles(df, cols, approx), "__quartiles")
    flags = {}
    for c in cols:
        _, _, lo, hi = _fences(s, c)
        flags[f"{c}_is_outlier"] = F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return df2.withColumns(flags).drop("__quartiles")


def outlier_counts(df: DataFrame, cols=V.OUTLIER_COLUMNS, approx: bool = False) -> DataFrame:
    """Per column, the fences and the number of rows outside them: one pass for the
    quartiles (a scalar subquery) and one counting pass."""
    qs = quartiles(df, cols, approx)
    df2, s = with_scalars(df, qs, "__quartiles")
    counts = df2.agg(*[F.count_if((F.col(c) < _fences(s, c)[2]) | (F.col(c) > _fences(s, c)[3])).alias(f"{c}__n")
                       for c in cols], F.first("__quartiles").alias("__quartiles"))
    qrow = F.col("__quartiles")
    return counts.select(_bound_rows(qrow, cols, extra=lambda c: F.col(f"{c}__n")).alias("b")).select("b.*")


def clean(df: DataFrame, approx: bool = False) -> DataFrame:
    """The full cleaning chain of the analysis path, in its order:
    flag sentinel temps, NULL them, fill by (steel_kind, rolling_method) median with a
    global fallback, median-fill numeric columns, mode-fill text columns.

    Every statistic the later steps need is unaffected by the earlier fills except the
    temperature fallback, so all of them come from ONE aggregate over the group-filled
    frame (a scalar subquery): the source is scanned for the group medians, for that
    aggregate, and for the output - not once per step.
    """
    t = F.col("rolling_temp")
    flagged = df.withColumn("rolling_temp_was_missing", F.coalesce(t <= 0, F.lit(False)).cast("int"))
    med = group_medians(flagged, approx=approx)
    joined = flagged.join(settled(med), list(TEMP_KEYS), "left")
    grouped = F.coalesce(F.when(t > 0, t).cast("double"), F.col("group_median").cast("double"))
    nums = [c for c in V.MEDIAN_FILL_COLUMNS if c in df.columns and c != "rolling_temp"]
    cats = [c for c in V.MODE_FILL_COLUMNS if c in df.columns]
    stats = joined.agg(
        _median(grouped, approx).alias("rolling_temp"),
        *[_median(F.col(c), approx).alias(c) for c in nums],
        *[F.mode(c, deterministic=True).alias(c) for c in cats])
    out, s = with_scalars(joined.withColumn("rolling_temp", grouped), stats, "__clean_stats")
    fills = {"rolling_temp": F.coalesce(F.col("rolling_temp"), s["rolling_temp"])}
    fills.update({c: F.coalesce(F.col(c).cast("double"), s[c]) for c in nums})
    fills.update({c: F.coalesce(F.col(c), s[c]) for c in cats})
    return out.withColumns(fills).drop("group_median", "__clean_stats").select(
        *df.columns, "rolling_temp_was_missing")
