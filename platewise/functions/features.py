"""Derived process features as column expressions.

Two forms exist because the analysis and the serving code disagree on edges:
thickness buckets are right-closed in analysis and left-closed in serving, and a zero
furnace time gives the median cooling rate in analysis but 0.0 in serving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import vocab as V


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def thick_bucket(c, closed: str = "left") -> Column:
    """Thickness bucket.  closed='left': [.,20) [20,40) [40,60) [60,.) (serving);
    closed='right': (0,20] (20,40] (40,60] (60,inf) and non-positive -> NULL (analysis)."""
    c = _c(c)
    a, b, d = V.THICK_EDGES
    t0, t1, t2, t3 = V.THICK_LABELS
    if closed == "left":
        return (F.when(c < a, t0).when(c < b, t1).when(c < d, t2)
                .when(c.isNotNull(), t3))
    return (F.when(c <= 0, None).when(c <= a, t0).when(c <= b, t1).when(c <= d, t2)
            .when(c.isNotNull(), t3))


def temp_bin(c) -> Column:
    """Right-closed bins (0,800] (800,850] ... (1000,inf); non-positive or NULL -> NULL.
    Note 1000 falls in '950-1000' although its over-1000 flag is 1."""
    c = _c(c)
    edges, labels = V.TEMP_BIN_EDGES, V.TEMP_BIN_LABELS
    expr = F.when(c <= edges[0], None)
    for hi, lab in zip(edges[1:], labels[:-1]):
        expr = expr.when(c <= hi, lab)
    return expr.when(c.isNotNull(), labels[-1])


def over_1000(temp) -> Column:
    return (_c(temp) >= V.ROLLING_TEMP_CRITICAL).cast("int")


def cooling_rate(temp_drop, total_time, zero_fill: Column | None = None) -> Column:
    """temp_drop / total_time; a zero (or NULL) time yields ``zero_fill`` (0.0)."""
    zero_fill = F.lit(0.0) if zero_fill is None else zero_fill
    return F.coalesce(F.try_divide(_c(temp_drop).cast("double"),
                                   F.nullif(_c(total_time).cast("double"), F.lit(0.0))), zero_fill)


def rolling_dow(ts) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(ts))


def serving_features(df: DataFrame, temp_col: str = "rolling_temp", keep: list[str] | None = None) -> DataFrame:
    """The 28 model features of the serving path, one row in, one row out.

    Expects: pt_*, fur_* (fur_no and fur_input_row as integers or tokens), hsb_applied
    (boolean), rolling_method (normalised), ``temp_col`` already imputed, descaling_count,
    work_group, spec_country, steel_kind, rolling_date.
    """
    hsb = F.col("hsb_applied").cast("int")
    temp = F.col(temp_col).cast("double")
    soak = F.col("fur_soak_temp").cast("double")
    drop = soak - temp
    over = over_1000(temp)
    desc = F.col("descaling_count").cast("int")
    cols = [
        F.col("pt_thick").cast("double").alias("pt_thick"),
        F.col("pt_width").cast("double").alias("pt_width"),
        F.col("pt_length").cast("double").alias("pt_length"),
        F.col("fur_heat_temp").cast("double").alias("fur_heat_temp"),
        F.col("fur_heat_time").cast("double").alias("fur_heat_time"),
        soak.alias("fur_soak_temp"),
        F.col("fur_soak_time").cast("double").alias("fur_soak_time"),
        F.col("fur_total_time").cast("double").alias("fur_total_time"),
        temp.alias("rolling_temp"),
        desc.alias("descaling_count"),
        drop.alias("temp_drop"),
        (F.col("fur_heat_temp").cast("double") - soak).alias("heat_soak_gap"),
        cooling_rate(drop, F.col("fur_total_time")).alias("cooling_rate_proxy"),
        (hsb * temp).alias("hsb_x_rolling_temp"),
        (hsb * desc).alias("hsb_x_descaling"),
        F.hour("rolling_date").alias("rolling_hour"),
        rolling_dow("rolling_date").alias("rolling_dow"),
        hsb.alias("hsb_applied"),
        over.alias("rolling_temp_over_1000"),
        (hsb * over).alias("hsb_x_over1000"),
        (F.pmod(desc, F.lit(2)) == 1).cast("int").alias("descaling_is_odd"),
        F.col("spec_country"),
        F.col("steel_kind"),
        F.col("fur_no").cast("string").alias("fur_no"),
        F.col("fur_input_row").cast("string").alias("fur_input_row"),
        F.col("rolling_method"),
        F.col("work_group"),
        thick_bucket(F.col("pt_thick"), "left").alias("thick_bucket"),
    ]
    return df.select(*(keep or []), *cols)


def analysis_features(df: DataFrame) -> DataFrame:
    """Feature derivation of the analysis path over a cleaned flat log.

    Adds hsb_applied, temp_drop, heat_soak_gap, rolling_temp_over_1000, rolling_temp_bin,
    the three HSB interactions, right-closed thick_bucket, cooling_rate_proxy (zero time
    -> median of the defined rates), descaling_is_odd, rolling_hour, rolling_dow, target.
    The median of the rates, a continuous value, is counted out over all tasks when this is
    called; the rest is lazy.
    """
    from platewise.operators.quantiles import exact_quantiles

    hsb = (F.col("hsb") == V.HSB_ON).cast("int")
    temp = F.col("rolling_temp")
    base = df.withColumns({
        "hsb_applied": F.coalesce(hsb, F.lit(0)),
        "temp_drop": F.col("fur_soak_temp") - temp,
        "heat_soak_gap": F.col("fur_heat_temp") - F.col("fur_soak_temp"),
        "rolling_temp_over_1000": F.coalesce(over_1000(temp), F.lit(0)),
        "rolling_temp_bin": temp_bin(temp),
    })
    raw_rate = F.try_divide(F.col("temp_drop").cast("double"),
                            F.nullif(F.col("fur_total_time").cast("double"), F.lit(0.0)))
    rate_median = exact_quantiles(base, {"rate": raw_rate}, [0.5]).agg(F.max("q0").alias("m"))
    return base.withColumns({
        "hsb_x_rolling_temp": F.col("hsb_applied") * temp,
        "hsb_x_over1000": F.col("hsb_applied") * F.col("rolling_temp_over_1000"),
        "hsb_x_descaling": F.col("hsb_applied") * F.col("descaling_count"),
        "thick_bucket": thick_bucket(F.col("pt_thick"), "right"),
        "cooling_rate_proxy": F.coalesce(raw_rate, rate_median.scalar()),
        "descaling_is_odd": (F.pmod(F.col("descaling_count"), F.lit(2)) == 1).cast("int"),
        "rolling_hour": F.hour("rolling_date"),
        "rolling_dow": rolling_dow("rolling_date"),
        "target": F.coalesce((F.col("scale") == V.SCALE_DEFECT).cast("int"), F.lit(0)),
    })
