"""Scoring of whole tables and scenario grids.

Two scorers share one output contract ``(predicted_prob, predicted_label)``:
* a linear-logistic scorer with explicit coefficients (closed form, runs as a column
  expression inside whole-stage codegen - used by the SQL-checked queries);
* a fitted Spark ML ``PipelineModel`` (see :mod:`platewise.plans.training`).

The label uses the unrounded probability against the threshold; the stored and ordered
probability is rounded to 4 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import vocab as V

# A fixed linear-logistic scorer over serving features.  These are our own reference
# coefficients (log-odds per unit), not fitted values: they encode the three published
# signals (breaker off, >= 1000 C, small temperature drop) plus the odd-descaling flag.
RULEBOOK_INTERCEPT = 7.3
RULEBOOK_COEFS = {
    "hsb_applied": -4.0,
    "rolling_temp_over_1000": 3.5,
    "temp_drop": -0.03,
    "descaling_is_odd": 0.8,
    "cooling_rate_proxy": -0.5,
    "pt_thick": 0.01,
    "fur_heat_time": -0.002,
    "heat_soak_gap": 0.01,
    "descaling_count": 0.05,
}


def logit(coefs: dict[str, float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for name, w in coefs.items():
        z = z + F.lit(float(w)) * F.col(name).cast("double")
    return z


def score_linear(df: DataFrame, coefs: dict[str, float] = RULEBOOK_COEFS, intercept: float = RULEBOOK_INTERCEPT,
                 threshold: float = 0.5, out_prob: str = "prob") -> DataFrame:
    """Add the raw probability ``prob`` and ``predicted_label`` (prob >= threshold)."""
    p = 1.0 / (1.0 + F.exp(-logit(coefs, intercept)))
    return df.withColumn(out_prob, p).withColumn("predicted_label", F.col(out_prob) >= F.lit(float(threshold)))


def present(df: DataFrame, prob: str = "prob", label: str | None = "target") -> DataFrame:
    """Report columns of a scored row: rounded probability, label, actual, correct."""
    cols = {"predicted_prob": F.round(F.col(prob), 4)}
    if label:
        actual = F.col(label).cast("boolean")
        cols.update({"actual_label": actual, "correct": actual == F.col("predicted_label")})
    return df.withColumns(cols)


def risk_tier(prob: Column) -> Column:
    """>= 0.7 high, >= 0.3 mid, else low; NULL -> N/A."""
    return (F.when(prob.isNull(), V.RISK_NONE).when(prob >= 0.7, V.RISK_HIGH)
            .when(prob >= 0.3, V.RISK_MID).otherwise(V.RISK_LOW))


def risk_ranking(scored: DataFrame, k: int | None = 200, key: str = "plate_no") -> DataFrame:
    """Rows by rounded probability, highest first, key as the stable tie-break;
    top-k is the feature here (a TakeOrdered: per-partition top-k, then merge).
    Adds ``n_total`` ("k of N") from a scalar count."""
    ordered = scored.orderBy(F.col("predicted_prob").desc(), F.col(key).asc())
    top = ordered.limit(k) if k else ordered
    from platewise.operators.lookup import with_scalars
    out, s = with_scalars(top, scored.agg(F.count(F.lit(1)).alias("n_total")), "__total")
    return out.withColumn("n_total", s["n_total"]).drop("__total")


def file_summary(scored: DataFrame, model_label: Column | str, has_actual: bool = True) -> DataFrame:
    """A19 + A14/A15: totals, predicted defects and rate (0.0 if empty), model label and,
    with actual labels, accuracy / precision / recall and the confusion cells."""
    pred = F.col("predicted_label")
    aggs = [F.count(F.lit(1)).alias("total_rows"), F.count_if(pred).alias("predicted_defect_count")]
    if has_actual:
        y = F.col("actual_label")
        aggs += [F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"),
                 F.count_if(~y & ~pred).alias("tn"), F.count_if(y & ~pred).alias("fn")]
    s = scored.agg(*aggs)

    def ratio(a, b):
        return F.round(F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0)), 4)

    s = s.withColumns({
        "predicted_defect_rate": ratio(F.col("predicted_defect_count"), F.col("total_rows")),
        "model_version": model_label if isinstance(model_label, Column) else F.lit(model_label),
        "has_actual_labels": F.lit(has_actual),
    })
    if has_actual:
        tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
        s = s.withColumns({"accuracy": ratio(tp + tn, F.col("total_rows")), "precision": ratio(tp, tp + fp),
                           "recall": ratio(tp, tp + fn)})
    return s


def scenario_grid(base: DataFrame, temps: list[int], col: str = "rolling_temp") -> DataFrame:
    """Every base row under every candidate reading (an explode of a literal
    array - no join), tagged with ``scenario_temp``.  NULL candidates are imputed
    downstream exactly like a missing reading."""
    arr = F.array(*[F.lit(t) for t in temps])
    return base.withColumn("scenario_temp", F.explode(arr)).withColumn(col, F.col("scenario_temp"))


def model_label(name: Column | str, version: Column | str) -> Column:
    """'<name> <version>' (plain strings are literals)."""
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.concat_ws(" ", lit(name), lit(version))
