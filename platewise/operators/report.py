"""Report tables.

Dashboard figures are four scalar aggregates joined as one row through scalar
subqueries; "today" is a half-open range on the timestamp so the filter stays
pushable to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import vocab as V
from platewise.operators.rank import latest_by


def same_day(ts: Column, day: Column) -> Column:
    """Ts within [day, day + 1) - a range, not date(ts) = day."""
    start = day.cast("timestamp_ntz")
    return (ts >= start) & (ts < F.timestamp_add("DAY", F.lit(1), start))


def dashboard_summary(plates: DataFrame, predictions: DataFrame, alert_state: DataFrame,
                      active: DataFrame, as_of: DataFrame) -> DataFrame:
    """Plates created on the day, predicted defect rate over all predictions of
    the day (NULL when none), open alerts, active model label."""
    d = as_of.select(F.col(as_of.columns[0]).alias("d")).scalar()
    n_plates = plates.filter(same_day(F.col("created_at"), d)).agg(F.count(F.lit(1)).alias("v")).scalar()
    today = predictions.filter(same_day(F.col("predicted_at"), d))
    rate = today.agg(F.when(F.count(F.lit(1)) > 0, F.count_if("predicted_label") / F.count(F.lit(1))).alias("v")).scalar()
    n_open = alert_state.filter(F.col("resolved_at").isNull()).agg(F.count(F.lit(1)).alias("v")).scalar()
    label = active.filter(F.col("name") == V.MODEL_NAME).agg(F.max("model_label").alias("v")).scalar()
    return plates.sparkSession.range(1).select(
        F.date_format(d, "yyyy-MM-dd").alias("as_of_date"), n_plates.alias("today_plate_count"), rate.alias("today_predicted_defect_rate"),
        n_open.alias("open_alert_count"), label.alias("active_model"))


def latest_prediction_report(predictions: DataFrame, models: DataFrame, attributions: DataFrame,
                             key: str = "plate_no") -> DataFrame:
    """Newest prediction per plate, model label, and the top features joined in
    rank order as text (name:contribution rounded to 4)."""
    latest = latest_by(predictions, [key], [F.col("predicted_at").desc(), F.col("model_id").desc()])
    if "top_features" in attributions.columns:      # already one row per key
        feats = attributions.select(key, "top_features")
    else:                                          # long (key, rank, feature) rows
        feats = attributions.groupBy(key).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]), ",").alias("top_features"))
    out = (latest.join(models, "model_id", "left").join(feats, key, "left"))
    return out.select(key, "predicted_at", "predicted_prob", "predicted_label",
                      F.concat_ws(" ", "name", "version").alias("model_version"), "top_features")


def logged_prediction_report(predictions: DataFrame, explanations: DataFrame, versions: DataFrame) -> DataFrame:
    """J7/W5 over the logged tables: the newest prediction of each plate, the label of the
    version that made it, and its own ranked features as an array of (rank, feature_name,
    feature_value, shap_value); joined by prediction id, so an older prediction's features
    never show."""
    latest = latest_by(predictions, ["plate_no"], [F.col("predicted_at").desc(), F.col("id").desc()])
    # at most the logged number of features per prediction
    feats = explanations.groupBy("prediction_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "feature_name", "feature_value", "shap_value"))).alias("top_features"))
    label = versions.select(F.col("id").alias("model_version_id"), F.concat_ws(" ", "name", "version").alias("model_version"))
    return latest.join(label, "model_version_id", "left").join(feats.withColumnRenamed("prediction_id", "id"), "id", "left").select(
        "id", "plate_no", "predicted_at", "predicted_prob", "predicted_label", "model_version", "top_features")


def severity_label(c: Column) -> Column:
    """unknown codes pass through unchanged."""
    m = F.create_map(*[x for k, v in V.SEVERITY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], c)


def rule_label(c: Column) -> Column:
    m = F.create_map(*[x for k, v in V.RULE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], c)


def match_label(correct: Column) -> Column:
    return F.when(correct.isNull(), V.DASH).when(correct, V.MATCH_YES).otherwise(V.MATCH_NO)


def format_percent(x: Column, digits: int = 1) -> Column:
    """0.5 -> '50.0%'; NULL -> dash."""
    return F.when(x.isNull(), V.DASH).otherwise(F.concat(F.format_number(x * 100, digits).cast("string"), F.lit("%")))


def format_prob(x: Column) -> Column:
    """3 decimals; NULL -> dash."""
    return F.when(x.isNull(), V.DASH).otherwise(F.format_string("%.3f", x))


def format_minute(ts: Column) -> Column:
    """'yyyy-MM-dd HH:mm'; NULL -> dash."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(V.DASH))
