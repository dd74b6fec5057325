"""Stored scoring bundles: a model with everything that scoring and explaining a record needs.

A bundle is a folder: ``side`` (one JSON text: kind, columns or coefficients, threshold,
background means), ``medians``, ``fallback`` and ``background`` (Parquet), and for a fitted
Spark model the model itself.  Linear bundles are scored and explained by column
expressions alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import features as FE
from platewise.functions import vocab as V
from platewise.operators import attribution as AT
from platewise.operators import clean as CL
from platewise.operators import score as SC

SNAPSHOT_COLUMNS = V.NUMERIC_FEATURES + V.BINARY_FEATURES + V.CATEGORICAL_FEATURES


def save_side(spark: SparkSession, path: str, side: dict) -> None:
    spark.createDataFrame([(json.dumps(side, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(
        path + "/side")


def load_side(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path + "/side", wholetext=True).first()["value"])


def save_linear(path: str, coefs: dict[str, float], intercept: float, threshold: float, medians: DataFrame, fallback: DataFrame,
                background: DataFrame) -> None:
    """S9 for a linear-logistic model: coefficients, threshold, imputation medians and the
    background sample, whose means are stored with the coefficients."""
    for name, df in (("medians", medians), ("fallback", fallback), ("background", background)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = medians.sparkSession
    means = spark.read.parquet(f"{path}/background").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in coefs]).first()
    save_side(spark, path, {"kind": "linear", "coefs": coefs, "intercept": intercept, "threshold": threshold,
                            "background_means": means.asDict()})


def load(spark: SparkSession, path: str) -> dict:
    """A bundle of either kind; 'kind' is 'linear' or 'spark'."""
    side = load_side(spark, path)
    if side.get("kind") != "linear":
        from platewise.plans.training import load_bundle

        return {"kind": "spark", "path": path, **load_bundle(path)}
    return {**side, "path": path, **{name: spark.read.parquet(f"{path}/{name}") for name in ("medians", "fallback", "background")}}


def impute(rows: DataFrame, bundle: dict, out: str | None = None) -> DataFrame:
    """A missing reading from the bundle's own medians, so a score doesn't depend on the
    other rows of its batch."""
    return CL.impute_group_median(rows, out=out, global_after_group=False, medians=bundle["medians"], fallback=bundle["fallback"])


def _empty() -> Column:
    return F.array().cast("array<struct<feature_index:int,feature:string,value:double,contribution:double>>")


def _linear_items(weights: list[tuple[str, float, float]]) -> Column:
    """Contributions weight * (value - background mean) on the log-odds scale."""
    return F.array(*[F.struct(F.lit(i).alias("feature_index"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"),
                              (F.lit(float(w)) * (F.col(f"`{c}`").cast("double") - F.lit(float(m)))).alias("contribution"))
                     for i, (c, w, m) in enumerate(weights)])


def scored(features: DataFrame, bundle: dict, key: str = "plate_no", explain: bool = True) -> DataFrame:
    """``features`` (serving features and other columns) with ``prob``, ``predicted_label``
    (by the bundle's threshold) and ``attributions``: an array of (feature_index, feature,
    value, contribution) per row (see :func:`explanations`)."""
    if bundle["kind"] == "linear":
        out = SC.score_linear(features, bundle["coefs"], bundle["intercept"], bundle["threshold"])
        means = bundle["background_means"]
        items = _linear_items([(c, w, means[c]) for c, w in bundle["coefs"].items()]) if explain else _empty()
        return out.withColumn("attributions", items)
    return _scored_by_model(features, bundle, key, explain)


def _scored_by_model(features: DataFrame, bundle: dict, key: str, explain: bool) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    from platewise.plans import training as TR

    own = set(V.NUMERIC_FEATURES + V.BINARY_FEATURES)
    dm, cols = TR.design_matrix(features, bundle["vocabulary"], [c for c in features.columns if c not in own])
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(dm)
    prob = TR.positive_probability(None, bundle["platt"])
    out = bundle["model"].transform(vec).withColumn("prob", prob).withColumn(
        "predicted_label", F.col("prob") >= F.lit(float(bundle["threshold"])))
    keep = [*features.columns, "prob", "predicted_label"]
    long, items = explanations(dm, cols, bundle["model"], bundle["path"], bundle["background"], bundle["platt"], key) if explain else (None, None)
    if items is not None:
        return out.select(*keep, items.alias("attributions"))
    if long is None:
        return out.select(*keep, _empty().alias("attributions"))
    # one struct per feature of a row, the number of features is the model's
    arrays = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_index", "feature", "value", "contribution"))).alias(
        "attributions"))
    return out.select(*keep).join(arrays, key)


def explained(dm: DataFrame, cols: list[str], model, path: str, background: DataFrame, platt: dict | None,
              key: str) -> tuple[DataFrame | None, Column | None, str]:
    """The contributions of a stored pipeline model, either as a frame (key, x, phi) with a
    row and its contributions as arrays or, for linear models, as an array column over
    ``dm``; and their scale: probability for trees and forests, log-odds for the
    others (of an SVM those of its Platt step)."""
    from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel, LinearSVCModel,
                                           LogisticRegressionModel, RandomForestClassificationModel)

    from platewise.operators import tree_attribution as TA

    spark, last = dm.sparkSession, model.stages[-1]
    stage = f"{path}/stages/{len(model.stages) - 1}_{last.uid}"
    if isinstance(last, LinearSVCModel) and last.getFeaturesCol() != "scaled":
        return None, None, "log_odds"   # linear in random features, not in the model's columns
    if isinstance(last, (LogisticRegressionModel, LinearSVCModel)):
        weights = [float(w) for w in last.coefficients]
        if isinstance(last, LinearSVCModel):
            weights = [platt["a"] * w / s if s else 0.0 for w, s in zip(weights, model.stages[0].std, strict=True)]
        means = background.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).first().asDict()
        return None, _linear_items([(c, w, means[c]) for c, w in zip(cols, weights, strict=True)]), "log_odds"
    if isinstance(last, (DecisionTreeClassificationModel, RandomForestClassificationModel)):
        return TA.tree_values(dm, background, cols, TA.tree_leaves(spark, stage), key=key), None, "probability"
    if isinstance(last, GBTClassificationModel):
        return TA.path_values(dm, cols, TA.boosted_leaves(spark, stage, list(last.treeWeights)), key=key), None, "log_odds"
    return None, None, "log_odds"


def explanations(dm: DataFrame, cols: list[str], model, path: str, background: DataFrame, platt: dict | None,
                 key: str) -> tuple[DataFrame | None, Column | None]:
    """:func:`explained` with long rows in place of the frame of arrays."""
    from platewise.operators import tree_attribution as TA

    values, items, scale = explained(dm, cols, model, path, background, platt, key)
    return None if values is None else TA.long_rows(values, cols, key, scale), items


# ---- logged predictions

def prediction_id(key: Column, model_id: Column, at: Column) -> Column:
    """A stable id: 60 bits of the md5 of plate, model version and instant, so a batch that
    is written again gives the same ids."""
    text = F.concat_ws("|", key, model_id.cast("string"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def log_rows(rows: DataFrame, model_id: int, at: str, key: str = "plate_no", k: int = V.TOP_N_ATTRIBUTIONS) -> tuple[DataFrame, DataFrame]:
    """The rows of the tables ``prediction`` and ``shap_explanation`` for scored ``rows``:
    rounded probability, the derived features as a JSON document, and the ``k`` strongest
    contributions with their ranks, keyed by prediction."""
    with_id = rows.withColumn("id", prediction_id(F.col(key), F.lit(model_id), F.col(at)))
    predictions = with_id.select(
        "id", key, F.lit(model_id).cast("long").alias("model_version_id"), F.round("prob", 4).cast("decimal(5,4)").alias("predicted_prob"),
        "predicted_label", F.to_json(F.struct(*SNAPSHOT_COLUMNS), {"ignoreNullFields": "false"}).alias("feature_snapshot"),
        F.col(at).alias("predicted_at"))
    top = AT.top_from_arrays(with_id.select("id", "attributions"), "id", k)
    return predictions, top.select(F.col("id").alias("prediction_id"), F.col("feature").alias("feature_name"),
                                   F.col("value").alias("feature_value"), F.col("contribution").alias("shap_value"), "rank")


def features_for(rows: DataFrame, bundle: dict, keep: list) -> DataFrame:
    """Serving features of ``rows`` imputed by the bundle."""
    return FE.serving_features(impute(rows, bundle, out="__temp"), temp_col="__temp", keep=keep)
