"""Classification metrics as aggregates over (label, probability).

* confusion cells, accuracy / precision / recall / F1: one aggregate; zero
  denominators give 0.0; rounded to 4 places like the published figures.
* ROC-AUC by rank-sum: collapse to one row per distinct score with (pos, neg) counts
  (map-side combine), then the negatives strictly below each score come from the
  distributed ``prefix_sums``; ties share credit (½).  NULL when one class is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.rank import prefix_sums


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Tp / fp / tn / fn counts (optionally per group)."""
    y, p = F.col(label).cast("boolean"), F.col(pred).cast("boolean")
    aggs = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]
    return df.groupBy(*(by or [])).agg(*aggs)


def with_rates(cm: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, F1 from confusion cells."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    acc = _ratio(tp + tn, tp + fp + tn + fn)
    return cm.withColumns({"accuracy": F.round(acc, digits), "precision": F.round(prec, digits),
                           "recall": F.round(rec, digits), "f1": F.round(f1, digits)})


def threshold_metrics(df: DataFrame, label: str = "label", prob: str = "prob", threshold: float = 0.5,
                      by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Metrics at a fixed threshold (pred = prob >= threshold)."""
    scored = df.withColumn("__pred", F.col(prob) >= F.lit(threshold))
    return with_rates(confusion(scored, label, "__pred", by), digits)


def score_counts(df: DataFrame, label: str = "label", score: str = "prob", by: list[str] | None = None) -> DataFrame:
    """(by..., score) -> (pos, neg): the sufficient statistics of every threshold metric
    and of the AUC, one partially-aggregated pass over the scored rows."""
    y = F.col(label).cast("int")
    return df.groupBy(*(by or []), score).agg(F.sum(y).cast("bigint").alias("pos"),
                                              F.sum(1 - y).cast("bigint").alias("neg"))


def roc_auc_from_counts(counts: DataFrame, score: str = "prob", by: list[str] | None = None,
                        digits: int | None = 4) -> DataFrame:
    """A17 from per-score counts: negatives strictly below each score come from the
    distributed prefix sum; ties get half credit."""
    by = by or []
    cum = prefix_sums(counts, [score], {"__neg_before": "neg"}, by=by)
    credit = F.col("pos") * (F.col("__neg_before") + 0.5 * F.col("neg"))
    agg = cum.groupBy(*by).agg(F.sum(credit).alias("__u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("__u") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    if digits is not None:
        auc = F.round(auc, digits)
    return agg.select(*by, auc.alias("auc"), "n_pos", "n_neg")


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob", by: list[str] | None = None,
            digits: int | None = 4) -> DataFrame:
    """ROC-AUC per group (rank-sum with ties at ½); NULL if a class is missing."""
    return roc_auc_from_counts(score_counts(df, label, score, by), score, by, digits)


def threshold_metrics_from_counts(counts: DataFrame, score: str = "prob", threshold: float = 0.5,
                                  by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """A16 from per-score counts (pred = score >= threshold)."""
    hit = F.col(score) >= F.lit(threshold)
    cm = counts.groupBy(*(by or [])).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    return with_rates(cm, digits)


def class_weights(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Class counts, negative/positive ratio (1.0 without positives) and the
    'balanced' weights n / (2 · n_class)."""
    y = F.col(label).cast("int")
    c = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("n_pos"))
    c = c.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    return c.withColumns({
        "scale_pos_weight": F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0)),
        "weight_pos": F.when(F.col("n_pos") > 0, F.col("n") / (2.0 * F.col("n_pos"))),
        "weight_neg": F.when(F.col("n_neg") > 0, F.col("n") / (2.0 * F.col("n_neg"))),
    })


def add_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Row weights for 'balanced' class weighting (n / (2 · n_class))."""
    w = class_weights(df, label)
    from platewise.operators.lookup import with_scalars
    d2, s = with_scalars(df, w.select("weight_pos", "weight_neg"), "__w")
    return d2.withColumn(out, F.when(F.col(label).cast("int") == 1, s["weight_pos"]).otherwise(s["weight_neg"])).drop("__w")
