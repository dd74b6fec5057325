"""Training and comparison of classifiers with Spark ML.

The plan: training frame -> impute (medians fitted on all rows, as published; pass
``fit_on_train_only`` for the leakage-free variant) -> serving features -> one-hot with a
fitted vocabulary (drop-first, unknown category -> all-zero block) -> exact time split
-> stratified fold column -> one grid search per model family (folds given by the
fold column, AUC metric, parallel fits) -> evaluation on the valid and test splits with
the distributed metric operators -> registry rows + saved PipelineModels.

Families map onto Spark ML as follows (Spark has no XGBoost or LightGBM, so two
families are re-aimed): logistic regression (regParam = 1 / (C · n), no
standardisation, balanced weights), decision tree, random forest, two gradient-boosted
tree grids (class-ratio weight and balanced weight), SVM on standardised features with both
kernels (RBF by random Fourier features) and a Platt step for probabilities.  Unlimited depth is Spark's maximum 30.
"""

from __future__ import annotations

import itertools
import json
import os
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel,
                                       GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import vocab as V
from platewise.operators import bundle as BU
from platewise.operators import metrics as ME
from platewise.operators import registry as RG
from platewise.operators import splits as SP
from platewise.operators.lookup import settled
from platewise.plans import logistic as LO
from platewise.plans import margins as MA
from platewise.plans import trees as TE
from platewise.plans.kernel import RandomFourier

MAX_LEVELS = 10_000  # a categorical column with more levels is not one-hot encoded
MIN_TRAINING_ROWS = 50
RBF_DIMS = 100  # random features of the RBF kernel: an error of about 0.1 in a kernel value
ROWS_PER_PARTITION = 200_000  # ~40 double features -> ~64 MB of training rows per task
ROWS_AT_ONCE = 5_000_000  # held by the fits that run side by side (two at least)
LEAST_ROWS_PER_PARTITION = 5_000  # below that a task costs more than its rows


# ----------------------------------------------------------------------------- design matrix (M1, M2)

def fit_vocabulary(df: DataFrame, cols: list[str] = V.CATEGORICAL_FEATURES, max_levels: int = MAX_LEVELS) -> dict:
    """Sorted distinct levels per categorical column, from the distinct combinations, which take
    one pass over ``df``; the size is checked before anything is brought to the driver."""
    df = settled(df.select(*cols).distinct())
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first().asDict()
    big = [c for c, n in sizes.items() if n > max_levels]
    if big:
        raise ValueError(f"too many levels to one-hot encode: { {c: sizes[c] for c in big} }")
    row = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def dummy_columns(vocab: dict, drop_first: bool = True) -> list[tuple[str, Column]]:
    """(name, expression) of the dummy columns: '<col>_<level>' = 1.0 when equal.
    The first (alphabetical) level is the baseline; an unseen level and NULL are
    all zeros."""
    out = []
    for c, levels in vocab.items():
        for lv in (levels[1:] if drop_first else levels):
            out.append((f"{c}_{lv}", F.coalesce((F.col(c).cast("string") == F.lit(lv)).cast("double"), F.lit(0.0))))
    return out


def design_matrix(features: DataFrame, vocab: dict, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Numeric + binary features as DOUBLE plus dummy columns; returns the frame and
    the ordered model column names (M2 alignment is implicit: fixed vocabulary)."""
    numeric = V.NUMERIC_FEATURES + V.BINARY_FEATURES
    dummies = dummy_columns(vocab)
    cols = [F.col(c).cast("double").alias(c) for c in numeric] + [e.alias(n) for n, e in dummies]
    return features.select(*keep, *cols), numeric + [n for n, _ in dummies]


# ----------------------------------------------------------------------------- model families (M3-M8)

@dataclass
class Family:
    name: str
    build: callable            # (features_col, label_col, weight_col, n_train, n_pos, n_neg) -> (estimator, grid, describe)
    weight: str = "balanced"   # 'balanced' | 'ratio' | 'none'
    size_param: str = ""       # number of trees or depth of a tree: smaller ones are prefixes of the largest


def _lr(n, **_):
    est = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=2000,
                             standardization=False, elasticNetParam=0.0)
    cs = [0.01, 0.1, 1, 10]
    grid = ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * n) for c in cs]).build()
    return est, grid, [{"C": c} for c in cs]


def _tree(n, **_):
    est = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=42)
    depths, leaves = [3, 5, 8, None], [1, 5, 10]
    combos = list(itertools.product(depths, leaves))
    grid = [{est.maxDepth: (30 if d is None else d), est.minInstancesPerNode: m} for d, m in combos]
    return est, grid, [{"max_depth": d, "min_samples_leaf": m} for d, m in combos]


def _forest(n, **_):
    est = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=42)
    combos = list(itertools.product([100, 300], [5, 8, None]))
    grid = [{est.numTrees: t, est.maxDepth: (30 if d is None else d)} for t, d in combos]
    return est, grid, [{"n_estimators": t, "max_depth": d} for t, d in combos]


def _gbt(n, depths, **_):
    est = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=42)
    combos = list(itertools.product([100, 300], depths, [0.05, 0.1]))
    grid = [{est.maxIter: t, est.maxDepth: (30 if d in (None, -1) else d), est.stepSize: r} for t, d, r in combos]
    return est, grid, [{"n_estimators": t, "max_depth": d, "learning_rate": r} for t, d, r in combos]


def _svm(n, **_):
    """A pipeline whose stages are the grid: standardised features, for the RBF kernel their
    random Fourier map, and a linear SVM."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    rbf = RandomFourier(inputCol="scaled", outputCol="mapped", dims=RBF_DIMS, seed=42)
    svc = LinearSVC(labelCol="label", weightCol="weight", maxIter=100, tol=1e-4)
    pipe = Pipeline(stages=[scaler, svc])
    grid, described = [], []
    for c, kernel in itertools.product([0.1, 1, 10], ["rbf", "linear"]):
        own = svc.copy({svc.regParam: 1.0 / (c * n), svc.featuresCol: "mapped" if kernel == "rbf" else "scaled"})
        grid.append({pipe.stages: [scaler, rbf, own] if kernel == "rbf" else [scaler, own]})
        described.append({"svc__C": c, "svc__kernel": kernel})
    return pipe, grid, described


FAMILIES = [
    Family("LogisticRegression", _lr),
    Family("DecisionTree", _tree, size_param="maxDepth"),
    Family("RandomForest", _forest, size_param="numTrees"),
    Family("GradientBoostingA", lambda n, **k: _gbt(n, [3, 5, 8]), weight="ratio", size_param="maxIter"),
    Family("GradientBoostingB", lambda n, **k: _gbt(n, [3, 5, -1]), size_param="maxIter"),
    Family("SVM", _svm),
]


def grid_of(name: str, wanted: list[dict]) -> callable:
    """The builder of a family cut down to the described parameters ``wanted`` (those not in
    its published grid are an error)."""
    build = next(f.build for f in FAMILIES if f.name == name)

    def smaller(n, **k):
        est, grid, described = build(n, **k)
        at = [described.index(w) for w in wanted]
        return est, [grid[i] for i in at], [described[i] for i in at]

    return smaller


def smaller_ensembles(family: Family, sizes: list[int], **others) -> Family:
    """An ensemble family with the numbers of trees ``sizes`` and the other described
    parameters fixed, e.g. for a quick comparison of all six."""
    def build(n, **k):
        est, grid, described = family.build(n, **k)
        at = next(i for i, d in enumerate(described) if all(d[c] == v for c, v in others.items()))
        size = est.getParam(family.size_param)
        return est, [{**grid[at], size: s} for s in sizes], [{**described[at], "n_estimators": s} for s in sizes]

    return Family(family.name, build, family.weight, family.size_param)


def ensemble_prefix(model, n_trees: int):
    """The ensemble of the first ``n_trees`` trees of a fitted forest or boosted model: what a
    fit with fewer trees (and the same seed) would have stopped at."""
    old = model._java_obj
    trees = old.trees()
    if n_trees >= len(trees):
        return model
    gateway = SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm.org.apache.spark.ml

    def first(kind, values):
        out = gateway.new_array(kind, n_trees)
        for i in range(n_trees):
            out[i] = values[i]
        return out

    if isinstance(model, GBTClassificationModel):
        new = jvm.classification.GBTClassificationModel(
            old.uid(), first(jvm.regression.DecisionTreeRegressionModel, trees), first(gateway.jvm.double, old.treeWeights()),
            old.numFeatures(), old.numClasses())
        return GBTClassificationModel(new)
    new = jvm.classification.RandomForestClassificationModel(
        old.uid(), first(jvm.classification.DecisionTreeClassificationModel, trees), old.numFeatures(), old.numClasses())
    new.set(new.getParam("numTrees"), n_trees)
    return RandomForestClassificationModel(new)


def tree_prefix(model, depth: int):
    """The first ``depth`` levels of a fitted decision tree: what a fit with that ``maxDepth`` would
    have stopped at.  A split doesn't depend on the levels below it; as in a fit, two leaves
    with the same prediction become one."""
    if depth >= model.depth:
        return model
    gateway = SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm.org.apache.spark.ml

    def cut(node, levels: int) -> tuple:
        """The node, its prediction, whether it is a leaf."""
        prediction = node.prediction()
        if node.subtreeDepth() == 0:
            return node, prediction, True
        if levels > 0:
            (left, p, a), (right, q, b) = cut(node.leftChild(), levels - 1), cut(node.rightChild(), levels - 1)
            if not (a and b and p == q):
                return jvm.tree.InternalNode(prediction, node.impurity(), node.gain(), left, right, node.split(),
                                             node.impurityStats()), prediction, False
        return jvm.tree.LeafNode(prediction, node.impurity(), node.impurityStats()), prediction, True

    old = model._java_obj
    new = jvm.classification.DecisionTreeClassificationModel(
        old.uid(), cut(old.rootNode(), depth)[0], old.numFeatures(), old.numClasses())
    return model._copyValues(DecisionTreeClassificationModel(new), {model.maxDepth: depth})


def prefix(model, size: int):
    return tree_prefix(model, size) if isinstance(model, DecisionTreeClassificationModel) else ensemble_prefix(model, size)


def search_prefixes(train: DataFrame, est, grid: list[dict], size_param: str, evaluator, folds: int, parallelism: int) -> tuple:
    """M9 for ensembles and trees: one fit per fold and setting of the other parameters, at the
    largest number of trees or depth; smaller ones are read off as prefixes.  Returns (best pipeline model
    on all of ``train``, its place in the grid, mean AUC of each place)."""
    size = est.getParam(size_param)
    if TE.applies(train, est, grid, size):
        return search_trees(train, est, grid, size, evaluator, folds, parallelism)
    groups: dict[tuple, list[int]] = {}
    for i, g in enumerate(grid):
        groups.setdefault(tuple(sorted((p.name, v) for p, v in g.items() if p.name != size_param)), []).append(i)

    def largest(members: list[int]) -> dict:
        return {**grid[members[0]], size: max(grid[i][size] for i in members)}

    def one(job: tuple) -> list[tuple[int, float]]:
        members, k = job
        model = est.copy(largest(members)).fit(train.filter(F.col("fold") != k))
        held = train.filter(F.col("fold") == k)
        return [(i, evaluator.evaluate(prefix(model, grid[i][size]).transform(held))) for i in members]

    with ThreadPool(parallelism) as pool:
        got = pool.map(one, [(m, k) for m in groups.values() for k in range(folds)], chunksize=1)
    sums = [0.0] * len(grid)
    for i, auc in itertools.chain.from_iterable(got):
        sums[i] += auc / folds
    best = max(range(len(grid)), key=lambda i: (sums[i], -i))
    members = next(m for m in groups.values() if best in m)
    model = est.copy({**largest(members), size: grid[best][size]}).fit(train)
    return PipelineModel([model]), best, sums


def search_trees(train: DataFrame, est, grid: list[dict], size, evaluator, folds: int, parallelism: int) -> tuple:
    """M9 for decision trees that differ in depth and rows of a leaf: all are grown together."""
    leaf = est.minInstancesPerNode
    smallest, depths = sorted({g[leaf] for g in grid}), sorted({g[size] for g in grid})
    scored = TE.held_out_scores(train, est, smallest, depths, folds)
    columns = [f"s{smallest.index(g[leaf]) * len(depths) + depths.index(g[size])}" for g in grid]
    sums = held_out_aucs(scored, columns, evaluator, folds, parallelism)
    best = max(range(len(grid)), key=lambda i: (sums[i], -i))
    return PipelineModel([est.copy(grid[best]).fit(train)]), best, sums


def held_out_aucs(scored: DataFrame, columns: list[str], evaluator, folds: int, parallelism: int) -> list[float]:
    """Mean AUC over the folds of each column of scores of held-out rows (NULL: another row has it)."""
    def one(job: tuple[int, int]) -> tuple[int, float]:
        i, k = job
        held = scored.filter((F.col("fold") == k) & F.col(columns[i]).isNotNull())
        return i, evaluator.evaluate(held.select(F.col(columns[i]).alias(evaluator.getRawPredictionCol()),
                                                 F.col("label").alias(evaluator.getLabelCol())))

    with ThreadPool(parallelism) as pool:
        got = pool.map(one, [(i, k) for i in range(len(columns)) for k in range(folds)], chunksize=1)
    sums = [0.0] * len(columns)
    for i, auc in got:
        sums[i] += auc / folds
    return sums


def search_grid(train: DataFrame, est, grid: list[dict], evaluator, folds: int, parallelism: int) -> tuple:
    """M9: the mean AUC of each place of the grid over the folds of the ``fold`` column, and the
    best pipeline model on all of ``train`` (of equal places the first), as (model, its place,
    AUCs).  All pairs of a place and a fold are fitted side by side, since an iterative
    learner runs a short job per step; a fold is a filter on the stored rows."""
    if LO.applies(est) and all(set(g) == {est.regParam} for g in grid):
        return search_logistic(train, est, grid, evaluator, folds, parallelism)
    together = MA.fit_together(train, est, grid, folds) if MA.applies(est, grid) else None
    if together:  # linear SVMs
        models, scored = together
        sums = held_out_aucs(scored, [f"s{i}" for i in range(len(grid))], evaluator, folds, parallelism)
        best = max(range(len(grid)), key=lambda i: (sums[i], -i))
        return models[best], best, sums
    pipe = est if isinstance(est, Pipeline) else Pipeline(stages=[est])

    def one(job: tuple[int, int]) -> tuple[int, float]:
        i, k = job
        model = pipe.copy(grid[i]).fit(train.filter(F.col("fold") != k))
        return i, evaluator.evaluate(model.transform(train.filter(F.col("fold") == k)))

    with ThreadPool(parallelism) as pool:
        got = pool.map(one, [(i, k) for i in range(len(grid)) for k in range(folds)], chunksize=1)
    sums = [0.0] * len(grid)
    for i, auc in got:
        sums[i] += auc / folds
    best = max(range(len(grid)), key=lambda i: (sums[i], -i))
    return pipe.copy(grid[best]).fit(train), best, sums


def search_logistic(train: DataFrame, est, grid: list[dict], evaluator, folds: int, parallelism: int) -> tuple:
    """M9 for logistic regressions that differ in their penalty: all are fitted together."""
    whole, parts = LO.fit_together(train, est, [g[est.regParam] for g in grid], folds)

    def one(job: tuple[int, int]) -> tuple[int, float]:
        i, k = job
        return i, evaluator.evaluate(parts[i][k].transform(train.filter(F.col("fold") == k)))

    with ThreadPool(parallelism) as pool:
        got = pool.map(one, [(i, k) for i in range(len(grid)) for k in range(folds)], chunksize=1)
    sums = [0.0] * len(grid)
    for i, auc in got:
        sums[i] += auc / folds
    best = max(range(len(grid)), key=lambda i: (sums[i], -i))
    return PipelineModel([whole[best]]), best, sums


def with_weights(df: DataFrame, label: str, mode: str) -> DataFrame:
    """'balanced': n / (2 · n_class); 'ratio': positives weighted by neg/pos; 'none': 1."""
    if mode == "none":
        return df.withColumn("weight", F.lit(1.0))
    if mode == "balanced":
        return ME.add_balanced_weight(df, label, "weight")
    from platewise.operators.lookup import with_scalars

    cw = ME.class_weights(df, label).select("scale_pos_weight")
    d2, s = with_scalars(df, cw, "__cw")
    return d2.withColumn("weight", F.when(F.col(label) == 1, s["scale_pos_weight"]).otherwise(1.0)).drop("__cw")


def positive_probability(model_out: DataFrame, platt: dict | None = None) -> Column:
    """P(class 1): probability[1] for probabilistic models, or a Platt-scaled margin."""
    if platt is None:
        return vector_to_array("probability")[1]
    a, b = platt["a"], platt["b"]
    return 1.0 / (1.0 + F.exp(-(F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b))))


def fit_platt(scored: DataFrame) -> dict:
    """1-D logistic regression of the label on the SVM margin (probabilities for SVM)."""
    m = scored.select(vector_to_array("rawPrediction")[1].alias("m"), "label")
    vec = VectorAssembler(inputCols=["m"], outputCol="mv").transform(m)
    lr = LogisticRegression(featuresCol="mv", labelCol="label", regParam=0.0, standardization=False).fit(vec)
    return {"a": float(lr.coefficients[0]), "b": float(lr.intercept)}


# ----------------------------------------------------------------------------- comparison

@dataclass
class TrainResult:
    comparison: DataFrame
    models: dict
    columns: list[str]
    vocab: dict
    data: DataFrame       # design matrix with split, fold and feature vector


def prepare(frame: DataFrame, label_col: str = "target") -> tuple[DataFrame, list[str], dict]:
    """Design matrix with split, fold and the assembled feature vector.  ``frame`` is read twice."""
    vocab = fit_vocabulary(frame)
    dm, cols = design_matrix(frame, vocab, keep=["plate_no", "rolling_date", label_col])
    split = SP.time_split(dm)
    # the folds are ranked and stored without the model columns
    train = split.filter(F.col("split") == "train").select("plate_no", label_col, "pos")
    folds = SP.stratified_folds(train, label_col, "pos", 5).select("plate_no", "fold")
    data = (split.join(folds, "plate_no", "left").withColumn("label", F.col(label_col).cast("double")))
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(data)
    return data, cols, vocab


def train_compare(frame: DataFrame, families: list[Family] = FAMILIES, label_col: str = "target",
                  parallelism: int = 8) -> TrainResult:
    """Grid search with 5 stratified folds per family on the training split,
    refit on the whole training split, evaluate on valid and test."""
    frame = settled(frame)
    total = frame.count()
    if total < MIN_TRAINING_ROWS:  # P17: too little data to train at all
        raise ValueError(f"only {total} labelled rows; at least {MIN_TRAINING_ROWS} are needed")
    data, cols, vocab = prepare(frame, label_col)
    # Iterative learners run a job per step: all cores share the rows, but no task has fewer
    # than LEAST_ROWS_PER_PARTITION or, at scale, more than ROWS_PER_PARTITION of them.
    spread = max(frame.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS_PER_PARTITION))
    parts = max(1, min(spread, total // LEAST_ROWS_PER_PARTITION))
    data = data.repartition(parts).checkpoint(eager=True)
    train = data.filter(F.col("split") == "train")
    n = train.count()
    # every fit holds its rows in memory
    parallelism = max(2, min(parallelism, ROWS_AT_ONCE // max(n, 1)))
    rows, models, weighted = [], {}, {}
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label",
                                              metricName="areaUnderROC")
    for fam in families:
        est, grid, described = fam.build(n)
        # the fits run in parallel threads: they share rows, not a plan with subqueries; families
        # with the same weights share them, too
        if fam.weight not in weighted:
            weighted[fam.weight] = with_weights(train, "label", fam.weight).select(
                "features", "label", "weight", F.col("fold").cast("int").alias("fold")).checkpoint(eager=True)
        tr = weighted[fam.weight]
        if fam.size_param:
            best, best_i, cv_auc = search_prefixes(tr, est, grid, fam.size_param, evaluator, 5, parallelism)
        else:
            best, best_i, cv_auc = search_grid(tr, est, grid, evaluator, 5, parallelism)
        platt = fit_platt(best.transform(tr)) if fam.name == "SVM" else None
        models[fam.name] = (best, platt)
        scored = settled(best.transform(data.filter(F.col("split").isin("valid", "test"))).select(
            "split", "label", positive_probability(None, platt).alias("prob")))
        m = ME.threshold_metrics(scored, "label", "prob", 0.5, by=["split"]).join(
            ME.roc_auc(scored, "label", "prob", by=["split"]).select("split", "auc"), "split")
        got = {r["split"]: r.asDict() for r in m.collect()}  # two rows: valid, test
        v, t = got.get("valid", {}), got.get("test", {})
        rows.append((fam.name, json.dumps(described[best_i]), round(float(cv_auc[best_i]), 4),
                     v.get("precision"), v.get("recall"), v.get("f1"), v.get("auc"),
                     t.get("precision"), t.get("recall"), t.get("f1"), t.get("auc"), n))
    schema = ("algorithm string, best_params string, cv_best_auc double, valid_precision double, valid_recall double, "
              "valid_f1 double, valid_auc double, test_precision double, test_recall double, test_f1 double, "
              "test_auc double, train_row_count long")
    comparison = frame.sparkSession.createDataFrame(rows, schema)
    return TrainResult(comparison, models, cols, vocab, data)


def fit_one(data: DataFrame, family: str, params: dict):
    """One model of a family with fixed parameters on the training split of :func:`prepare`."""
    fam = next(f for f in FAMILIES if f.name == family)
    train = with_weights(data.filter(F.col("split") == "train"), "label", fam.weight)
    est, _, _ = fam.build(1)
    if isinstance(est, Pipeline):
        scaler, svc = est.getStages()
        return est.copy({est.stages: [scaler, svc.copy({**{svc.getParam(k): v for k, v in params.items()}, svc.featuresCol: "scaled"})]}
                        ).fit(train)
    return est.copy({est.getParam(k): v for k, v in params.items()}).fit(train)


def best_by_auc(comparison: DataFrame) -> str:
    """The family with the best valid AUC; the first registered wins ties."""
    order = [r["algorithm"] for r in comparison.select("algorithm").collect()]
    best = comparison.orderBy(F.coalesce("valid_auc", F.lit(0.0)).desc()).collect()
    top = best[0]["valid_auc"]
    return min((r["algorithm"] for r in best if r["valid_auc"] == top), key=order.index)


def save_bundle(path: str, model, columns: list[str], vocab: dict, platt: dict | None, threshold: float,
                medians: DataFrame, fallback: DataFrame, background: DataFrame) -> None:
    """A fitted model with everything that scoring and explaining a record needs: model
    columns, vocabulary, Platt parameters and threshold as one JSON text, the imputation
    medians and the background sample as Parquet, all written by Spark (any URI)."""
    model.write().overwrite().save(path)
    BU.save_side(medians.sparkSession, path, {"kind": "spark", "columns": columns, "vocabulary": vocab, "platt": platt,
                                              "threshold": threshold})
    for name, df in (("medians", medians), ("fallback", fallback), ("background", background)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(path: str) -> dict:
    """What :func:`save_bundle` wrote: 'model', 'columns', 'vocabulary', 'platt',
    'threshold', 'medians', 'fallback', 'background'."""
    spark = SparkSession.active()
    return {"model": PipelineModel.load(path), **BU.load_side(spark, path),
            **{name: spark.read.parquet(f"{path}/{name}") for name in ("medians", "fallback", "background")}}


def save_models(result: TrainResult, root: str, run_tag: str, medians: DataFrame, fallback: DataFrame,
                threshold: float = 0.5) -> list[dict]:
    """Save a bundle of each fitted model; return registry rows."""
    train = result.data.filter(F.col("split") == "train")
    background = SP.background_sample(train, "plate_no", 100, 42).select("plate_no", *result.columns)
    facts = train.agg(F.max("rolling_date").alias("at"), F.count(F.lit(1)).alias("n")).first()
    out = []
    for name, (model, platt) in result.models.items():
        path = os.path.join(root, f"{V.MODEL_NAME}_{name}_{run_tag}")
        save_bundle(path, model, result.columns, result.vocab, platt, threshold, medians, fallback, background)
        out.append({"name": V.MODEL_NAME, "algorithm": name, "version": f"{name}-{run_tag}", "artifact_path": path,
                    "trained_at": facts["at"], "train_row_count": facts["n"], "threshold": threshold})
    return out


def score_with_bundle(features_of, bundle: dict, keep: list[str]) -> DataFrame:
    """M16/M17 with a stored bundle: ``features_of(medians, fallback)`` gives the serving
    features imputed by the bundle's medians."""
    feats = features_of(bundle["medians"], bundle["fallback"])
    return score_with_model(feats, bundle["model"], bundle["vocabulary"], bundle["platt"], bundle["threshold"], keep)


def score_with_model(features: DataFrame, model: PipelineModel, vocab: dict, platt: dict | None,
                     threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """M16 with a fitted model: design matrix from the stored vocabulary, transform,
    positive-class probability, label = prob >= threshold (unrounded)."""
    keep = keep or ["plate_no"]
    model_columns = set(V.NUMERIC_FEATURES + V.BINARY_FEATURES)    # kept by the design matrix itself
    dm, cols = design_matrix(features, vocab, [c for c in keep if c not in model_columns])
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(dm)
    out = model.transform(vec).withColumn("prob", positive_probability(None, platt))
    return out.select(*keep, "prob", (F.col("prob") >= F.lit(threshold)).alias("predicted_label"))


def retrain(frame: DataFrame, registry_root: str, run_tag: str, medians: DataFrame, fallback: DataFrame,
            families: list[Family] = FAMILIES) -> tuple[TrainResult, list[dict]]:
    """The comparison on the given labels; a bundle of every new version is saved and its
    row appended to the stored registry.  Only when no version of the name is active yet
    is the best valid AUC activated (M13); else activation stays a separate, explicit
    event (M14)."""
    spark = frame.sparkSession
    result = train_compare(frame, families)
    rows = save_models(result, registry_root, run_tag, medians, fallback)
    metrics = {r["algorithm"]: r.asDict() for r in result.comparison.collect()}  # one row per family
    known = RG.stored(spark, registry_root, "model_version").agg(F.max("id")).first()[0] or 0
    any_active = RG.active_version(spark, registry_root) is not None
    for i, r in enumerate(rows):
        m = metrics[r["algorithm"]]
        valid = {k: m[f"valid_{k}"] for k in ("precision", "recall", "f1", "auc")}
        doc = {"valid": {**valid, "best_params": json.loads(m["best_params"]), "cv_best_auc": m["cv_best_auc"]},
               "test": {k: m[f"test_{k}"] for k in ("precision", "recall", "f1", "auc")}}
        r.update({"id": known + 1 + i, "is_active": False, "metrics": json.dumps(doc)})
    rows = bootstrap_activation(rows, result, any_active)
    schema = ("id long, name string, algorithm string, version string, artifact_path string, trained_at timestamp_ntz, "
              "train_row_count long, threshold double, metrics string, is_active boolean")
    table = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)
    RG.append_versions(table, registry_root)
    RG.append_activations(table.filter("is_active").select(
        "name", F.col("id").alias("model_id"), F.col("trained_at").alias("activated_at"), F.lit("bootstrap").alias("reason")), registry_root)
    return result, rows


def bootstrap_activation(rows: list[dict], result: TrainResult, any_active: bool) -> list[dict]:
    """When no version of the name is active yet, the best valid AUC becomes active."""
    if any_active or not rows:
        return rows
    best = best_by_auc(result.comparison)
    for r in rows:
        r["is_active"] = r["algorithm"] == best
    return rows
