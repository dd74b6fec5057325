"""Training and explaining at size: one row in, one row out; fits grown together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import tree_attribution as TA


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contributions_stay_in_their_rows(spark, tmp_path):
    """the contributions of a row are arrays of that row, so adding them up explodes nothing;
    the long rows are the same arrays, a NULL stays NULL."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from platewise.operators import bundle as BU

    rows = [(f"p{i // 2}", float(i % 7), float((i * 5) % 11), float((i % 7 > 3) != (i % 11 == 0))) for i in range(120)]
    data = spark.createDataFrame(rows, "plate_no string, a double, b double, label double")
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    model = PipelineModel([DecisionTreeClassifier(maxDepth=3).fit(vec)])
    path = f"file:{tmp_path}/m"
    model.write().save(path)
    odd = data.select("plate_no", F.when(F.col("a") != 2, F.col("a")).alias("a"), "b")
    values, items, scale = BU.explained(odd, ["a", "b"], model, path, data.limit(9), None, "plate_no")
    assert items is None and scale == "probability" and values.columns == ["plate_no", "x", "phi"]
    total = values.groupBy("plate_no").agg(F.sum(F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)).alias("t"))
    assert "Generate" not in plan_of(total)
    long = BU.explanations(odd, ["a", "b"], model, path, data.limit(9), None, "plate_no")[0]
    assert long.columns == ["plate_no", "feature_index", "feature", "value", "contribution", "scale"]
    slow = dict(long.groupBy("plate_no").agg(F.sum("contribution")).collect())
    assert len(slow) == 60 and dict(total.collect()) == pytest.approx(slow)
    assert long.filter("value is null").count() == odd.filter("a is null").count() > 0
    assert long.count() == 240 and not any(math.isnan(r.contribution) for r in long.collect())
    leaves = TA.tree_leaves(spark, f"{path}/stages/0_{model.stages[0].uid}")
    bg = np.array([[r.a, r.b] for r in data.limit(9).collect()])
    first = values.filter("x[0] is not null").first()
    assert np.allclose(first.phi, TA.contributions(np.array([first.x]), bg, leaves)[0])


def labelled_rows(spark, n: int, parts: int):
    """Rows with two noisy continuous features, one of few values, one constant and one of two
    values; whole weights, so that sums don't depend on the order of their rows."""
    from pyspark.ml.linalg import Vectors

    g = np.random.default_rng(7)
    a, b, c, e = g.normal(size=n), g.integers(0, 400, n), g.integers(-3, 4, n), g.integers(0, 2, n)
    label = ((a + 0.02 * b > 4) ^ (c * e == 3) ^ (g.random(n) < 0.15)).astype(float)
    rows = [(Vectors.dense([float(a[i]), float(b[i]), float(c[i]), 5.0, float(e[i])]), float(label[i]), float(1 + 2 * label[i]), i % 3)
            for i in range(n)]
    return spark.createDataFrame(rows, ["features", "label", "weight", "fold"]).repartition(parts).checkpoint()


@pytest.mark.parametrize("rows, parts, rows_of_a_task", [(2000, 2, 200_000), (2000, 3, 150), (16_500, 3, 5_000)])
def test_trees_of_a_grid_grow_together(spark, monkeypatch, rows, parts, rows_of_a_task):
    """no tree of a fold is fitted by itself, not even where nodes are too large for one
    task or thresholds come from a sample; all AUCs are those of single fits."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from platewise.plans import training as TR
    from platewise.plans import trees as TE

    train = labelled_rows(spark, rows, parts)
    est, grid, described = TR._tree(rows)
    some = [i for i, x in enumerate(described) if x["max_depth"] in (3, None) and x["min_samples_leaf"] in (1, 10)]
    grid = [grid[i] for i in some]
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    fits, fit, passes, one = [], DecisionTreeClassifier._fit, [], TE._pass
    monkeypatch.setattr(TE, "ROWS_OF_A_TASK", rows_of_a_task)
    monkeypatch.setattr(TE, "NODES_OF_A_PASS", 5)
    monkeypatch.setattr(TE, "_pass", lambda *a: passes.append(1) or one(*a))
    monkeypatch.setattr(DecisionTreeClassifier, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    _, best, aucs = TR.search_prefixes(train, est, grid, "maxDepth", ev, 3, 4)
    assert len(fits) == 1 and bool(passes) == (rows_of_a_task < rows / 2)
    _, place, one_by_one = TR.search_grid(train, est, grid, ev, 3, 4)
    assert aucs == pytest.approx(one_by_one, abs=1e-12) and best == place
    assert len({round(x, 4) for x in aucs}) > 2


def test_certificates_by_sums_of_tasks(spark, monkeypatch):
    """the logistic regressions of all C are fitted together, tightly enough for their slopes to
    vanish; the splits of a tree are judged by sums of tasks, not by exploded rows."""
    from pyspark.ml.classification import LogisticRegression

    from platewise.plans import certificates as CE
    from platewise.plans import logistic as LO
    from platewise.plans import training as TR

    cols = [f"c.{i}" for i in range(5)]
    x = F.col("features")
    from pyspark.ml.functions import vector_to_array
    train = labelled_rows(spark, 800, 3).select("*", *[vector_to_array(x)[i].alias(c) for i, c in enumerate(cols)])
    monkeypatch.setattr(LogisticRegression, "_fit", lambda *a: pytest.fail("fitted by itself"))
    est, grid, described = TR.FAMILIES[0].build(800)
    models, none = LO.fit_together(train, est.copy({est.tol: 1e-12}), [g[est.regParam] for g in grid], 0)
    assert [m.getOrDefault("regParam") for m in models] == [1 / (d["C"] * 800) for d in described] and none == [[]] * 4
    for m in models:
        slopes = CE.logistic_gradient(train, m, cols).collect()
        assert len(slopes) == 6 and max(abs(r.slope) for r in slopes) < 1e-7

    rows = train.collect()
    values = CE.few_values(train, cols, 32)
    assert list(values) == ["c.2", "c.3", "c.4"] and [len(v) for v in values.values()] == [7, 1, 2]

    def gini(some):
        n, p = sum(r.weight for r in some), sum(r.weight for r in some if r.label == 1)
        return 1 - (p / n) ** 2 - ((n - p) / n) ** 2

    def gain(some, c, at):
        sides = [[r for r in some if (r[c] <= at) == s] for s in (True, False)]
        n = sum(r.weight for r in some)
        return gini(some) - sum(sum(r.weight for r in s) / n * gini(s) for s in sides) if all(sides) else 0.0

    path = [(4, 0.5, False)]
    at_node = {0: rows, 2: [r for r in rows if r["c.4"] > 0.5]}
    best = {i: max(gain(some, c, v) for c in ("c.2", "c.4") for v in range(-3, 4)) for i, some in at_node.items()}
    for lower in (0.0, 1e-6):
        nodes = [{"id": 0, "path": [], "leaf": False, "gain": best[0]}, {"id": 1, "path": [(4, 0.5, True)], "leaf": True},
                 {"id": 2, "path": path, "leaf": False, "gain": best[2] - lower},
                 {"id": 5, "path": [*path, (2, 1.5, True)], "leaf": True}, {"id": 6, "path": [*path, (2, 1.5, False)], "leaf": True}]
        splits = CE.best_splits(train, nodes, cols)
        assert dict(splits.collect()) == {0: True, 2: lower == 0.0}


def test_linear_svms_of_a_grid_are_fitted_together(spark, monkeypatch):
    """no SVM is fitted by itself; the models of both kernels and the AUCs are those of
    single fits, rows without a fold train the whole models only."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from platewise.plans import training as TR

    train = labelled_rows(spark, 600, 2).withColumn("fold", F.expr("if(fold = 2 and hash(features) % 7 = 0, null, fold)"))
    assert train.filter("fold is null").count() > 0
    est, grid, described = TR._svm(600)
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    fit = LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda *a: pytest.fail("fitted by itself"))
    model, best, aucs = TR.search_grid(train, est, grid[:2], ev, 3, 4)
    monkeypatch.setattr(LinearSVC, "_fit", fit)
    for i in (0, 1):
        single = [ev.evaluate(est.copy(grid[i]).fit(train.filter(F.col("fold") != k)).transform(train.filter(F.col("fold") == k)))
                  for k in range(3)]
        assert aucs[i] == pytest.approx(sum(single) / 3, abs=1e-4 if described[i]["svc__kernel"] == "rbf" else 1e-9)
    own, mine = est.copy(grid[best]).fit(train).stages[-1], model.stages[-1]
    assert np.allclose(mine.coefficients.toArray(), own.coefficients.toArray(), atol=1e-4) and mine.getRegParam() == own.getRegParam()
    assert math.isclose(mine.intercept, own.intercept, abs_tol=1e-4)
    assert model.transform(train).select("prediction", "rawPrediction").count() == 600
    one = train.filter("label = 0 or fold = 1")      # without fold 1 there is one class only: Spark's own error
    with pytest.raises(Exception, match="binary"):
        TR.search_grid(one, est, grid[1:2], ev, 3, 4)
