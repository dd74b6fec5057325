"""Exact quantiles, CSV records over lines, observed loads, as-of labels, ensembles read off
as prefixes, path-weight attributions, what-if by the active version."""

import datetime as dt
import itertools
import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise import api
from platewise.functions import vocab as V
from platewise.operators import bundle as BU
from platewise.operators import clean as CL
from platewise.operators import latest as LT
from platewise.operators import normalize as NZ
from platewise.operators import registry as RG
from platewise.operators import tree_attribution as TA
from platewise.operators.quantiles import exact_quantiles
from platewise.plans import training as TR
from platewise.sources import driver
from platewise.sources import process_log as PL


# ---- quantiles

def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 1.5, rng.gauss(0, 1)]), rng.randint(0, 5)) for _ in range(700)]
    rows += [("one", 2.25, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.column): (r.n, [r[f"q{i}"] for i in range(5)]) for r in
           exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, probs, ["g"]).collect()}
    want = {}
    for g, (c, i) in itertools.product({r[0] for r in rows}, (("x", 1), ("y", 2))):
        v = [r[i] for r in rows if r[0] == g and r[i] is not None]
        if v:
            want[(g, c)] = (len(v), np.quantile(v, probs).tolist())
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], q)
    whole = exact_quantiles(df, {"x": F.col("x")}, [0.5]).collect()
    assert math.isclose(whole[0].q0, float(np.median([r[1] for r in rows if r[1] is not None])))
    assert exact_quantiles(df.limit(0), {"x": F.col("x")}, [0.5]).count() == 0


# ---- CSV records over lines

def _log(spark, n=6):
    flat = driver.coil(spark, "/root/testdata/sf0.001").orderBy("plate_no").limit(n)
    return [r.asDict() for r in PL.to_legacy_text(flat).collect()]


def _quoted(v):
    return "" if v is None else '"' + str(v).replace('"', '""') + '"'


@pytest.mark.parametrize("split", [None, "97"])
def test_records_over_lines(spark, split):
    rows = _log(spark)
    cols = list(rows[0])
    rows[1]["spec_long"] = 'a "b"\nc,\n\nd'
    rows[3]["work_group"] = "\n"
    head = ",".join(cols)
    lines = [head] + [",".join(_quoted(r[c]) for c in cols) for r in rows] + [head, "short,line"]
    d = tempfile.mkdtemp(prefix="csv-")
    with open(f"{d}/a.csv", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    with open(f"{d}/b.csv", "w", encoding="cp949") as f:      # its last record never closes
        f.write("\n".join([head, ",".join(_quoted(rows[0][c]) for c in cols), '"open,' + "x\ny"]) + "\n")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in keep if split else ():
            spark.conf.set(c, split)
        got = PL.read_process_log(spark, f"{d}/*.csv").collect()
        bad = PL.rejected_lines(spark, f"{d}/*.csv").collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    want = sorted([(r["plate_no"], r["spec_long"], r["work_group"]) for r in rows] + [
        (rows[0]["plate_no"], rows[0]["spec_long"], rows[0]["work_group"])])
    assert sorted((r.plate_no, r.spec_long, r.work_group) for r in got) == want
    assert sorted((r.line, r.reason) for r in bad) == sorted([
        (head, "repeated_header"), ("short,line", "malformed"), ('"open,x', "unclosed_quote"), ("y", "unclosed_quote")])


# ---- loads and labels

def test_observed_load(spark):
    root = tempfile.mkdtemp(prefix="load-")
    raw = driver.raw_coil(spark, "/root/testdata/sf0.001")
    report = {r.table_name: r.rows_written for r in api.load(raw, root).collect()}
    assert report["plate"] == report["rolling_process"] > 0 and report["quarantine"] > 0
    assert all(spark.read.parquet(f"{root}/{n}").count() == k for n, k in report.items())
    again = NZ.load(raw, root, spark.read.parquet(f"{root}/plate"), spark.read.parquet(f"{root}/product_spec"))
    assert {r.table_name: r.rows_written for r in again.collect()}["plate"] == 0      # a second run writes nothing new


def test_labels_as_of(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    log = spark.createDataFrame([("P1", "Scale", t[0]), ("P1", "없음", t[2]), ("P2", "Scale", t[1])],
                                "plate_no string, defect_type string, inspected_at timestamp_ntz")

    def at(x):
        return sorted((r.plate_no, r.defect_type) for r in LT.latest_inspection(log, as_of=x).collect())

    assert at(t[0]) == [("P1", "Scale")]
    assert at(t[1]) == [("P1", "Scale"), ("P2", "Scale")]
    assert at(t[2]) == [("P1", "없음"), ("P2", "Scale")] == sorted((r.plate_no, r.defect_type) for r in LT.latest_inspection(log).collect())


def test_params_in_document_order(spark):
    doc = '{"valid": {"auc": 0.9, "best_params": {"n_estimators": 100, "max_depth": 5, "C": "x"}}}'
    df = spark.createDataFrame([(doc, "A")], "m string, a string")
    valid, _ = RG.extract_metrics(F.col("m"), F.col("a"))
    assert df.select(RG.params_text(valid["best_params"]).alias("p")).first().p == "n_estimators=100, max_depth=5, C=x"


# ---- ensembles

@pytest.fixture(scope="module")
def small(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    rows = [(f"P{i}", *map(float, rng.normal(size=3)), float(rng.random() < 0.5), i % 3) for i in range(400)]
    rows = [(p, a, b, c, float(a + b * b + 0.3 * y > 0.8), f) for p, a, b, c, y, f in rows]
    df = spark.createDataFrame(rows, "plate_no string, a double, b double, c double, label double, fold int").withColumn("weight", F.lit(1.0))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).checkpoint()


@pytest.mark.parametrize("family,size,k", [("GradientBoostingA", "maxIter", 4), ("RandomForest", "numTrees", 3)])
def test_prefix_equals_smaller_fit(small, family, size, k):
    est = next(f for f in TR.FAMILIES if f.name == family).build(1)[0]
    if family == "RandomForest":     # a forest's trees depend on their number through the bootstrap seeds
        est = est.copy({est.subsamplingRate: 1.0, est.getParam("featureSubsetStrategy"): "all", est.getParam("bootstrap"): False})
    whole = est.copy({est.getParam(size): 7, est.maxDepth: 3}).fit(small)
    fewer = est.copy({est.getParam(size): k, est.maxDepth: 3}).fit(small)
    prefix = TR.ensemble_prefix(whole, k)

    def probs(m):
        return [r.plate_no + str(r.probability) for r in m.transform(small).orderBy("plate_no").collect()]

    assert prefix.getNumTrees == k and probs(prefix) == probs(fewer)


def test_search_prefixes(small):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    fam = TR.smaller_ensembles(next(f for f in TR.FAMILIES if f.name == "GradientBoostingA"), [2, 5], max_depth=3, learning_rate=0.1)
    est, grid, described = fam.build(1)
    ev = BinaryClassificationEvaluator(labelCol="label")
    best, i, aucs = TR.search_prefixes(small, est, grid, "maxIter", ev, 3, 4)
    assert described[i]["n_estimators"] == best.stages[-1].getNumTrees
    direct = [sum(ev.evaluate(est.copy(g).fit(small.filter(F.col("fold") != k)).transform(small.filter(F.col("fold") == k)))
                  for k in range(3)) / 3 for g in grid]
    assert np.allclose(aucs, direct) and i == int(np.argmax(direct))


def test_random_features_approach_the_kernel(spark, small):
    from pyspark.ml import Pipeline, PipelineModel

    from platewise.plans import kernel as KE

    x = np.random.default_rng(1).normal(size=(40, 5))
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    errors = [np.abs(z @ z.T - exact).max() for d in (50, 20_000) for z in [KE.features(x, *KE.fourier_weights(5, d, 0.0, 42))]]
    assert errors[1] < 0.04 < errors[0] < 1.0
    est, grid, described = next(f for f in TR.FAMILIES if f.name == "SVM").build(400)
    assert [d["svc__kernel"] for d in described] == ["rbf", "linear"] * 3
    model = est.copy(grid[2]).fit(small)
    path = tempfile.mkdtemp(prefix="rbf-") + "/m"
    model.write().save(path)
    both = [[r.prediction for r in m.transform(small).orderBy("plate_no").collect()] for m in (model, PipelineModel.load(path))]
    truth = [r.label for r in small.orderBy("plate_no").collect()]
    linear = [r.prediction for r in est.copy(grid[3]).fit(small).transform(small).orderBy("plate_no").collect()]
    assert both[0] == both[1]
    # the label depends on b squared, which the linear kernel doesn't see
    assert sum(a == b for a, b in zip(both[0], truth)) > sum(a == b for a, b in zip(linear, truth))
    assert isinstance(est, Pipeline)


def test_path_contributions_are_shapley_values(spark, small):
    est = next(f for f in TR.FAMILIES if f.name == "GradientBoostingA").build(1)[0]
    model = est.copy({est.maxIter: 3, est.maxDepth: 4}).fit(small)
    path = tempfile.mkdtemp(prefix="gbt-") + "/m"
    model.write().save(path)
    leaves = TA.boosted_leaves(spark, path, list(model.treeWeights))
    rows = small.orderBy("plate_no").limit(12).collect()
    x = np.array([[r.a, r.b, r.c] for r in rows])

    def value(row, known):
        return sum(v * math.prod((float(lo < row[f] <= hi or (hi == math.inf and row[f] > lo)) if f in known else z)
                                 for f, lo, hi, z in zip(fs, los, his, zs)) for v, fs, los, his, zs in leaves)

    got = TA.path_contributions(x, leaves)
    for row, phi in zip(x, got):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(row, {*s, j}) - value(row, set(s)))
                       for n in range(3) for s in itertools.combinations(others, n))
            assert math.isclose(phi[j], want, abs_tol=1e-9)
    logits = {r.plate_no: 2 * r.rawPrediction[1] for r in model.transform(small).collect()}
    for r, phi in zip(rows, got):
        assert math.isclose(phi.sum() + TA.expected(leaves), logits[r.plate_no], abs_tol=1e-9)


# ---- what-if by the active version

def test_what_if_needs_an_active_version(spark):
    flat = driver.coil(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="registry-")
    with pytest.raises(ValueError):
        api.what_if(flat.drop("scale"), root)
    medians, fallback = api.fit_imputer(flat)
    background = spark.createDataFrame([(100.0,), (200.0,)], "temp_drop double")
    BU.save_linear(f"{root}/m", {"temp_drop": -0.03}, 4.0, 0.5, medians, fallback, background)
    RG.append_versions(spark.createDataFrame([(7, V.MODEL_NAME, "A", "A-1", dt.datetime(2024, 1, 1), f"{root}/m")],
                                             "id long, name string, algorithm string, version string, trained_at timestamp_ntz, "
                                             "artifact_path string"), root)
    RG.append_activations(spark.createDataFrame([(V.MODEL_NAME, 7, dt.datetime(2024, 1, 1), "manual")],
                                                "name string, model_id long, activated_at timestamp_ntz, reason string"), root)
    asked = flat.drop("scale").limit(20).withColumn("rolling_temp", F.lit(None).cast("int"))
    for r in api.what_if(asked, root).collect():
        assert r.model_version == f"{V.MODEL_NAME} A-1" and r.rolling_temp is not None
        assert [(t.feature, round(t.contribution, 6)) for t in r.top_features] == [("temp_drop", round(-0.03 * (r.temp_drop - 150), 6))]


def test_too_few_rows_to_train(spark):
    few = driver.coil(spark, "/root/testdata/sf0.001").limit(10)
    medians, fallback = CL.fit_temp_imputer(api._serving_tokens(few))
    rows = few.select("plate_no", "rolling_date")
    with pytest.raises(ValueError, match="at least 50"):
        TR.train_compare(rows.withColumn("target", F.lit(1)))


def test_attributions_by_patterns_of_conditions():
    """A leaf's background is weighed once per pattern of met conditions, not once per row."""
    import numpy as np

    from platewise.operators import tree_attribution as TA

    rng = np.random.default_rng(3)
    for rows, conditions in ((500, 3), (20, 12), (0, 2)):
        met = rng.integers(0, 2, (rows, conditions)).astype(float)
        patterns, of_row = TA._patterns(met)
        assert (patterns[of_row] == met).all()
        assert len(patterns) == len({tuple(m) for m in met})


def test_search_grid_is_the_cross_validation(spark):
    """Same AUCs and choice as Spark's cross validation by the fold column."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.tuning import CrossValidator

    from platewise.plans import training as TR

    rows = [(Vectors.dense([i % 7, i % 11]), float(i % 7 > 3 or i % 11 == 5), 1.0, i % 3) for i in range(200)]
    train = spark.createDataFrame(rows, ["features", "label", "weight", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    est = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=42)
    grid = [{est.maxDepth: d} for d in (1, 3)]
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label", metricName="areaUnderROC")
    model, best, aucs = TR.search_grid(train, est, grid, ev, 3, 2)
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=3, seed=42).fit(train)
    assert aucs == pytest.approx(cv.avgMetrics) and best == 1
    assert model.stages[-1].toDebugString.split("\n")[1:] == cv.bestModel.toDebugString.split("\n")[1:]


def test_logistic_grid_is_fitted_together(spark):
    """Every fit of the grid is Spark's (F4, F6, F17), in a few jobs for all instead of a job per step and fit."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors

    from platewise.plans import training as TR

    def row(i):
        heat, off = 900.0 + (i * 37) % 211, float(i % 3 == 0)
        noise = (i * 7919) % 101
        return Vectors.dense(heat, off, heat - 12.0 * off, 5.0), float(heat - 40 * off + noise > 1040), 1.0 + i % 2, i % 3

    train = spark.createDataFrame([row(i) for i in range(600)], ["features", "label", "weight", "fold"]).coalesce(2).cache()
    est, grid, _ = TR.FAMILIES[0].build(600)
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    model, best, aucs = TR.search_grid(train, est, grid, ev, 3, 4)
    assert scheduler.numTotalJobs() - before < 160
    assert len(aucs) == len(grid) and best == max(range(len(grid)), key=lambda i: (aucs[i], -i))
    own = est.copy({**grid[best], est.tol: 1e-12})
    kept = own.fit(train)
    assert max(abs(a - b) for a, b in zip(model.stages[0].coefficients, kept.coefficients, strict=True)) < 1e-3
    held = train.filter("fold = 1")
    mean = sum(ev.evaluate(own.fit(train.filter(f"fold <> {k}")).transform(train.filter(f"fold = {k}"))) for k in range(3)) / 3
    assert abs(aucs[best] - mean) < 1e-6 and model.transform(held).filter("prediction = label").count() > 100


def test_logistic_fit_of_one_class_is_constant(spark):
    from pyspark.ml.linalg import Vectors

    from platewise.plans import logistic as LO
    from platewise.plans import training as TR

    rows = [(Vectors.dense(float(i), 1.0), float(i < 10 and i % 2), 1.0, 0 if i < 10 else 1) for i in range(30)]
    train = spark.createDataFrame(rows, ["features", "label", "weight", "fold"])
    whole, (parts,) = LO.fit_together(train, TR.FAMILIES[0].build(30)[0], [0.01], 2)
    assert parts[0].intercept == float("-inf") and list(parts[0].coefficients) == [0.0, 0.0]
    assert abs(whole[0].coefficients[0]) > 0 and whole[0].coefficients[1] == 0.0


def test_shallow_trees_are_read_off_the_deepest(spark):
    """A tree of each depth of the grid is the first levels of the deepest (F5): same nodes as
    a fit of its own, one fit per fold and leaf size."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([i % 13, (i * 31) % 47, (i * 7919) % 101, i % 2]),
             float((i * i * 31 + i * 7) % 17 < 8), 1.0 + i % 2, i // 7 % 2) for i in range(900)]
    train = spark.createDataFrame(rows, ["features", "label", "weight", "fold"]).coalesce(1).cache()
    fam = next(f for f in TR.FAMILIES if f.name == "DecisionTree")
    est, grid, described = fam.build(900)
    deep = est.copy({est.maxDepth: 30, est.minInstancesPerNode: 1}).fit(train)
    assert deep.depth > 8
    for depth in (0, 1, 3, 5, 8):
        own, cut = est.copy({est.maxDepth: depth, est.minInstancesPerNode: 1}).fit(train), TR.prefix(deep, depth)
        assert cut.toDebugString.split("\n")[1:] == own.toDebugString.split("\n")[1:] and cut.getMaxDepth() == depth
        got = [[str(r[c]) for r in m.transform(train).collect()] for m in (cut, own) for c in ("rawPrediction", "prediction")]
        assert got[:2] == got[2:]
    wanted = [i for i, d in enumerate(described) if d["min_samples_leaf"] == 5]
    some = [grid[i] for i in wanted]
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    assert fam.size_param == "maxDepth"
    model, best, aucs = TR.search_prefixes(train, est, some, fam.size_param, ev, 2, 4)
    plain, place, one_by_one = TR.search_grid(train, est, some, ev, 2, 4)
    assert best == place and aucs == pytest.approx(one_by_one)


def test_folds_are_ranked_without_the_model_columns(spark, sf001, monkeypatch):
    from platewise.operators import splits as SP
    from platewise.plans import catalog as CT

    seen, fold = [], SP.stratified_folds
    monkeypatch.setattr(SP, "stratified_folds", lambda df, *a: seen.append(df.columns) or fold(df, *a))
    frame = CT.training_features(spark, sf001)
    data = TR.prepare(frame)[0]
    assert seen == [["plate_no", "target", "pos"]]
    train = data.filter("split = 'train'")
    wide = fold(train.drop("fold"), "target", "pos", 5).select("plate_no", "fold")
    assert train.select("plate_no", "fold").exceptAll(wide).count() == 0 and train.count() == wide.count() > 0


def test_families_with_equal_weights_share_their_rows(spark, sf001, monkeypatch):
    from platewise.plans import catalog as CT

    modes, weigh = [], TR.with_weights
    monkeypatch.setattr(TR, "with_weights", lambda df, label, mode: modes.append(mode) or weigh(df, label, mode))
    by = {f.name: f for f in TR.FAMILIES}
    shallow = TR.grid_of("DecisionTree", [{"max_depth": 3, "min_samples_leaf": 10}])
    families = [TR.Family("DecisionTree", shallow), TR.smaller_ensembles(by["GradientBoostingA"], [1], max_depth=3, learning_rate=0.1),
                TR.Family("DecisionTree", shallow)]
    rows = TR.train_compare(CT.training_features(spark, sf001), families).comparison.collect()
    assert modes == ["balanced", "ratio"]
    assert [r.algorithm for r in rows] == ["DecisionTree", "GradientBoostingA", "DecisionTree"] and rows[0] == rows[2]


def test_random_features_of_a_frame(spark):
    from pyspark.ml.linalg import Vectors

    from platewise.plans import kernel as KE

    x = np.random.default_rng(2).normal(size=(30, 4))
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["i", "x"])
    got = KE.RandomFourier(inputCol="x", outputCol="z", dims=7, seed=5).transform(df).orderBy("i").collect()
    assert np.allclose([r.z.toArray() for r in got], KE.features(x, *KE.fourier_weights(4, 7, 0.0, 5)))
    assert KE.RandomFourier(inputCol="x", outputCol="z", dims=7).transform(df.filter("i < 0")).count() == 0
