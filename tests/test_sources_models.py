"""Table creation (S6) and model artefacts (S9) on small inputs."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from platewise.sources import process_log as PL


def test_create_tables(spark):
    root = tempfile.mkdtemp(prefix="tables-")
    made = PL.create_tables(spark, root)
    assert set(made) == set(PL.TABLE_SCHEMAS)
    assert PL.create_tables(spark, root) == []          # idempotent
    t = spark.read.parquet(os.path.join(root, "rolling_process"))
    assert t.count() == 0 and t.schema["rolling_temp"].dataType.typeName() == "integer"


def test_model_save_load_and_score(spark):
    from platewise.plans import training as TR
    rows = [(f"p{i}", float(i % 7), float((i * 3) % 5), "C" if i % 2 else "T", i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "plate_no string, a double, b double, steel_kind string, y boolean")
    vocab = TR.fit_vocabulary(df, ["steel_kind"])
    assert vocab == {"steel_kind": ["C", "T"]}
    names = [n for n, _ in TR.dummy_columns(vocab)]
    assert names == ["steel_kind_T"]                      # drop-first baseline 'C'
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    data = df.withColumn("steel_kind_T", (F.col("steel_kind") == "T").cast("double")).withColumn("label", F.col("y").cast("double"))
    vec = VectorAssembler(inputCols=["a", "b", "steel_kind_T"], outputCol="features").transform(data)
    model = Pipeline(stages=[LogisticRegression(maxIter=50)]).fit(vec)
    path = os.path.join(tempfile.mkdtemp(prefix="model-"), "m")
    model.write().overwrite().save(path)
    medians = spark.createDataFrame([("C", "CR", 900.0)], "steel_kind string, rolling_method string, group_median double")
    fallback = spark.createDataFrame([(910.0,)], "global_median double")
    TR.save_bundle(f"file:{path}", model, ["a", "b", "steel_kind_T"], vocab, None, 0.4, medians, fallback, data.limit(5))
    side = TR.load_bundle(f"file:{path}")
    loaded = side["model"]
    assert side["threshold"] == 0.4 and side["background"].count() == 5
    assert side["medians"].collect() == medians.collect() and side["fallback"].first()[0] == 910.0
    p1 = [r["probability"][1] for r in model.transform(vec).select("probability").collect()]
    p2 = [r["probability"][1] for r in loaded.transform(vec).select("probability").collect()]
    assert p1 == p2 and side["vocabulary"] == vocab


def test_create_tables_keeps_rows_on_a_uri(spark, tmp_path):
    from platewise.sources import process_log as PL

    root = f"file:{tmp_path}/tables"
    made = PL.create_tables(spark, root)
    name = made[0]
    schema = PL.TABLE_SCHEMAS[name]
    row = [dt.datetime(2024, 1, 1) if "timestamp" in f.dataType.simpleString() else
           (True if f.dataType.simpleString() == "boolean" else "x" if f.dataType.simpleString() == "string" else 1)
           for f in schema]
    spark.createDataFrame([tuple(row)], schema).write.mode("append").parquet(f"{root}/{name}")
    assert PL.create_tables(spark, root) == []
    assert spark.read.parquet(f"{root}/{name}").count() == 1


def test_null_category_is_all_zeros(spark):
    from platewise.plans.training import dummy_columns

    df = spark.createDataFrame([("b",), (None,)], "c string")
    got = [tuple(r) for r in df.select(*[e.alias(n) for n, e in dummy_columns({"c": ["a", "b", "d"]})]).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0)]


def test_active_version_scores(spark, sf001, tmp_path):
    import datetime as dt

    from pyspark.ml import Pipeline

    from platewise import api
    from platewise.functions import features as FE
    from platewise.functions import vocab as V
    from platewise.operators import clean as CL
    from platewise.plans import catalog as CT
    from platewise.plans import training as TR
    from platewise.sources import driver

    flat = driver.coil(spark, sf001)
    medians, fallback = api.fit_imputer(flat)
    feats = FE.serving_features(CL.impute_group_median(CT.serving_input(spark, sf001), global_after_group=False,
                                                       medians=medians, fallback=fallback),
                                keep=["plate_no", "target", "rolling_date"])
    data, cols, vocab = TR.prepare(feats)
    models = {n: (Pipeline(stages=[TR.fit_one(data, "DecisionTree", p)]).fit(data), None)
              for n, p in (("A", {"maxDepth": 2}), ("B", {"maxDepth": 6}))}
    rows = TR.save_models(TR.TrainResult(medians, models, cols, vocab, data), f"file:{tmp_path}", "t", medians, fallback)
    assert [r["version"] for r in rows] == ["A-t", "B-t"] and rows[0]["train_row_count"] > 0
    reg = spark.createDataFrame([(V.MODEL_NAME, i, r["artifact_path"], r["version"]) for i, r in enumerate(rows)],
                                "name string, model_id long, artifact_path string, version string")
    log = spark.createDataFrame([(V.MODEL_NAME, 0, dt.datetime(2024, 1, 1), "bootstrap")],
                                "name string, model_id long, activated_at timestamp_ntz, reason string")
    first = api.score_active(flat, reg, log)
    assert {r["model_version"] for r in first.select("model_version").distinct().collect()} == {"A-t"}
    second = api.score_active(flat, reg, api.activate(log, reg, 1, dt.datetime(2024, 2, 1)))
    want = {r["plate_no"]: r["p"] for r in models["B"][0].transform(data.select("plate_no", "features")).select(
        "plate_no", F.round(_second("probability"), 4).alias("p")).collect()}
    got = {r["plate_no"]: r["predicted_prob"] for r in second.collect()}
    assert got == want and len(got) == flat.count()
    one = flat.limit(1).withColumn("rolling_temp", F.lit(None).cast("int")).drop("scale")
    row = api.score_active(one, reg, log).collect()[0]
    assert row["predicted_prob"] is not None and row["rolling_temp"] > 0
    with pytest.raises(ValueError):
        api.score_active(one, reg, log.limit(0))


def _second(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(c)[1]


def test_splits_of_a_large_log_are_bounded(spark, tmp_path, monkeypatch):
    """64 KB a split for a small log; a larger one has larger splits, not more than 512 of them."""
    from platewise.plans import catalog as CA
    from platewise.sources import process_log as PL

    (tmp_path / "a.csv").write_text("x" * 1000)
    (tmp_path / "b.csv").write_text("y" * 500)
    assert PL.bytes_of(spark, f"{tmp_path}/*.csv") == 1500
    seen = []
    monkeypatch.setattr(PL, "parsed_lines", lambda s, p: seen.append(
        int(s.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))) or s.range(1))
    for size in (1500, 512 * 65_536 * 10):
        monkeypatch.setattr(PL, "bytes_of", lambda s, p, size=size: size)
        CA.parsed_in_small_splits(spark, f"{tmp_path}/*.csv")
    assert seen == [65_536, 655_360]
