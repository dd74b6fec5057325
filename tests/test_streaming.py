"""Streaming ingestion: restart without duplicates, replays across batches dropped,
quarantine reasons (SURVEY §5 e), the active version scores, failed batches leave nothing."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from platewise.functions import vocab as V
from platewise.operators import bundle as BU
from platewise.operators import clean as CL
from platewise.operators import registry as RG
from platewise.streaming import ingest as IN
from platewise.streaming.outputs import BatchOutputs

ROLLING = ("plate_no string, hsb_applied boolean, rolling_method string, rolling_temp int, descaling_count int, "
           "work_group string, rolling_date timestamp_ntz")


def _tables(spark):
    t = dt.datetime(2024, 1, 1, 8)
    plates = spark.createDataFrame([("P1", "S1", 30, 3000, 12000, t), ("P2", "S1", 45, 3000, 12000, t),
                                    ("P3", "S1", 20, 3000, 12000, t)],
                                   "plate_no string, spec_code string, pt_thick int, pt_width int, pt_length int, created_at timestamp_ntz")
    specs = spark.createDataFrame([("S1", "AB", "C1", "T")], "spec_code string, spec_long string, spec_country string, steel_kind string")
    furnace = spark.createDataFrame(
        [("P1", t, 1, 1, 1150, 100, 1140, 60, 250), ("P2", t, 2, 1, 1150, 100, 1140, 60, 0)],
        "plate_no string, recorded_at timestamp_ntz, fur_no int, fur_input_row int, fur_heat_temp int, "
        "fur_heat_time int, fur_soak_temp int, fur_soak_time int, fur_total_time int")
    history = spark.createDataFrame([("P0", "T", "TMCP", 900), ("P9", "T", "CR", 950)],
                                    "plate_no string, steel_kind string, rolling_method string, rolling_temp int")
    medians, fallback = CL.fit_temp_imputer(history)
    return plates, specs, furnace, medians, fallback


def _registry(spark, medians, fallback):
    """Two versions; the first is active."""
    root = tempfile.mkdtemp(prefix="registry-")
    background = spark.createDataFrame([(100.0, 1), (200.0, 0)], "temp_drop double, descaling_is_odd int")
    for mid, w in ((1, -0.03), (2, 0.5)):
        BU.save_linear(f"{root}/m{mid}", {"temp_drop": w, "descaling_is_odd": 1.0}, 4.0, 0.5, medians, fallback, background)
        RG.append_versions(spark.createDataFrame(
            [(mid, V.MODEL_NAME, f"A{mid}", f"A{mid}-1", dt.datetime(2024, 1, 1), f"{root}/m{mid}")],
            "id long, name string, algorithm string, version string, trained_at timestamp_ntz, artifact_path string"), root)
    _activate(spark, root, 1, 1)
    return root


def _activate(spark, root, model_id, day):
    RG.append_activations(spark.createDataFrame(
        [(V.MODEL_NAME, model_id, dt.datetime(2024, 1, day), "manual")],
        "name string, model_id long, activated_at timestamp_ntz, reason string"), root)


def test_restart_and_replay(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    t = dt.datetime(2024, 1, 1, 9)
    first = [("P1", False, "TMCP", 920, 8, "1조", t), ("P2", True, "TMCP", 1050, 8, "1조", t),
             ("P3", True, "TMCP", 900, 8, "1조", t), ("PX", True, "TMCP", 900, 8, "1조", t)]
    spark.createDataFrame(first, ROLLING).write.mode("append").parquet(src)
    plates, specs, furnace, medians, fallback = _tables(spark)
    registry = _registry(spark, medians, fallback)

    def run(furnace=furnace):
        stream = spark.readStream.schema(ROLLING).parquet(src)
        IN.start_rolling_ingest(stream, plates, specs, furnace, None, registry, out).awaitTermination()
        return {n: IN.stream_table(spark, out, n).collect() for n in IN.STREAM_TABLES}

    got = run()
    assert sorted(r["plate_no"] for r in got["rolling"]) == ["P1", "P2"]
    assert {r["plate_no"]: r["reason"] for r in got["quarantine"]} == {"P3": "furnace_record_missing", "PX": "plate_missing"}
    codes = sorted((r["plate_no"], r["rule_code"]) for r in got["alerts"])
    assert codes == [("P1", V.RULE_HSB), ("P2", V.RULE_HOT), ("P2", V.RULE_DROP)]
    assert sorted((r["plate_no"], r["model_version_id"]) for r in got["predictions"]) == [("P1", 1), ("P2", 1)]
    p1 = next(r for r in got["predictions"] if r["plate_no"] == "P1")
    assert json.loads(p1["feature_snapshot"])["temp_drop"] == 220.0
    shap = sorted((r["rank"], r["feature_name"], round(r["shap_value"], 6)) for r in got["explanations"] if r["prediction_id"] == p1["id"])
    assert shap == [(1, "temp_drop", -2.1), (2, "descaling_is_odd", -0.5)]

    assert len(run()["rolling"]) == 2          # restart, nothing new: no duplicates

    # a replay of P1 and a second record of it, in files of their own; another version is active
    _activate(spark, registry, 2, 5)
    spark.createDataFrame([first[0]], ROLLING).write.mode("append").parquet(src)
    spark.createDataFrame([("P1", True, "TMCP", 900, 8, "1조", t + dt.timedelta(days=2)),
                           ("PX", True, "TMCP", 900, 8, "1조", dt.datetime(1992, 5, 1))], ROLLING).write.mode("append").parquet(src)
    got = run()
    assert sorted(r["plate_no"] for r in got["rolling"]) == ["P1", "P2"]
    q = sorted((r["plate_no"], r["reason"]) for r in got["quarantine"])
    assert q == [("P1", "second_rolling_record"), ("P3", "furnace_record_missing"), ("PX", "plate_missing"), ("PX", "plate_missing")]

    # P3 has a furnace record by now: its record, sent again, is judged anew and scored by version 2
    more = furnace.unionByName(furnace.limit(1).withColumn("plate_no", F.lit("P3")))
    spark.createDataFrame([first[2], first[0]], ROLLING).write.mode("append").parquet(src)
    got = run(more)
    assert sorted(r["plate_no"] for r in got["rolling"]) == ["P1", "P2", "P3"]
    assert {r["plate_no"]: r["model_version_id"] for r in got["predictions"]} == {"P1": 1, "P2": 1, "P3": 2}
    assert len({r["id"] for r in got["predictions"]}) == 3


def test_earlier_history_counts(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    t = dt.datetime(2024, 1, 1, 9)
    rows = [("P1", True, "TMCP", 900, 8, "1조", t), ("P2", True, "TMCP", 900, 8, "1조", t), ("P2", True, "TMCP", 910, 8, "1조", t - dt.timedelta(days=1))]
    spark.createDataFrame(rows, ROLLING).write.parquet(f"{root}/in")
    plates, specs, furnace, _, _ = _tables(spark)
    history = spark.createDataFrame([("P1", True, "TMCP", 900, 8, "1조", t - dt.timedelta(days=9))], ROLLING)
    IN.start_rolling_ingest(spark.readStream.schema(ROLLING).parquet(f"{root}/in"), plates, specs, furnace, history, None,
                            f"{root}/out").awaitTermination()
    assert [(r.plate_no, r.rolling_temp) for r in IN.stream_table(spark, f"{root}/out", "rolling").collect()] == [("P2", 910)]
    q = IN.stream_table(spark, f"{root}/out", "quarantine").collect()
    assert sorted((r.plate_no, r.rolling_temp, r.reason) for r in q) == [
        ("P1", 900, "second_rolling_record"), ("P2", 900, "second_rolling_record")]
    assert IN.stream_table(spark, f"{root}/out", "alerts").count() == 0
    assert IN.stream_table(spark, f"{root}/out", "predictions").count() == 0      # no registry


def test_failed_batch_leaves_nothing(spark):
    root = tempfile.mkdtemp(prefix="outputs-")
    out = BatchOutputs(spark, root)
    good, bad = spark.range(3).withColumn("id", F.col("id")), spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception):
        out.write(0, {"a": good, "b": bad})
    assert out.read("a", "id long").count() == 0
    out.write(0, {"a": good, "b": good})
    out.write(0, {"a": spark.range(50), "b": good})          # committed: not written again
    out.write(1, {"a": spark.range(10, 12), "b": good})
    assert sorted(r.id for r in out.read("a", "id long").collect()) == [0, 1, 2, 10, 11]


def test_rejected_labels_are_kept(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    schema = "plate_no string, inspector_email string, defect_type string"
    spark.createDataFrame([("P1", "a@x", "none"), ("P1", "b@x", "none"), ("P7", "a@x", "none")], schema).write.parquet(src)
    plates = spark.createDataFrame([("P1",)], "plate_no string")
    users = spark.createDataFrame([("a@x", 1)], "email string, user_id long")
    IN.start_inspection_ingest(spark.readStream.schema(schema).parquet(src), plates, users, out).awaitTermination()
    done = BatchOutputs(spark, out)
    assert [(r.plate_no, r.user_id) for r in done.read("inspections", schema + ", user_id long").collect()] == [("P1", 1)]
    q = sorted((r.plate_no, r.inspector_email, r.reason) for r in done.read("quarantine", schema + ", reason string").collect())
    assert q == [("P1", "b@x", "inspector_missing"), ("P7", "a@x", "plate_missing")]


def test_plate_judged_within_one_micro_batch(spark):
    """Of several sound records in one micro-batch the earliest is accepted (NULL first), records
    without a furnace record don't take the plate, plates of the history are taken."""
    from platewise.streaming import gate as GA

    t = dt.datetime(2024, 1, 1, 9)
    rows = [("P1", True, True, False, t), ("P1", True, True, False, t - dt.timedelta(hours=1)), ("P1", True, True, True, t),
            ("P2", True, False, False, t), ("P3", False, False, False, t), (None, False, False, False, t),
            ("P4", True, True, False, t), ("P5", True, True, False, None), ("P5", True, True, False, t), ("P5", True, True, True, t)]
    batch = spark.createDataFrame(rows, "plate_no string, has_plate boolean, has_furnace boolean, first_sound boolean, "
                                        "rolling_date timestamp_ntz")
    got = sorted(((r["plate_no"] or "", r["rolling_date"] is None, r["outcome"]) for r in GA.judged(
        batch, ["plate_no", "rolling_date"]).collect()))
    assert got == [("", False, GA.NO_PLATE), ("P1", False, GA.ACCEPTED), ("P1", False, GA.SECOND), ("P2", False, GA.NO_FURNACE),
                   ("P3", False, GA.NO_PLATE), ("P4", False, GA.SECOND), ("P5", False, GA.SECOND), ("P5", True, GA.ACCEPTED)]


def test_backlog_in_bounded_micro_batches(spark):
    root = tempfile.mkdtemp(prefix="backlog-")
    spark.range(0, 100, 1, 100).write.parquet(f"{root}/in")
    assert IN.files_per_batch(spark, f"{root}/in") == 13
    assert IN.files_per_batch(spark, f"{root}/in", least=50) == 50


def test_the_log_is_stored_once_for_its_arrivals(spark, sf001):
    from platewise.plans import catalog as CT
    from platewise.sources import driver

    coil = CT.stream_tables(spark, sf001)["coil"]
    assert not any(f.startswith(("file:" + sf001, sf001)) for f in coil.inputFiles())
    assert "Join" not in coil._jdf.queryExecution().optimizedPlan().toString()
    direct = driver.coil(spark, sf001)
    assert coil.count() == direct.count() and coil.exceptAll(direct).count() == 0
