"""Entry-point functions on small hand-made batches."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from platewise import api
from platewise.functions import vocab as V
from platewise.operators import registry as RG
from platewise.sources import process_log as PL

FLAT_SCHEMA = ("plate_no string, spec_long string, spec_country string, steel_kind string, pt_thick int, pt_width int, "
               "pt_length int, hsb string, fur_no string, fur_input_row string, fur_heat_temp int, fur_heat_time int, "
               "fur_soak_temp int, fur_soak_time int, fur_total_time int, rolling_method string, rolling_temp int, "
               "descaling_count int, work_group string, rolling_date timestamp_ntz, scale string")


def smoke_flat(spark):
    t = dt.datetime(2026, 8, 14, 7, 20)
    base = ("AB/EH32-TM", "미국", "T", 32, 3700, 15100)
    fur = ("1호기", "1열", 1150, 116, 1140, 59, 259)
    rows = [("TEST_HSB_OFF", *base, V.HSB_OFF, *fur, "TMCP", 920, 8, "1조", t, V.SCALE_DEFECT),
            ("TEST_HOT", *base, V.HSB_ON, *fur, "TMCP", 1050, 8, "1조", t, V.SCALE_DEFECT),
            ("TEST_COOLDROP", *base, V.HSB_ON, *fur, "TMCP", 980, 8, "1조", t, V.SCALE_GOOD),
            ("TEST_CLEAN", *base, V.HSB_ON, *fur, "TMCP", 900, 8, "1조", t, V.SCALE_GOOD)]
    return spark.createDataFrame(rows, FLAT_SCHEMA)


def test_score_table_smoke_cases(spark):
    scored = api.score_table(smoke_flat(spark), *api.fit_imputer(smoke_flat(spark)))
    got = {r["plate_no"]: r for r in scored.select(
        "plate_no", F.transform("fired_rules", lambda x: x["rule_code"]).alias("codes"), "predicted_prob",
        "actual_label", "correct").collect()}
    assert "HSB_NOT_APPLIED" in got["TEST_HSB_OFF"]["codes"]
    assert "ROLLING_TEMP_OVER_1000" in got["TEST_HOT"]["codes"]
    assert "TEMP_DROP_INSUFFICIENT" in got["TEST_COOLDROP"]["codes"]
    assert got["TEST_CLEAN"]["codes"] == []
    assert got["TEST_HSB_OFF"]["predicted_prob"] > got["TEST_CLEAN"]["predicted_prob"]
    summary = api.score_summary(scored, "m v1").collect()[0]
    assert summary["total_rows"] == 4 and summary["tp"] + summary["fp"] + summary["tn"] + summary["fn"] == 4


def test_score_scenarios_null_reading_is_imputed(spark):
    flat = smoke_flat(spark).withColumn("rolling_temp", F.when(F.col("plate_no") == "TEST_CLEAN", None)
                                        .otherwise(F.col("rolling_temp")))
    fitted = api.fit_imputer(smoke_flat(spark))     # readings 920, 1050, 980, 900
    alone = flat.filter(F.col("plate_no") == "TEST_CLEAN")
    in_file = {r["plate_no"]: r for r in api.score_scenarios(flat, *fitted).collect()}["TEST_CLEAN"]
    row = api.score_scenarios(alone, *fitted).collect()[0]
    assert row["rolling_temp"] == 950.0 and row["predicted_label"] is not None
    assert row["predicted_prob"] == in_file["predicted_prob"]


def test_ingest_plates_quarantine_and_codes(spark):
    rows = [("P1", "A", "X", "T", 10, 10, 10), ("P1", "A", "X", "T", 10, 10, 10), ("P2", "B", "X", "Q", 10, 10, 10),
            ("P3", "C", "Y", "C", 0, 10, 10), ("P4", "D", "Y", "C", 5, 5, 5), ("P5", "A", "X", "T", 1, 1, 1)]
    recs = spark.createDataFrame(rows, "plate_no string, spec_long string, spec_country string, steel_kind string, "
                                       "pt_thick int, pt_width int, pt_length int")
    specs = spark.createDataFrame([("SPEC001", "A", "X", "T")], "spec_code string, spec_long string, spec_country string, steel_kind string")
    existing = spark.createDataFrame([("P5",)], "plate_no string")
    out = api.ingest_plates(recs, specs, existing)
    q = {r["plate_no"]: r["reason"] for r in out["quarantine"].collect()}
    assert q == {"P1": "duplicate_in_batch", "P2": "steel_kind_domain", "P3": "pt_thick_not_positive", "P5": "plate_exists"}
    assert sorted(r["plate_no"] for r in out["plates"].collect()) == ["P1", "P4"]
    assert out["quarantine"].filter("plate_no = 'P1'").count() == 1
    codes = {r["spec_long"]: r["spec_code"] for r in out["specs"].collect()}
    assert codes == {"A": "SPEC001", "D": "SPEC002"}


def test_activation_log(spark):
    reg = spark.createDataFrame([("m", 1), ("m", 2)], "name string, model_id long")
    log = spark.createDataFrame([("m", 1, dt.datetime(2024, 1, 1), "bootstrap")],
                                "name string, model_id long, activated_at timestamp_ntz, reason string")
    log = api.activate(log, reg, 2, dt.datetime(2024, 2, 1))
    log = api.activate(log, reg, 99, dt.datetime(2024, 3, 1))   # unknown id: nothing appended
    assert [r["model_id"] for r in RG.active_versions(log).collect()] == [2]


def test_process_log_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="plog-")
    spark.createDataFrame([("P1", "x")], "plate_no string, hsb string").write.option("header", True).csv(os.path.join(d, "f"))
    with pytest.raises(ValueError) as e:
        PL.read_process_log(spark, os.path.join(d, "f"))
    assert "descaling_count" in str(e.value) and "rolling_date" in str(e.value)


def test_process_log_round_trip_encodings(spark):
    d = tempfile.mkdtemp(prefix="plog-")
    flat = smoke_flat(spark)
    PL.write_process_log(flat, os.path.join(d, "a"), "cp949")
    PL.write_process_log(flat, os.path.join(d, "b"), "UTF-8")
    back = PL.read_process_log(spark, os.path.join(d, "*", "*.csv"))
    assert back.count() == 8
    assert {r["hsb"] for r in back.collect()} == {V.HSB_ON, V.HSB_OFF}
    assert back.schema["rolling_date"].dataType.typeName() == "timestamp_ntz"


def test_normalize_incremental(spark):
    flat = smoke_flat(spark).withColumn("rolling_temp", F.when(F.col("plate_no") == "TEST_CLEAN", 0)
                                        .otherwise(F.col("rolling_temp")))
    existing = spark.createDataFrame([("TEST_HOT",)], "plate_no string")
    specs = spark.createDataFrame([("SPEC001", "ZZ", "영국", "C")],
                                  "spec_code string, spec_long string, spec_country string, steel_kind string")
    out = api.normalize(flat, existing_plates=existing, existing_specs=specs)
    assert sorted(r["plate_no"] for r in out["plate"].collect()) == ["TEST_CLEAN", "TEST_COOLDROP", "TEST_HSB_OFF"]
    assert {r["spec_code"] for r in out["plate"].collect()} == {"SPEC002"}
    rolling = {r["plate_no"]: r for r in out["rolling_process"].collect()}
    assert rolling["TEST_CLEAN"]["rolling_temp"] is None and rolling["TEST_HSB_OFF"]["hsb_applied"] is False
    assert {r["fur_no"] for r in out["furnace_process"].collect()} == {1}
    rep = out["report"].collect()[0]
    assert (rep["rows_read"], rep["rows_skipped"], rep["plates_written"]) == (4, 1, 3)


def test_normalize_quarantines_bad_and_repeated_rows(spark):
    flat = smoke_flat(spark)
    bad = flat.filter("plate_no = 'TEST_HOT'").withColumn("plate_no", F.lit("BAD")).withColumn("rolling_method", F.lit("XYZ"))
    later = flat.filter("plate_no = 'TEST_CLEAN'").withColumn("rolling_date", F.timestamp_add("DAY", F.lit(1), F.col("rolling_date")))
    out = api.normalize(flat.unionByName(bad).unionByName(later).unionByName(flat.filter("plate_no = 'TEST_HSB_OFF'")))
    got = sorted((r["plate_no"], r["load_reason"]) for r in out["quarantine"].collect())
    assert got == [("BAD", "rolling_method_unknown"), ("TEST_CLEAN", "duplicate_in_batch"), ("TEST_HSB_OFF", "duplicate_in_batch")]
    assert out["rolling_process"].count() == out["plate"].count() == 4
    assert out["rolling_process"].filter("rolling_method is null").count() == 0
    rep = out["report"].collect()[0]
    assert (rep["rows_read"], rep["rows_quarantined"], rep["rolling_written"]) == (7, 3, 4)


def test_furnace_and_inspection_checks(spark):
    t = dt.datetime(2024, 1, 1)
    plates = spark.createDataFrame([("P1",), ("P1",)], "plate_no string")
    cols = "plate_no string, fur_no int, fur_input_row int, fur_heat_temp int, fur_heat_time int, fur_soak_temp int, " \
           "fur_soak_time int, fur_total_time int, recorded_at timestamp_ntz"
    rows = [("P1", 1, 1, 1, 1, 1, 1, 1, t), ("P1", None, 1, 1, 1, 1, 1, 1, t), ("P9", 1, 1, 1, 1, 1, 1, 1, t), (None, 1, 1, 1, 1, 1, 1, 1, t)]
    ok, bad = api.ingest_furnace(spark.createDataFrame(rows, cols), plates)
    assert [r["plate_no"] for r in ok.collect()] == ["P1"]
    assert sorted(r["reason"] for r in bad.collect()) == ["field_missing", "plate_missing", "plate_missing"]
    users = spark.createDataFrame([("a@x", 7)], "email string, user_id long")
    labels = [("P1", V.DEFECT_SCALE, "a@x", t), ("P1", "Dent", "a@x", t), ("P1", V.DEFECT_NONE, "b@x", t), ("P9", V.DEFECT_NONE, "a@x", t)]
    ok, bad = api.ingest_inspections(spark.createDataFrame(
        labels, "plate_no string, defect_type string, inspector_email string, inspected_at timestamp_ntz"), plates, users)
    assert [(r["plate_no"], r["inspector_id"]) for r in ok.collect()] == [("P1", 7)]
    assert sorted(r["reason"] for r in bad.collect()) == ["defect_type_domain", "inspector_missing", "plate_missing"]


def _write_lines(path, encoding, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write("\n".join(lines) + "\n")


def test_process_log_mixed_layouts_and_bad_lines(spark, tmp_path):
    cols = list(V.REQUIRED_COLUMNS)
    row = dict(zip(cols, ["P1", "EH36", "미국", "T", "32", "3700", "15100", V.HSB_ON, "1호기", "1열", "1150", "116", "1140",
                          "59", "259", "TMCP(온도제어)", "920", "8", "1조", "14AUG2026:07:20:00"]))

    def line(order, **change):
        return ",".join({**row, **change}[c] for c in order)
    _write_lines(f"{tmp_path}/a.csv", "cp949", [",".join(cols), line(cols), line(cols, plate_no="P2", pt_thick="")])
    back = cols[::-1]
    _write_lines(f"{tmp_path}/b.csv", "utf-8", [
        ",".join([*back, "note"]), line(back, plate_no="P3") + ",x", line(back, plate_no="P4"), "P5,only",
        line(back, plate_no="P6", pt_width="wide") + ",", line(back, plate_no="P7", rolling_date="now") + ",", ""])
    got = {r["plate_no"]: r for r in PL.read_process_log(spark, f"file:{tmp_path}/*.csv").collect()}
    assert sorted(got) == ["P1", "P2", "P3"]
    assert (got["P3"]["pt_thick"], got["P3"]["pt_width"], got["P3"]["note"]) == (32, 3700, "x")
    assert got["P2"]["pt_thick"] is None and got["P1"]["note"] is None and got["P1"]["hsb"] == got["P3"]["hsb"] == V.HSB_ON
    bad = sorted((r["reason"], "b.csv" in r["file"]) for r in PL.rejected_lines(spark, f"file:{tmp_path}/*.csv").collect())
    assert bad == [("malformed", True), ("malformed", True), ("pt_width_unparsable", True), ("rolling_date_unparsable", True)]


def test_process_log_refuses_a_file_without_a_required_column(spark, tmp_path):
    cols = list(V.REQUIRED_COLUMNS)
    _write_lines(f"{tmp_path}/a.csv", "utf-8", [",".join(cols), ",".join("1" for _ in cols)])
    _write_lines(f"{tmp_path}/b.csv", "cp949", [",".join(cols[:-1]), ",".join(V.HSB_ON for _ in cols[:-1])])
    with pytest.raises(ValueError, match="rolling_date"):
        PL.read_process_log(spark, f"file:{tmp_path}/*.csv")
