"""Column functions: tokens, feature edges, rules, report formatting."""

import datetime as dt

from pyspark.sql import functions as F

from platewise.functions import features as FE
from platewise.functions import tokens as TK
from platewise.functions import vocab as V
from platewise.operators import registry as RG
from platewise.operators import report as RP
from platewise.operators import rules as RU
from platewise.operators import score as SC


def col_values(spark, values, typ, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_leading_int(spark):
    got = col_values(spark, ["1호기", "12열", "호기", None, "3"], "string", TK.leading_int)
    assert got == [1, 12, None, None, 3]


def test_methods(spark):
    vals = ["TMCP(온도제어)", "CR(제어압연)", "XYZ", None]
    assert col_values(spark, vals, "string", TK.method_strict) == ["TMCP", "CR", None, None]
    assert col_values(spark, vals, "string", TK.method_lenient) == ["TMCP", "CR", "CR", "CR"]


def test_hsb_and_targets(spark):
    assert col_values(spark, [V.HSB_ON, V.HSB_OFF, None], "string", TK.hsb_applied) == [True, False, False]
    assert col_values(spark, [V.SCALE_DEFECT, V.SCALE_GOOD, None], "string", TK.target_from_scale) == [1, 0, 0]
    assert col_values(spark, ["Scale", "Scratch", "없음"], "string", TK.target_from_defect) == [1, 0, 0]


def test_parse_rolling_date(spark):
    got = col_values(spark, ["03JAN2008:07:07:53", "03jan2008:07:07:53", "bad"], "string", TK.parse_rolling_date)
    assert got[0] == dt.datetime(2008, 1, 3, 7, 7, 53) and got[1] == got[0] and got[2] is None


def test_thickness_edges_both_closures(spark):
    vals = [19, 20, 21, 39, 40, 41, 59, 60, 61]
    left = col_values(spark, vals, "int", lambda c: FE.thick_bucket(c, "left"))
    right = col_values(spark, vals, "int", lambda c: FE.thick_bucket(c, "right"))
    t0, t1, t2, t3 = V.THICK_LABELS
    assert left == [t0, t1, t1, t1, t2, t2, t2, t3, t3]
    assert right == [t0, t0, t1, t1, t1, t2, t2, t2, t3]
    assert col_values(spark, [0, -5], "int", lambda c: FE.thick_bucket(c, "right")) == [None, None]


def test_temperature_edges(spark):
    vals = [None, -1, 0, 1, 800, 999, 1000, 1001]
    bins = col_values(spark, vals, "int", FE.temp_bin)
    assert bins == [None, None, None, "<800", "<800", "950-1000", "950-1000", ">=1000"]
    over = col_values(spark, vals, "int", FE.over_1000)
    assert over[6] == 1 and over[5] == 0 and over[7] == 1


def test_cooling_rate_zero_time(spark):
    df = spark.createDataFrame([(200.0, 0), (200.0, None), (200.0, 200)], "d double, t int")
    got = [r[0] for r in df.select(FE.cooling_rate(F.col("d"), F.col("t"))).collect()]
    assert got == [0.0, 0.0, 1.0]


SMOKE = [  # hsb, temp, soak -> expected codes (soak 1140 in every case)
    (False, 920, ["HSB_NOT_APPLIED"]),
    (True, 1050, ["ROLLING_TEMP_OVER_1000", "TEMP_DROP_INSUFFICIENT"]),
    (True, 980, ["TEMP_DROP_INSUFFICIENT"]),
    (True, 900, []),
]


def test_rule_smoke_cases(spark):
    df = spark.createDataFrame([(h, t, 1140) for h, t, _ in SMOKE], "hsb_applied boolean, rolling_temp int, fur_soak_temp int")
    got = RU.rule_hits(df).select(F.transform("fired_rules", lambda r: r["rule_code"]).alias("c")).collect()
    assert [r["c"] for r in got] == [e for _, _, e in SMOKE]


def test_rule_messages_and_null_temp(spark):
    df = spark.createDataFrame([(True, 1050, 1140), (False, None, 1140)], "hsb_applied boolean, rolling_temp int, fur_soak_temp int")
    rows = RU.rule_hits(df).collect()
    msgs = [r["message"] for r in rows[0]["fired_rules"]]
    assert msgs[0].startswith("사상압연온도 1050℃") and msgs[1].startswith("온도낙차 90℃")
    assert [r["rule_code"] for r in rows[1]["fired_rules"]] == ["HSB_NOT_APPLIED"]


def test_drop_edges(spark):
    df = spark.createDataFrame([(True, 1140 - d, 1140) for d in (189, 190, 191)],
                               "hsb_applied boolean, rolling_temp int, fur_soak_temp int")
    got = [r[0] for r in RU.rule_hits(df).select(RU.rule_codes()).collect()]
    assert got == ["TEMP_DROP_INSUFFICIENT", "", ""]


def test_risk_tier_and_labels(spark):
    assert col_values(spark, [0.93, 0.5, 0.04, None], "double", SC.risk_tier) == [V.RISK_HIGH, V.RISK_MID, V.RISK_LOW, V.RISK_NONE]
    assert col_values(spark, ["CRITICAL", "UNKNOWN"], "string", RP.severity_label) == ["긴급", "UNKNOWN"]
    assert col_values(spark, ["HSB_NOT_APPLIED", "UNKNOWN_CODE"], "string", RP.rule_label) == ["HSB 미적용", "UNKNOWN_CODE"]
    assert col_values(spark, [True, False, None], "boolean", RP.match_label) == ["일치", "불일치", "—"]
    assert col_values(spark, [0.5, None], "double", RP.format_percent) == ["50.0%", "—"]
    assert col_values(spark, [0.93099], "double", RP.format_prob) == ["0.931"]


def test_metrics_document_shapes_and_params(spark):
    docs = [
        ('{"valid":{"precision":0.98,"auc":1.0,"best_params":{"max_depth":"8","n_estimators":"100"}},"test":{"auc":0.99}}', "RandomForest"),
        ('{"valid_comparison":{"RandomForest":{"precision":0.97,"auc":1.0}},"selected":"RandomForest","test":{"auc":1.0}}', "RandomForest"),
        ("{}", "X"),
    ]
    df = spark.createDataFrame(docs, "metrics string, algorithm string")
    valid, test = RG.extract_metrics(F.col("metrics"), F.col("algorithm"))
    rows = df.select(valid.alias("v"), test.alias("t"), RG.params_text(valid["best_params"]).alias("p")).collect()
    assert rows[0]["v"]["auc"] == 1.0 and rows[0]["t"]["auc"] == 0.99
    assert rows[0]["p"] == "max_depth=8, n_estimators=100"
    assert rows[1]["v"]["precision"] == 0.97
    assert rows[2]["v"] is None and rows[2]["p"] == V.NO_PARAMS_NOTE


def test_model_ranking_tie_breaks(spark):
    rows = [  # name, auc, f1, precision, recall, cv
        ("A", 1.0, 0.99, 0.98, 1.0, 0.995), ("B", 1.0, 0.99, 0.98, 1.0, 0.99), ("C", 0.9, 0.8, 0.7, 0.9, 0.5),
        ("L", 1.0, 0.99, 0.98, 1.0, None),
        ("T2", 1.0, 0.9928, 0.9857, 1.0, 0.995), ("L2", 1.0, 0.9929, 0.9859, 1.0, None),
    ]
    df = spark.createDataFrame([(i, "m" if n in "ABCL" else "n", n, a, f, p, r, c) for i, (n, a, f, p, r, c) in enumerate(rows)],
                               "model_id int, name string, algorithm string, auc double, f1 double, precision double, recall double, cv double")
    valid = F.struct(F.col("auc"), F.col("f1"), F.col("precision"), F.col("recall"), F.col("cv").alias("cv_best_auc"))
    ranked = {r["algorithm"]: r["rank"] for r in RG.rank_models(df, valid).collect()}
    assert ranked["A"] == 1 and ranked["C"] == 4 and ranked["B"] < ranked["C"] and ranked["A"] < ranked["L"]
    assert ranked["T2"] == 1 and ranked["L2"] == 2


def test_shap_bar_width(spark):
    from platewise.operators import attribution as AT
    df = spark.createDataFrame([("p", 0, "a", 1.0, 0.15), ("p", 1, "b", 1.0, -0.3), ("q", 0, "a", 1.0, 0.0)],
                               "plate_no string, feature_index int, feature string, value double, contribution double")
    got = {(r["plate_no"], r["feature"]): (r["rank"], r["bar_width"]) for r in AT.top_attributions(df).collect()}
    assert got[("p", "b")] == (1, 100) and got[("p", "a")] == (2, 50) and got[("q", "a")] == (1, 0)


def test_top_from_arrays_matches_window(spark):
    from platewise.operators import attribution as AT
    rows = [("p", [(0, "a", 1.0, 0.15), (1, "b", 1.0, -0.3), (2, "c", 1.0, 0.3), (3, "d", 1.0, 0.0)]),
            ("q", [(0, "a", 1.0, 0.0), (1, "b", 1.0, 0.0)])]
    schema = "plate_no string, attributions array<struct<feature_index:int,feature:string,value:double,contribution:double>>"
    arrays = spark.createDataFrame(rows, schema)
    long = arrays.select("plate_no", F.explode("attributions").alias("a")).select("plate_no", "a.*")
    cols = ["plate_no", "feature_index", "rank", "bar_width", "contribution"]
    wide = sorted(tuple(r) for r in AT.top_from_arrays(arrays, "plate_no", 3).select(*cols).collect())
    win = sorted(tuple(r) for r in AT.top_attributions(long, "plate_no", 3).select(*cols).collect())
    assert wide == win
    assert ("p", 1, 1, 100, -0.3) in wide and ("p", 2, 2, 100, 0.3) in wide and ("q", 0, 1, 0, 0.0) in wide
