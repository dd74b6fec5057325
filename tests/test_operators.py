"""Operators on hand-made frames, checked against brute-force Python."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import attribution as AT
from platewise.operators import clean as CL
from platewise.operators import metrics as ME
from platewise.operators import normalize as NZ
from platewise.operators import rank as RK
from platewise.operators import splits as SP


def test_group_median_edges(spark):
    rows = [  # steel, method, temp
        ("C", "CR", None), ("C", "CR", 0),           # group with no positive reading
        ("C", "TMCP", 900),                          # group of one
        ("T", "CR", 800), ("T", "CR", 900), ("T", "CR", -1),   # even-sized after sentinel
        (None, "CR", None),                          # NULL group key
        ("T", "TMCP", 1000), ("T", "TMCP", None),
    ]
    df = spark.createDataFrame(rows, "steel_kind string, rolling_method string, rolling_temp int")
    got = [r["rolling_temp"] for r in CL.impute_group_median(df).collect()]
    # analysis order: fallback = median after the group fill over all rows
    filled = [None, None, 900.0, 800.0, 900.0, 850.0, None, 1000.0, 1000.0]
    vals = sorted(v for v in filled if v is not None)
    mid = len(vals) // 2
    fallback = (vals[mid - 1] + vals[mid]) / 2 if len(vals) % 2 == 0 else vals[mid]
    assert got == [v if v is not None else fallback for v in filled]
    # training order: fallback = median of the raw positive readings
    got2 = [r["rolling_temp"] for r in CL.impute_group_median(df, global_after_group=False).collect()]
    raw = sorted([900, 800, 900, 1000])
    assert got2[0] == (raw[1] + raw[2]) / 2


def test_fill_modes_and_medians(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("b", 3), ("a", 5), (None, 7)], "work_group string, pt_thick int")
    out = CL.fill_medians(CL.fill_modes(df, ["work_group"]), ["pt_thick"]).collect()
    assert [r["work_group"] for r in out] == ["b", "a", "b", "a", "a"]   # tie a/b -> smallest
    assert out[1]["pt_thick"] == 4.0


def test_outlier_counts(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(v, v, v) for v in vals], "fur_heat_temp int, fur_soak_temp int, rolling_temp int")
    r = {x["column"]: x for x in CL.outlier_counts(df).collect()}["rolling_temp"]
    assert r["q1"] == 3.0 and r["q3"] == 7.0 and r["n_outliers"] == 1


def test_global_rank_hot_key_and_ties(spark):
    random.seed(1)
    n = 5000
    rows = [(dt.datetime(2024, 1, 1) if i % 3 == 0 else dt.datetime(2024, 1, 1 + random.randint(0, 20)), f"k{i:05d}")
            for i in range(n)]  # a third of all rows share one instant
    df = spark.createDataFrame(rows, "ts timestamp_ntz, key string")
    got = {r["key"]: r["pos"] for r in RK.global_rank(df, ["ts", "key"], "pos", partitions=7).collect()}
    expect = {k: i for i, (_, k) in enumerate(sorted(rows))}
    assert got == expect


def test_prefix_sums_by_group(spark):
    rows = [(g, s, c) for g in ("x", "y") for s, c in zip(range(50), itertools.cycle([1, 2, 3]))]
    df = spark.createDataFrame(rows, "g string, s int, c long")
    got = {(r["g"], r["s"]): r["before"] for r in RK.prefix_sums(df, ["s"], {"before": "c"}, by=["g"], partitions=4).collect()}
    for g in ("x", "y"):
        acc = 0
        for s, c in zip(range(50), itertools.cycle([1, 2, 3])):
            assert got[(g, s)] == acc
            acc += c


def test_latest_by_tie_break(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", t, 2), ("p", t, 1), ("p", t - dt.timedelta(days=1), 0), ("q", t, 5)],
                               "plate_no string, recorded_at timestamp_ntz, seq int")
    got = {r["plate_no"]: r["seq"] for r in RK.latest_by(df, ["plate_no"], [F.col("recorded_at").desc(), "seq"]).collect()}
    assert got == {"p": 1, "q": 5}


@pytest.mark.parametrize("n", [1, 6, 7, 20, 1000])
def test_time_split_sizes(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"p{i:04d}", t0 + dt.timedelta(minutes=i // 3)) for i in range(n)]  # equal instants
    out = SP.time_split(spark.createDataFrame(rows, "plate_no string, rolling_date timestamp_ntz")).collect()
    n_test = n_valid = int(n * 0.15)
    sizes = {s: sum(1 for r in out if r["split"] == s) for s in ("train", "valid", "test")}
    assert sizes == {"train": n - n_valid - n_test, "valid": n_valid, "test": n_test}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    pos = {r["plate_no"]: r["pos"] for r in out}
    assert [pos[k] for k, _ in order] == list(range(n))


def _sk_folds(labels, k=5):
    """Unshuffled stratified k-fold layout (classes encoded by first appearance)."""
    first = {}
    for y in labels:
        first.setdefault(y, len(first))
    enc = [first[y] for y in labels]
    order = sorted(enc)
    alloc = [[sum(1 for p in range(i, len(order), k) if order[p] == c) for c in range(len(first))] for i in range(k)]
    folds = [0] * len(labels)
    for c in range(len(first)):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, e in enumerate(enc) if e == c]
        for i, f in zip(idx, seq):
            folds[i] = f
    return folds


def test_stratified_folds_match_layout(spark):
    random.seed(3)
    labels = [1 if random.random() < 0.3 else 0 for _ in range(203)]
    df = spark.createDataFrame([(f"p{i:04d}", i, y) for i, y in enumerate(labels)], "plate_no string, pos long, target int")
    got = {r["plate_no"]: r["fold"] for r in SP.stratified_folds(df, "target", "pos", 5).collect()}
    assert [got[f"p{i:04d}"] for i in range(len(labels))] == _sk_folds(labels)


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"p{i}", f"{1 + i % 4}조") for i in range(40)], "plate_no string, work_group string")
    out = SP.group_split(df).collect()
    sides = {}
    for r in out:
        sides.setdefault(r["work_group"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    assert sum(1 for s in sides.values() if s == {"test"}) == 1   # ceil(0.2 * 4)


def _auc_brute(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_roc_auc_against_pairs(spark):
    random.seed(7)
    ys = [random.randint(0, 1) for _ in range(400)]
    ps = [round(random.random(), 2) for _ in ys]   # many ties
    df = spark.createDataFrame(list(zip(ys, ps)), "label int, prob double")
    got = ME.roc_auc(df, digits=None).collect()[0]["auc"]
    assert abs(got - _auc_brute(ys, ps)) < 1e-12


def test_metric_edge_cases(spark):
    one_class = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, prob double")
    assert ME.roc_auc(one_class).collect()[0]["auc"] is None
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "label int, prob double")
    assert ME.roc_auc(tied).collect()[0]["auc"] == 0.5
    no_pred = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, prob double")
    m = ME.threshold_metrics(no_pred).collect()[0]
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0
    assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == 2


def test_linear_attribution_sums_to_logit_gap(spark):
    coefs = {"a": 0.5, "b": -2.0}
    df = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, -1.0), ("z", 0.0, 0.0)], "plate_no string, a double, b double")
    long = AT.linear_attribution(df, df, coefs)
    sums = {r["plate_no"]: r["s"] for r in long.groupBy("plate_no").agg(F.sum("contribution").alias("s")).collect()}
    ma, mb = 4.0 / 3, 1.0 / 3
    for k, a, b in [("x", 1.0, 2.0), ("y", 3.0, -1.0), ("z", 0.0, 0.0)]:
        assert abs(sums[k] - (0.5 * (a - ma) - 2.0 * (b - mb))) < 1e-12


def test_spec_codes_incremental(spark):
    flat = spark.createDataFrame([("B", "X", "T"), ("A", "X", "C"), ("A", "X", "C"), ("C", "Y", "T")],
                                 "spec_long string, spec_country string, steel_kind string")
    existing = spark.createDataFrame([("SPEC001", "Z", "Z", "C")], "spec_code string, spec_long string, spec_country string, steel_kind string")
    got = {(r["spec_long"], r["spec_country"], r["steel_kind"]): r["spec_code"]
           for r in NZ.assign_spec_codes(flat, existing).collect()}
    assert got == {("Z", "Z", "C"): "SPEC001", ("A", "X", "C"): "SPEC002", ("B", "X", "T"): "SPEC003", ("C", "Y", "T"): "SPEC004"}


def test_validation_quarantine(spark):
    rows = [("P1", "T", 10, 1, 1, 3, "TMCP", "1호기", "1열", dt.datetime(2024, 1, 1)),
            ("P2", "X", 0, 1, 1, -1, "XYZ", "호기", None, None)]
    flat = spark.createDataFrame(rows, "plate_no string, steel_kind string, pt_thick int, pt_width int, pt_length int, "
                                       "descaling_count int, rolling_method string, fur_no string, fur_input_row string, "
                                       "rolling_date timestamp_ntz")
    ok, bad = NZ.validate(flat)
    assert [r["plate_no"] for r in ok.collect()] == ["P1"]
    v = bad.collect()[0]["violations"]
    assert set(v) == {"steel_kind_domain", "pt_thick_not_positive", "descaling_negative", "rolling_method_unknown",
                      "fur_no_unparsable", "fur_input_row_unparsable", "rolling_date_missing"}


def test_duplicate_and_missing_parent(spark):
    t = dt.datetime(2024, 1, 1)
    child = spark.createDataFrame([("p", t), ("p", t), ("q", t)], "plate_no string, recorded_at timestamp_ntz")
    parent = spark.createDataFrame([("p",)], "plate_no string")
    assert NZ.duplicate_keys(child, ["plate_no", "recorded_at"]).collect()[0]["n"] == 2
    assert [r["plate_no"] for r in NZ.missing_parent(child, parent, ["plate_no"]).collect()] == ["q"]


@pytest.mark.parametrize("forest", [False, True])
def test_tree_attribution_against_all_coalitions(spark, tmp_path, forest):
    import math

    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from platewise.operators import tree_attribution as TA

    rnd, cols = random.Random(5), ["a", "b", "c", "d"]
    rows = [(f"p{i}", *[float(rnd.randrange(8)) for _ in cols]) for i in range(120)]
    df = spark.createDataFrame(rows, "plate_no string, a double, b double, c double, d double").withColumn(
        "label", ((F.col("a") * F.col("b") > 9) | (F.col("c") - F.col("d") > 3)).cast("double"))
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    est = RandomForestClassifier(numTrees=3, maxDepth=4, seed=3) if forest else DecisionTreeClassifier(maxDepth=5)
    model = est.fit(vec)
    model.write().save(f"file:{tmp_path}/m")
    leaves = TA.tree_leaves(spark, f"file:{tmp_path}/m")
    asked, bg = rows[:6], [r[1:] for r in rows[100:105]]
    got = {(r["plate_no"], r["feature_index"]): r["contribution"] for r in TA.tree_attribution(
        df.filter(F.col("plate_no").isin([r[0] for r in asked])),
        spark.createDataFrame(bg, "a double, b double, c double, d double"), cols, leaves).collect()}
    masks = list(itertools.product([0, 1], repeat=4))
    mixed = [(r[0], j, m, [r[1 + i] if m[i] else b[i] for i in range(4)]) for r in asked for j, b in enumerate(bg) for m in masks]
    scored = model.transform(spark.createDataFrame([(i, x[3]) for i, x in enumerate(mixed)], "i long, x array<double>").select(
        "i", array_to_vector("x").alias("features"))).select("i", vector_to_array("probability")[1].alias("p"))
    p = {r["i"]: r["p"] for r in scored.collect()}
    value = {}
    for i, (key, _, m, _) in enumerate(mixed):
        value[key, m] = value.get((key, m), 0.0) + p[i] / len(bg)
    for key, *_ in asked:
        for i in range(4):
            want = sum(math.factorial(sum(m)) * math.factorial(3 - sum(m)) / 24
                       * (value[key, m[:i] + (1,) + m[i + 1:]] - value[key, m]) for m in masks if not m[i])
            assert abs(got[key, i] - want) < 1e-9
    assert len(got) == 24


def test_tree_attribution_of_a_single_leaf_and_empty_tables(spark):
    from platewise.operators import tree_attribution as TA

    one = spark.createDataFrame([("p", 1.0, None)], "plate_no string, a double, b double")
    leaf = [(0.5, [], [], [])]
    got = TA.tree_attribution(one, one, ["a", "b"], leaf).collect()
    assert [(r["value"], r["contribution"]) for r in got] == [(1.0, 0.0), (None, 0.0)]
    assert TA.tree_attribution(one.limit(0), one, ["a", "b"], leaf).count() == 0
    with pytest.raises(ValueError):
        TA.tree_attribution(one, one.limit(0), ["a", "b"], leaf)


def test_rank_orders_nulls_first_and_nan_last(spark):
    rows = [("b", None), ("a", 2.0), (None, 1.0), ("a", float("nan")), ("a", None), ("c", -1.0)]
    df = spark.createDataFrame(rows, "s string, x double")
    got = {(r["s"], str(r["x"])): r["pos"] for r in RK.global_rank(df, ["s", "x"], "pos").collect()}
    assert got == {(None, "1.0"): 0, ("a", "None"): 1, ("a", "2.0"): 2, ("a", "nan"): 3, ("b", "None"): 4, ("c", "-1.0"): 5}


def test_settled_side_is_planned_by_its_bytes(spark):
    from platewise.operators.lookup import settled

    facts = spark.range(1000).withColumn("k", F.col("id") % 7)
    side = settled(facts.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert side.count() == 7
    empty = settled(facts.filter("id < 0"))
    assert empty.count() == 0 and empty.columns == ["id", "k"]
    plan = facts.join(side, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
