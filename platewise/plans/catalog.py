"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query reads whole tables through the plate-process views of
:mod:`platewise.sources.driver`, so its work grows with the data.  The matching SQL
oracles live in :mod:`platewise.plans.oracle` under the same names, with the same
output column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import features as FE
from platewise.functions import tokens as TK
from platewise.functions import vocab as V
from platewise.operators import clean as CL
from platewise.operators import rules as RU
from platewise.sources import driver

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def prepare_session(spark: SparkSession) -> None:
    """Idempotent runtime settings every query relies on, for sessions created elsewhere
    (the legacy charset list for cp949 files; the shared checkpoint folder)."""
    from platewise.session import ensure_checkpoint_dir
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    ensure_checkpoint_dir(spark)


def round_cols(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Report precision for values whose last bits depend on summation order (means of
    doubles, interpolated quantiles); the operators themselves stay unrounded."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def query(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ----------------------------------------------------------------------------- shared views

def serving_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log normalised for scoring: hsb flag, lenient method, integer furnace
    tokens (P3 applied on every path), raw temperature kept."""
    c = driver.coil(spark, sf_dir)
    return c.select(
        "plate_no", "pt_thick", "pt_width", "pt_length", "spec_long", "spec_country", "steel_kind",
        TK.leading_int("fur_no").alias("fur_no"), TK.leading_int("fur_input_row").alias("fur_input_row"),
        "fur_heat_temp", "fur_heat_time", "fur_soak_temp", "fur_soak_time", "fur_total_time",
        TK.hsb_applied("hsb").alias("hsb_applied"), TK.method_lenient("rolling_method").alias("rolling_method"),
        "rolling_temp", "descaling_count", "work_group", "rolling_date",
        TK.target_from_scale("scale").alias("target"),
    )


def serving_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving-path features with the temperature imputed in training order."""
    base = CL.impute_group_median(serving_input(spark, sf_dir), global_after_group=False)
    return FE.serving_features(base, keep=["plate_no", "target"])


def analysis_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M22 + M23: cleaned flat log with analysis features."""
    return FE.analysis_features(CL.clean(driver.coil(spark, sf_dir)))


def ingest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the raw reading (sentinel -> NULL), ingest semantics."""
    c = driver.coil(spark, sf_dir)
    raw = c.select("plate_no", "rolling_date", "fur_soak_temp", "work_group", "scale",
                   F.when(F.col("rolling_temp") > 0, F.col("rolling_temp")).alias("rolling_temp"),
                   TK.hsb_applied("hsb").alias("hsb_applied"))
    return RU.rule_hits(raw)


# ----------------------------------------------------------------------------- step 1: cleaning

@query("coil_flat")
def coil_flat(spark, sf_dir):
    return driver.coil(spark, sf_dir)


@query("null_profile")
def null_profile(spark, sf_dir):
    return CL.null_counts(CL.sentinel_to_null(driver.raw_coil(spark, sf_dir)))


@query("impute_rolling_temp")
def impute_rolling_temp(spark, sf_dir):
    c = driver.coil(spark, sf_dir).select(
        "plate_no", "steel_kind", "rolling_method", F.col("rolling_temp").alias("rolling_temp_raw"), "rolling_temp")
    c = CL.sentinel_to_null(CL.flag_missing_temp(c))
    return CL.impute_group_median(c).select(
        "plate_no", "steel_kind", "rolling_method", "rolling_temp_raw", "rolling_temp_was_missing", "rolling_temp")


@query("median_fill")
def median_fill(spark, sf_dir):
    c = CL.sentinel_to_null(driver.raw_coil(spark, sf_dir))
    cols = V.MEDIAN_FILL_COLUMNS
    wide = c.agg(*[F.struct(F.median(x).alias("fill_value"), F.count_if(F.col(x).isNull()).alias("n_filled")).alias(x)
                   for x in cols])
    return wide.unpivot([], cols, "column", "s").select("column", "s.fill_value", "s.n_filled")


@query("mode_fill")
def mode_fill(spark, sf_dir):
    c = driver.raw_coil(spark, sf_dir)
    cols = V.MODE_FILL_COLUMNS
    wide = c.agg(*[F.struct(F.mode(x, deterministic=True).alias("fill_value"),
                            F.count_if(F.col(x).isNull()).alias("n_filled")).alias(x) for x in cols])
    return wide.unpivot([], cols, "column", "s").select("column", "s.fill_value", "s.n_filled")


@query("iqr_outliers")
def iqr_outliers(spark, sf_dir):
    return round_cols(CL.outlier_counts(CL.clean(driver.raw_coil(spark, sf_dir))), ["q1", "q3", "lower", "upper"])


@query("cleaned_table")
def cleaned_table(spark, sf_dir):
    return CL.clean(driver.coil(spark, sf_dir))


@query("cleaned_raw")
def cleaned_raw(spark, sf_dir):
    """M22 on the log with faults: every fill value is used."""
    return CL.clean(driver.raw_coil(spark, sf_dir))


# ----------------------------------------------------------------------------- step 2: features

@query("features_serving")
def features_serving(spark, sf_dir):
    return serving_features(spark, sf_dir)


ANALYSIS_COLUMNS = (["plate_no"] + V.NUMERIC_FEATURES + V.ANALYSIS_BINARY_FEATURES + V.CATEGORICAL_FEATURES
                    + ["rolling_temp_bin", "target"])


@query("features_analysis")
def features_analysis(spark, sf_dir):
    return round_cols(analysis_frame(spark, sf_dir).select(*ANALYSIS_COLUMNS), ["cooling_rate_proxy"])


@query("temp_bins")
def temp_bins(spark, sf_dir):
    a = analysis_frame(spark, sf_dir)
    return a.groupBy("rolling_temp_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("n_defect"),
        (F.sum("target") / F.count(F.lit(1))).alias("defect_rate"))


@query("thick_buckets")
def thick_buckets(spark, sf_dir):
    c = driver.coil(spark, sf_dir)
    both = c.select(F.explode(F.array(
        F.struct(F.lit("left").alias("closed"), FE.thick_bucket("pt_thick", "left").alias("thick_bucket")),
        F.struct(F.lit("right").alias("closed"), FE.thick_bucket("pt_thick", "right").alias("thick_bucket")),
    )).alias("b")).select("b.*")
    return both.groupBy("closed", "thick_bucket").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- step 3: rules

@query("rule_hits")
def rule_hits(spark, sf_dir):
    r = ingest_rules(spark, sf_dir)
    return r.select("plate_no", RU.rule_codes().alias("rule_codes"),
                    F.size("fired_rules").alias("n_rules"))


@query("rule_hits_imputed")
def rule_hits_imputed(spark, sf_dir):
    base = CL.impute_group_median(serving_input(spark, sf_dir), global_after_group=False)
    r = RU.rule_hits(base)
    return r.select("plate_no", "rolling_temp", RU.rule_codes().alias("rule_codes"),
                    F.size("fired_rules").alias("n_rules"))


@query("alerts_exploded")
def alerts_exploded(spark, sf_dir):
    return RU.alerts(ingest_rules(spark, sf_dir))


@query("rule_evidence")
def rule_evidence(spark, sf_dir):
    c = driver.coil(spark, sf_dir)
    t = F.col("rolling_temp")
    g = c.select(TK.hsb_applied("hsb").alias("hsb_applied"),
                 F.coalesce((t > 0) & (t >= V.ROLLING_TEMP_CRITICAL), F.lit(False)).alias("over_1000"),
                 TK.target_from_scale("scale").alias("target"))
    return g.groupBy("hsb_applied", "over_1000").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("n_defect"),
        (F.sum("target") / F.count(F.lit(1))).alias("defect_rate"))


def plant_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users dimension: one field engineer per work group seen in the data."""
    groups = driver.coil(spark, sf_dir).select("work_group").distinct()
    uid = TK.leading_int("work_group").cast("bigint")
    return groups.select(uid.alias("user_id"),
                         F.concat(F.lit("engineer"), uid.cast("string"), F.lit("@plant.local")).alias("email"),
                         F.lit("FIELD_ENGINEER").alias("role"), "work_group")


def resolution_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution log: an inspection that finds no defect asks the plate's work-group
    engineer to resolve every alert of that plate at the inspection instant."""
    c = driver.coil(spark, sf_dir)
    insp = driver.inspection_history(c, extra=["work_group"]).filter(F.col("defect_type") == V.DEFECT_NONE)
    a = RU.alerts(ingest_rules(spark, sf_dir)).select("plate_no", "rule_pos")
    email = F.concat(F.lit("engineer"), TK.leading_int("work_group").cast("string"), F.lit("@plant.local"))
    return (insp.join(a, "plate_no")
            .select("plate_no", "rule_pos", email.alias("resolver_email"), F.col("inspected_at").alias("requested_at")))


def current_alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.alert_state(RU.alerts(ingest_rules(spark, sf_dir)), resolution_requests(spark, sf_dir),
                          plant_users(spark, sf_dir))


@query("alert_state")
def alert_state(spark, sf_dir):
    return current_alert_state(spark, sf_dir).select(
        "plate_no", "rule_pos", "rule_code", "severity", "triggered_at", "resolved_at", "resolved_by")


@query("open_alerts")
def open_alerts(spark, sf_dir):
    return RU.alerts_view(current_alert_state(spark, sf_dir), "open").select(
        "plate_no", "rule_pos", "rule_code", "severity", "message", "triggered_at")


@query("plate_alerts")
def plate_alerts(spark, sf_dir):
    """All alerts, resolved or not, of one plate (the last by number that has one)."""
    state = current_alert_state(spark, sf_dir)
    plate = state.agg(F.max("plate_no")).first()[0]
    return RU.alerts_view(state, "all", plate).select(
        "plate_no", "rule_pos", "rule_code", "severity", "message", "triggered_at", "resolved_at")


@query("alert_labels")
def alert_labels(spark, sf_dir):
    """alerts with their display labels and minute."""
    from platewise.operators import report as RP

    return RU.alerts(ingest_rules(spark, sf_dir)).select(
        "plate_no", "rule_pos", RP.severity_label(F.col("severity")).alias("severity_label"),
        RP.rule_label(F.col("rule_code")).alias("rule_label"), RP.format_minute(F.col("triggered_at")).alias("minute"))


# ----------------------------------------------------------------------------- step 4: normalise

from platewise.operators import latest as LT  # noqa: E402
from platewise.operators import normalize as NZ  # noqa: E402
from platewise.operators import profile as PR  # noqa: E402
from platewise.operators.rank import latest_by  # noqa: E402


def earlier_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates with furnace records before 1995."""
    return driver.furnace_history(spark, sf_dir).filter(
        F.col("recorded_at") < F.lit("1995-01-01").cast("timestamp_ntz")).select("plate_no")


def raw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NZ.load_outcomes(driver.raw_coil(spark, sf_dir), earlier_plates(spark, sf_dir))


def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec codes after an incremental load: first the earlier plates (those that already
    have furnace history), then all."""
    known = driver.furnace_history(spark, sf_dir).select("plate_no", F.lit(True).alias("__known")).distinct()
    return NZ.spec_codes_of_loads(driver.coil(spark, sf_dir).join(known, "plate_no", "left"), F.col("__known"))


@query("product_specs")
def product_specs(spark, sf_dir):
    return spec_table(spark, sf_dir)


@query("plates")
def plates_q(spark, sf_dir):
    return NZ.plates(driver.coil(spark, sf_dir), spec_table(spark, sf_dir))


@query("furnace_records")
def furnace_records_q(spark, sf_dir):
    return NZ.furnace_records(driver.coil(spark, sf_dir))


def _nullable_temp_as_double(df: DataFrame) -> DataFrame:
    """Query outputs carry the NULL-able integer reading as DOUBLE (NaN-safe in pandas)."""
    return df.withColumn("rolling_temp", F.col("rolling_temp").cast("double"))


@query("rolling_records")
def rolling_records_q(spark, sf_dir):
    return _nullable_temp_as_double(NZ.rolling_records(driver.coil(spark, sf_dir)))


@query("inspections")
def inspections_q(spark, sf_dir):
    return NZ.inspections(driver.coil(spark, sf_dir))


@query("incremental_load")
def incremental_load(spark, sf_dir):
    return NZ.load_report(raw_outcomes(spark, sf_dir))


@query("load_outcomes")
def load_outcomes_q(spark, sf_dir):
    """What becomes of every row of the log with faults."""
    return raw_outcomes(spark, sf_dir).select(
        "plate_no", "rolling_date", "load_status", F.coalesce("load_reason", F.lit("")).alias("load_reason"))


@query("loaded_rolling")
def loaded_rolling(spark, sf_dir):
    """P11 on the rows that validation lets through."""
    return _nullable_temp_as_double(NZ.rolling_records(NZ.written(raw_outcomes(spark, sf_dir))))


@query("spec_codes_after_load")
def spec_codes_after_load(spark, sf_dir):
    """Combinations that come up later are numbered after the earlier ones."""
    raw = driver.raw_coil(spark, sf_dir)
    first = NZ.assign_spec_codes(raw.filter(F.col("rolling_date") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return NZ.assign_spec_codes(raw, existing=first)


@query("ingested_plates")
def ingested_plates(spark, sf_dir):
    """The log with faults posted as plate records; outcome of each."""
    from platewise import api

    out = api.ingest_plates(driver.raw_coil(spark, sf_dir), None, earlier_plates(spark, sf_dir), "rolling_date")
    return out["plates"].select("plate_no", F.lit("accepted").alias("outcome")).unionByName(
        out["quarantine"].withColumnRenamed("reason", "outcome"))


@query("fk_violations")
def fk_violations(spark, sf_dir):
    rolling = NZ.rolling_records(driver.coil(spark, sf_dir))
    return NZ.missing_parent(rolling, driver.furnace_history(spark, sf_dir), ["plate_no"]).select(
        "plate_no", "rolling_date", F.lit("furnace_record_missing").alias("violation"))


@query("domain_violations")
def domain_violations(spark, sf_dir):
    return NZ.violation_summary(driver.raw_coil(spark, sf_dir))


@query("duplicate_keys")
def duplicate_keys(spark, sf_dir):
    return NZ.duplicate_keys(driver.furnace_history(spark, sf_dir), ["plate_no", "recorded_at"])


# ----------------------------------------------------------------------------- step 5: latest records

def normalized_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = driver.coil(spark, sf_dir)
    specs = spec_table(spark, sf_dir)
    return {"plate": NZ.plates(c, specs), "spec": specs, "furnace": driver.furnace_history(spark, sf_dir),
            "rolling": NZ.rolling_records(c), "inspection": driver.inspection_history(c)}


@query("latest_furnace")
def latest_furnace(spark, sf_dir):
    return LT.latest_furnace(driver.furnace_history(spark, sf_dir)).select(
        "plate_no", "recorded_at", *LT.FURNACE_COLS)


@query("latest_event_per_user")
def latest_event_per_user(spark, sf_dir):
    return latest_by(driver.events(spark, sf_dir), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@query("training_frame")
def training_frame_q(spark, sf_dir):
    t = normalized_tables(spark, sf_dir)
    tf = LT.training_frame(t["plate"], t["spec"], t["furnace"], t["rolling"], t["inspection"])
    return _nullable_temp_as_double(tf.withColumn("target", TK.target_from_defect("defect_type")))


@query("serving_frame")
def serving_frame_q(spark, sf_dir):
    t = normalized_tables(spark, sf_dir)
    return _nullable_temp_as_double(LT.serving_frame(t["plate"], t["spec"], t["furnace"], t["rolling"]))


# ----------------------------------------------------------------------------- step 6: profiles

def _defect() -> F.Column:
    return F.col("scale") == V.SCALE_DEFECT


@query("label_distribution")
def label_distribution(spark, sf_dir):
    return PR.value_distribution(driver.coil(spark, sf_dir), "scale")


@query("defect_rate_by_hsb")
def defect_rate_by_hsb(spark, sf_dir):
    return PR.rate_by(driver.coil(spark, sf_dir), ["hsb"], _defect())


@query("mean_drop_by_label")
def mean_drop_by_label(spark, sf_dir):
    cl = CL.clean(driver.coil(spark, sf_dir))
    return round_cols(PR.mean_by(cl, ["scale"], F.col("fur_soak_temp") - F.col("rolling_temp"), "mean_temp_drop"),
                      ["mean_temp_drop"])


@query("temp_histogram")
def temp_histogram(spark, sf_dir):
    return PR.labelled_histogram(CL.clean(driver.coil(spark, sf_dir)), "rolling_temp", "scale", 40)


@query("drop_boxplot")
def drop_boxplot(spark, sf_dir):
    cl = CL.clean(driver.coil(spark, sf_dir))
    return round_cols(PR.box_stats(cl, F.col("fur_soak_temp") - F.col("rolling_temp"), ["scale"]),
                      ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@query("descaling_parity")
def descaling_parity(spark, sf_dir):
    r = PR.rate_by(driver.coil(spark, sf_dir), ["descaling_count"], _defect())
    return r.withColumn("is_odd", F.pmod("descaling_count", F.lit(2)) == 1)


# ----------------------------------------------------------------------------- step 7: splits

from functools import cached_property  # noqa: E402

from platewise.operators import attribution as AT  # noqa: E402
from platewise.operators import metrics as ME  # noqa: E402
from platewise.operators import registry as RG  # noqa: E402
from platewise.operators import score as SC  # noqa: E402
from platewise.operators import splits as SP  # noqa: E402
from platewise.operators.lookup import settled, with_scalars  # noqa: E402


def coil_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = driver.coil(spark, sf_dir)
    return c.select("plate_no", "rolling_date", "work_group", TK.target_from_scale("scale").alias("target"))


class Build:
    """Frames shared by the parts of ONE query (built once per query, never across
    queries): the time split, its training part, the serving features, the registry."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def split(self) -> DataFrame:
        return SP.time_split(coil_with_target(self.spark, self.sf_dir))

    @cached_property
    def train(self) -> DataFrame:
        return self.split.filter(F.col("split") == "train")

    @cached_property
    def folds(self) -> DataFrame:
        return SP.stratified_folds(self.train, "target", "pos", 5)

    @cached_property
    def features(self) -> DataFrame:
        return serving_features(self.spark, self.sf_dir)

    @cached_property
    def run(self) -> DataFrame:
        """Training run facts: instant (last training row) and training row count."""
        return self.train.agg(F.max("rolling_date").alias("trained_at"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def attribution_arrays(self) -> DataFrame:
        bg_keys = SP.background_sample(self.train.select("plate_no"), "plate_no", 100, 42).select("plate_no")
        background = self.features.join(bg_keys, "plate_no", "left_semi")
        return AT.linear_attribution_arrays(self.features, background, SC.RULEBOOK_COEFS, "plate_no")

    @cached_property
    def attributions(self) -> DataFrame:
        return self.attribution_arrays.select("plate_no", F.explode("attributions").alias("a")).select("plate_no", "a.*")

    @cached_property
    def top_attributions(self) -> DataFrame:
        return AT.top_from_arrays(self.attribution_arrays, "plate_no", V.TOP_N_ATTRIBUTIONS)

    @cached_property
    def registry(self) -> DataFrame:
        return registry_table(self)

    @cached_property
    def registry_metrics(self) -> DataFrame:
        valid, test = RG.extract_metrics(F.col("metrics"), F.col("algorithm"))
        return self.registry.withColumns({"valid": valid, "test": test})


@query("time_split")
def time_split_q(spark, sf_dir):
    return Build(spark, sf_dir).split.select("plate_no", "rolling_date", "pos", "split")


@query("split_profile")
def split_profile_q(spark, sf_dir):
    return SP.split_profile(Build(spark, sf_dir).split)


@query("group_split")
def group_split_q(spark, sf_dir):
    return SP.group_split(coil_with_target(spark, sf_dir)).select("plate_no", "work_group", "split")


@query("stratified_folds")
def stratified_folds_q(spark, sf_dir):
    return Build(spark, sf_dir).folds.select("plate_no", "target", "fold")


@query("background_sample")
def background_sample_q(spark, sf_dir):
    return SP.background_sample(Build(spark, sf_dir).train, "plate_no", 100, 42).select("plate_no", "sample_rank")


# ----------------------------------------------------------------------------- step 8: metrics

def rulebook_scored(b: Build) -> DataFrame:
    """Serving features scored by the fixed linear-logistic rulebook scorer, with the
    time split attached."""
    scored = SC.present(SC.score_linear(b.features), "prob", "target")
    return scored.join(b.split.select("plate_no", "split"), "plate_no")


@query("score_fixed_linear")
def score_fixed_linear(spark, sf_dir):
    s = SC.present(SC.score_linear(serving_features(spark, sf_dir)), "prob", "target")
    return s.select("plate_no", "predicted_prob", "predicted_label", "actual_label", "correct")


@query("confusion")
def confusion_q(spark, sf_dir):
    s = SC.present(SC.score_linear(serving_features(spark, sf_dir)), "prob", "target")
    return ME.confusion(s, "actual_label", "predicted_label")


@query("threshold_metrics")
def threshold_metrics_q(spark, sf_dir):
    return ME.threshold_metrics(rulebook_scored(Build(spark, sf_dir)), "target", "prob", 0.5, by=["split"])


@query("roc_auc")
def roc_auc_q(spark, sf_dir):
    return ME.roc_auc(rulebook_scored(Build(spark, sf_dir)), "target", "prob", by=["split"])


@query("class_weights")
def class_weights_q(spark, sf_dir):
    return ME.class_weights(Build(spark, sf_dir).split, "target", by=["split"])


# ----------------------------------------------------------------------------- step 9: scoring

RULEBOOK_LABEL = "rulebook_logistic v1"
SCENARIO_TEMPS = [850, 900, 950, 1000, 1050]


def rulebook_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16 on the flat log: impute -> features -> score -> rules (on the imputed reading)."""
    base = CL.impute_group_median(serving_input(spark, sf_dir), global_after_group=False)
    feats = FE.serving_features(base, keep=["plate_no", "target", F.col("rolling_date").alias("scored_at")])
    scored = SC.present(SC.score_linear(feats), "prob", "target")
    return RU.rule_hits(scored, temp_col="rolling_temp", soak_col="fur_soak_temp", hsb_col="hsb_applied")


@query("risk_ranking")
def risk_ranking(spark, sf_dir):
    r = SC.risk_ranking(rulebook_file(spark, sf_dir), 200)
    return r.select("plate_no", "predicted_prob", "predicted_label", RU.rule_codes().alias("fired_rules"),
                    SC.risk_tier(F.col("predicted_prob")).alias("risk"), "n_total")


@query("risk_top5")
def risk_top5(spark, sf_dir):
    """The five riskiest plates of the file, in order."""
    r = SC.risk_ranking(rulebook_file(spark, sf_dir), 5)
    place = F.row_number().over(Window.orderBy(F.col("predicted_prob").desc(), "plate_no"))
    return r.withColumn("place", place).select("place", "plate_no", "predicted_prob", "n_total")


@query("file_summary")
def file_summary(spark, sf_dir):
    return SC.file_summary(rulebook_file(spark, sf_dir), RULEBOOK_LABEL, True)


@query("what_if_grid")
def what_if_grid(spark, sf_dir):
    inp = serving_input(spark, sf_dir)
    grid = SC.scenario_grid(inp, SCENARIO_TEMPS)
    feats = FE.serving_features(grid, keep=["plate_no", "scenario_temp"])
    scored = SC.present(SC.score_linear(feats), "prob", None)
    r = RU.rule_hits(scored, temp_col="rolling_temp", soak_col="fur_soak_temp", hsb_col="hsb_applied")
    return r.select("plate_no", "scenario_temp", "predicted_prob", "predicted_label", RU.rule_codes().alias("fired_rules"))


@query("what_if_missing")
def what_if_missing(spark, sf_dir):
    """M18 with a NULL reading: every plate asked about without one, answered by the
    medians fitted on the log."""
    from platewise import api

    c = driver.coil(spark, sf_dir)
    asked = c.drop("scale").withColumn("rolling_temp", F.lit(None).cast("int"))
    r = api.score_scenarios(asked, *api.fit_imputer(c))
    return r.select("plate_no", "rolling_temp", "predicted_prob", "predicted_label", RU.rule_codes().alias("fired_rules"))


@query("linear_attribution")
def linear_attribution(spark, sf_dir):
    return round_cols(Build(spark, sf_dir).attributions, ["contribution"])


@query("attribution_top5")
def attribution_top5(spark, sf_dir):
    return round_cols(Build(spark, sf_dir).top_attributions, ["contribution"])


@query("attribution_summary")
def attribution_summary(spark, sf_dir):
    return round_cols(AT.attribution_summary(Build(spark, sf_dir).attributions, 12), ["mean_abs_contribution"])


# ----------------------------------------------------------------------------- step 10: registry and reports

# Candidate linear scorers registered side by side (our own fixed parameters):
# (model_id, algorithm, intercept, coefficients).
CANDIDATES = [
    (1, "Rulebook", SC.RULEBOOK_INTERCEPT, SC.RULEBOOK_COEFS),
    (2, "BreakerOnly", 2.0, {"hsb_applied": -4.0}),
    (3, "TemperatureOnly", 4.0, {"rolling_temp_over_1000": 3.5, "temp_drop": -0.03}),
    (4, "DropAndParity", 4.5, {"temp_drop": -0.03, "descaling_is_odd": 0.8}),
]


def candidate_scores(b: Build) -> DataFrame:
    """Every candidate's probability for every plate in ONE pass (explode, no join per
    candidate), with the time split and, for training rows, the CV fold."""
    base = (b.features.join(b.split.select("plate_no", "split"), "plate_no")
            .join(b.folds.select("plate_no", "fold"), "plate_no", "left"))
    arr = F.array(*[F.struct(F.lit(mid).alias("model_id"), F.lit(alg).alias("algorithm"),
                             (1.0 / (1.0 + F.exp(-SC.logit(coefs, b0)))).alias("prob"))
                    for mid, alg, b0, coefs in CANDIDATES])
    return base.select("plate_no", "target", "split", "fold", F.explode(arr).alias("c")).select(
        "plate_no", "target", "split", "fold", "c.*")


def candidate_metrics(b: Build) -> DataFrame:
    """Per candidate: valid and test metrics at 0.5, AUCs, mean 5-fold CV AUC - all
    from ONE aggregate of the candidate scores to (model, split, fold, prob) counts."""
    keys = ["model_id", "algorithm", "split"]
    counts = ME.score_counts(candidate_scores(b), "target", "prob", by=[*keys, "fold"]).checkpoint(eager=True)
    per_split = counts.groupBy(*keys, "prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # split AUCs and per-fold AUCs share ONE prefix-sum pass: groups are (model, scope, group)
    per_fold = (counts.filter(F.col("split") == "train").groupBy("model_id", "fold", "prob")
                .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    both = per_split.select("model_id", F.lit("split").alias("scope"), F.col("split").alias("grp"), "prob", "pos", "neg") \
        .unionByName(per_fold.select("model_id", F.lit("fold").alias("scope"), F.col("fold").cast("string").alias("grp"),
                                     "prob", "pos", "neg"))
    aucs = ME.roc_auc_from_counts(both, "prob", by=["model_id", "scope", "grp"], digits=None)
    split_auc = aucs.filter(F.col("scope") == "split").select(
        "model_id", F.col("grp").alias("split"), F.round("auc", 4).alias("auc"))
    m = ME.threshold_metrics_from_counts(per_split, "prob", 0.5, by=keys).join(split_auc, ["model_id", "split"])
    cv = (aucs.filter(F.col("scope") == "fold")
          .groupBy("model_id").agg(F.round(F.avg("auc"), 4).alias("cv_best_auc")))

    def block(s: str) -> DataFrame:
        return m.filter(F.col("split") == s).select(
            "model_id", "algorithm", F.struct("precision", "recall", "f1", "auc").alias(s))
    return block("valid").join(block("test").drop("algorithm"), "model_id").join(cv, "model_id")


def registry_table(b: Build) -> DataFrame:
    """One registry row per candidate; the metrics document is written in the new
    shape for even ids and in the old (valid_comparison) shape for odd ids."""
    cm, s = with_scalars(candidate_metrics(b), b.run, "__run")
    n_feat = F.create_map(F.lit("features"), F.lit("0"))
    for mid, _, _, coefs in CANDIDATES:
        n_feat = F.when(F.col("model_id") == mid, F.create_map(F.lit("features"), F.lit(str(len(coefs))))).otherwise(n_feat)
    valid = F.struct(F.col("valid.precision").alias("precision"), F.col("valid.recall").alias("recall"),
                     F.col("valid.f1").alias("f1"), F.col("valid.auc").alias("auc"),
                     F.col("cv_best_auc").alias("cv_best_auc"), n_feat.alias("best_params"))
    new_doc = F.to_json(F.struct(valid.alias("valid"), F.col("test").alias("test")))
    old_doc = F.to_json(F.struct(F.create_map(F.col("algorithm"), valid).alias("valid_comparison"),
                                 F.col("algorithm").alias("selected"), F.col("test").alias("test")))
    return cm.select(
        "model_id", F.lit(V.MODEL_NAME).alias("name"), RG.version_tag(F.col("algorithm"), s["trained_at"]).alias("version"),
        "algorithm", s["trained_at"].alias("trained_at"), s["n"].alias("train_row_count"),
        F.when(F.col("model_id") % 2 == 0, new_doc).otherwise(old_doc).alias("metrics"),
        F.lit(0.5).alias("threshold"))


@query("metrics_json")
def metrics_json(spark, sf_dir):
    r = Build(spark, sf_dir).registry_metrics
    return r.select("model_id", "algorithm",
                    F.when(F.col("model_id") % 2 == 0, "new").otherwise("old").alias("shape"),
                    F.col("valid.auc").alias("valid_auc"), F.col("valid.precision").alias("valid_precision"),
                    F.col("valid.recall").alias("valid_recall"), F.col("valid.f1").alias("valid_f1"),
                    F.col("valid.cv_best_auc").alias("cv_best_auc"), F.col("test.auc").alias("test_auc"),
                    RG.params_text(F.col("valid.best_params")).alias("params"))


@query("model_ranking")
def model_ranking(spark, sf_dir):
    r = RG.rank_models(Build(spark, sf_dir).registry_metrics, F.col("valid"))
    return r.select("rank", "model_id", "algorithm", "version", F.col("valid.auc").alias("auc"),
                    F.col("valid.f1").alias("f1"), F.col("valid.precision").alias("precision"),
                    F.col("valid.recall").alias("recall"), F.col("valid.cv_best_auc").alias("cv_best_auc"),
                    RG.params_text(F.col("valid.best_params")).alias("params"))


def activation_log(reg: DataFrame) -> DataFrame:
    """M13 + M14: bootstrap event for the AUC-only best at registration time, then a
    manual activation of the five-level ranking winner one day later."""
    boot = RG.bootstrap_choice(reg, F.col("valid.auc")).select(
        "name", "model_id", F.col("trained_at").alias("activated_at"), F.lit("bootstrap").alias("reason"))
    manual = RG.rank_models(reg, F.col("valid")).filter(F.col("rank") == 1).select(
        "name", "model_id", F.timestamp_add("DAY", F.lit(1), F.col("trained_at")).alias("activated_at"),
        F.lit("manual").alias("reason"))
    return boot.unionByName(manual)


def active_model_table(b: Build) -> DataFrame:
    reg = b.registry_metrics
    act = RG.active_versions(activation_log(reg))
    return act.join(reg.select("model_id", "version", "algorithm"), "model_id").select(
        "name", "model_id", "algorithm", "version", "activated_at", "reason",
        SC.model_label(F.col("name"), F.col("version")).alias("model_label"))


@query("active_model")
def active_model(spark, sf_dir):
    return active_model_table(Build(spark, sf_dir))


@query("dashboard_summary")
def dashboard_summary(spark, sf_dir):
    """A20 as of the last production day in the data (an explicit instant, not now())."""
    from platewise.operators import report as RP
    c = driver.coil(spark, sf_dir)
    as_of = c.agg(F.to_date(F.max("rolling_date")).alias("d"))
    preds = rulebook_file(spark, sf_dir).select(F.col("scored_at").alias("predicted_at"), "predicted_label")
    plates = c.select(F.col("rolling_date").alias("created_at"))
    return RP.dashboard_summary(plates, preds, current_alert_state(spark, sf_dir),
                                active_model_table(Build(spark, sf_dir)), as_of)


@query("event_props")
def event_props(spark, sf_dir):
    """JSON column parsing on the event stream table: props {"k": n} per event type."""
    e = driver.events(spark, sf_dir)
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"),
                                       F.count_if(k.isNull()).alias("n_without_k"),
                                       F.round(F.avg("value"), 6).alias("avg_value"))


@query("prediction_report")
def prediction_report(spark, sf_dir):
    """Latest prediction per plate with its model label and ranked top features."""
    from platewise.operators import report as RP
    b = Build(spark, sf_dir)
    c = driver.coil(spark, sf_dir)
    scored = SC.present(SC.score_linear(b.features), "prob", None).join(c.select("plate_no", "rolling_date"), "plate_no")
    first = scored.select("plate_no", F.col("rolling_date").alias("predicted_at"), "predicted_prob", "predicted_label",
                          F.lit(1).alias("model_id"))
    # re-scoring after a later inspection (the feedback loop): same model, later instant
    later = driver.inspection_history(c).join(
        c.select("plate_no", "rolling_date"), "plate_no").filter(F.col("inspected_at") > F.col("rolling_date"))
    second = first.join(later.select("plate_no", "inspected_at"), "plate_no").select(
        "plate_no", F.col("inspected_at").alias("predicted_at"), "predicted_prob", "predicted_label", "model_id")
    preds = first.unionByName(second)
    top = AT.top_feature_names(b.attribution_arrays, "plate_no", V.TOP_N_ATTRIBUTIONS)
    run, s = with_scalars(spark.range(1), b.run, "__run")
    models = run.select(F.lit(1).alias("model_id"), F.lit(V.MODEL_NAME).alias("name"),
                        RG.version_tag(F.lit(CANDIDATES[0][1]), s["trained_at"]).alias("version"))
    return RP.latest_prediction_report(preds, models, top)


# ----------------------------------------------------------------------------- step 12: streaming

#: Activation events of the stored registry that the stream reads: (model id, days after
#: registration, reason).  The latest one decides.
STREAM_ACTIVATIONS = [(1, 0, "bootstrap"), (4, 1, "manual"), (1, 2, "manual")]


def stream_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The static tables of the plant before the stream starts."""
    from platewise.operators.lookup import settled

    coil = settled(driver.coil(spark, sf_dir))  # the arrivals alone read it eight times
    specs = settled(NZ.assign_spec_codes(coil))
    plates = settled(NZ.plates(coil, specs))
    return {"coil": coil, "spec": specs, "plate": plates, "furnace": driver.furnace_history(spark, sf_dir)}


def stored_registry(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame], root: str) -> None:
    """Two candidates saved as bundles (medians fitted on the plant's history,
    background of 100 training rows), registered and activated in a stored registry."""
    from platewise.operators import bundle as BU
    from platewise.operators.lookup import settled

    history = settled(LT.serving_frame(tables["plate"], tables["spec"], tables["furnace"], NZ.rolling_records(tables["coil"])))
    medians, fallback = CL.fit_temp_imputer(history)
    b = Build(spark, sf_dir)
    keys = SP.background_sample(b.train.select("plate_no"), "plate_no", 100, 42).select("plate_no")
    sampled = history.join(keys, "plate_no", "left_semi")
    background = settled(FE.serving_features(
        CL.impute_group_median(sampled, global_after_group=False, medians=medians, fallback=fallback), keep=["plate_no"]))
    run = b.run.first()
    rows = []
    for mid, alg, intercept, coefs in CANDIDATES:
        if mid in {m for m, _, _ in STREAM_ACTIVATIONS}:
            path = f"{root}/{alg}"
            BU.save_linear(path, coefs, intercept, 0.5, medians, fallback, background)
            rows.append((mid, V.MODEL_NAME, alg, run["trained_at"], run["n"], path))
    versions = spark.createDataFrame(rows, "id long, name string, algorithm string, trained_at timestamp_ntz, train_row_count long, "
                                           "artifact_path string").withColumns({
        "version": RG.version_tag(F.col("algorithm"), F.col("trained_at")), "threshold": F.lit(0.5)})
    RG.append_versions(versions, root)
    events = spark.createDataFrame(STREAM_ACTIVATIONS, "model_id long, days int, reason string").withColumns({
        "name": F.lit(V.MODEL_NAME),
        "activated_at": F.timestamp_add("DAY", "days", F.lit(run["trained_at"]).cast("timestamp_ntz"))})
    RG.append_activations(events, root)


_PLANTS: dict[tuple[str, str], tuple[dict[str, DataFrame], str]] = {}


def plant(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], str]:
    """The plant as it stands before the stream starts: its static tables and the root of its
    stored registry, written once per application and input folder."""
    from platewise.streaming.ingest import run_folder

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANTS:
        root, tables = run_folder(spark, "plant"), stream_tables(spark, sf_dir)
        stored_registry(spark, sf_dir, tables, root)
        _PLANTS[key] = tables, root
    return _PLANTS[key]


def write_arrivals(coil: DataFrame, path: str) -> None:
    """Rolling records as they arrive, in four waves of files: two thirds of the plates; the
    other third, mostly older, with records sent again; second records a day later
    and records of unknown plates, with more sent again; everything once more."""
    r = NZ.rolling_records(coil).withColumn("k", F.substring("plate_no", 5, 1 << 30).cast("bigint"))
    k = F.col("k")
    second = r.filter(k % 13 == 0).withColumn("rolling_date", F.timestamp_add("DAY", F.lit(1), F.col("rolling_date")))
    unknown = r.filter(k % 101 == 0).withColumn("plate_no", F.concat(F.lit("NEW_"), k.cast("string")))
    waves = [r.filter(k % 3 != 2), r.filter(k % 3 == 2).unionByName(r.filter((k % 3 != 2) & (k % 7 == 0))),
             second.unionByName(unknown).unionByName(r.filter(k % 5 == 0)), r.unionByName(second)]
    for wave in waves:
        wave.drop("k").write.mode("append").parquet(path)


def run_rolling_stream(spark: SparkSession, sf_dir: str) -> str:
    """E1 over arriving files of rolling records, scored by the active version of the stored
    registry; runs to completion with availableNow and returns the output folder."""
    from platewise.streaming import ingest as IN

    root = IN.run_folder(spark, "rolling-ingest")
    t, registry = plant(spark, sf_dir)
    write_arrivals(t["coil"], f"{root}/arrivals")
    files = IN.files_per_batch(spark, f"{root}/arrivals")
    stream = spark.readStream.schema(IN.ROLLING_SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{root}/arrivals")
    IN.start_rolling_ingest(stream, t["plate"], t["spec"], t["furnace"], None, registry, f"{root}/out").awaitTermination()
    return f"{root}/out"


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from platewise.streaming import ingest as IN
    return IN.stream_table(spark, run_rolling_stream(spark, sf_dir), name)


@query("stream_dedup")
def stream_dedup(spark, sf_dir):
    """The accepted record of every plate."""
    return _nullable_temp_as_double(streamed(spark, sf_dir, "rolling"))


@query("stream_ingest_alerts")
def stream_ingest_alerts(spark, sf_dir):
    return streamed(spark, sf_dir, "alerts")


@query("stream_quarantine")
def stream_quarantine(spark, sf_dir):
    """Every other distinct record with its reason."""
    return streamed(spark, sf_dir, "quarantine").select("plate_no", "rolling_date", "reason")


@query("stream_predictions")
def stream_predictions(spark, sf_dir):
    """Probabilities of the active version's bundle."""
    return streamed(spark, sf_dir, "predictions").select(
        "plate_no", "predicted_at", F.col("predicted_prob").cast("double").alias("predicted_prob"), "predicted_label")


def _snapshot_schema() -> str:
    text = set(V.CATEGORICAL_FEATURES)
    whole = {"descaling_count", "hsb_x_descaling", "rolling_hour", "rolling_dow", *V.BINARY_FEATURES}
    return ", ".join(f"{c} {'string' if c in text else 'int' if c in whole else 'double'}"
                     for c in V.NUMERIC_FEATURES + V.BINARY_FEATURES + V.CATEGORICAL_FEATURES)


@query("stream_prediction_log")
def stream_prediction_log(spark, sf_dir):
    """The logged predictions with stable ids and the model version; the JSON
    snapshot of the features is read back field by field."""
    p = streamed(spark, sf_dir, "predictions").withColumn("f", F.from_json("feature_snapshot", _snapshot_schema()))
    return p.select("id", "plate_no", "model_version_id", F.col("predicted_prob").cast("double").alias("predicted_prob"),
                    "predicted_label", "predicted_at", "f.*")


@query("stream_explanations")
def stream_explanations(spark, sf_dir):
    """The five ranked contributions of every logged prediction."""
    return round_cols(streamed(spark, sf_dir, "explanations"), ["shap_value"])


@query("stream_run")
def stream_run(spark, sf_dir):
    """All five tables of one run: every distinct record with its outcome, its alerts, its
    prediction and the strongest feature."""
    from platewise.streaming import ingest as IN

    out = run_rolling_stream(spark, sf_dir)
    t = {n: IN.stream_table(spark, out, n) for n in IN.STREAM_TABLES}
    rows = t["rolling"].select("plate_no", "rolling_date", F.lit("accepted").alias("outcome")).unionByName(
        t["quarantine"].select("plate_no", "rolling_date", F.col("reason").alias("outcome")))
    n_alerts = t["alerts"].groupBy("plate_no", F.col("triggered_at").alias("rolling_date")).agg(F.count(F.lit(1)).alias("n_alerts"))
    best = t["explanations"].filter("rank = 1").select(F.col("prediction_id").alias("id"), F.col("feature_name").alias("top_feature"))
    preds = t["predictions"].select("id", "plate_no", F.col("predicted_at").alias("rolling_date"), "predicted_label").join(
        best, "id").drop("id")
    return rows.join(n_alerts, ["plate_no", "rolling_date"], "left").join(preds, ["plate_no", "rolling_date"], "left").select(
        "plate_no", "rolling_date", "outcome", F.coalesce("n_alerts", F.lit(0).cast("long")).alias("n_alerts"), "predicted_label",
        "top_feature")


@query("latest_logged_prediction")
def latest_logged_prediction(spark, sf_dir):
    """Plates inspected again are scored by another version, once more logged;
    the latest prediction of every plate with its version and its own top features."""
    from platewise.operators import bundle as BU
    from platewise.operators import report as RP
    from platewise.streaming import ingest as IN

    root = IN.run_folder(spark, "logged")
    t, registry = plant(spark, sf_dir)
    frame = settled(LT.serving_frame(t["plate"], t["spec"], t["furnace"], NZ.rolling_records(t["coil"])))
    again = driver.inspection_history(t["coil"]).select("plate_no", "inspected_at").join(
        t["coil"].select("plate_no", F.col("rolling_date").alias("d")), "plate_no").filter("inspected_at > d").drop("d")
    versions = RG.stored(spark, registry, "model_version")
    out = IN.BatchOutputs(spark, f"{root}/out")
    for n, (mid, rows, at) in enumerate([(1, frame, "rolling_date"), (4, frame.join(again, "plate_no"), "inspected_at")]):
        path = versions.filter(F.col("id") == mid).first()["artifact_path"]
        predictions, explanations = IN.predictions_of(rows, mid, BU.load(spark, path), at)
        out.write(n, {"predictions": predictions, "explanations": explanations})
    report = RP.logged_prediction_report(out.read("predictions", IN.STREAM_TABLES["predictions"]),
                                         out.read("explanations", IN.STREAM_TABLES["explanations"]), versions)
    return report.select("plate_no", "predicted_at", F.col("predicted_prob").cast("double").alias("predicted_prob"), "predicted_label",
                         "model_version", F.expr("transform(top_features, x -> x.feature_name)").alias("f"),
                         F.expr("transform(top_features, x -> round(x.shap_value, 6))").alias("c")).select(
        "plate_no", "predicted_at", "predicted_prob", "predicted_label", "model_version", F.array_join("f", ",").alias("top_features"),
        F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("top_sum"))


# ----------------------------------------------------------------------------- sources and sinks

@query("process_log_csv")
def process_log_csv(spark, sf_dir):
    """S1/S8/S11 round trip: the flat log written as legacy CSV twice (cp949 and UTF-8
    files side by side), read back with per-file encoding detection and typed parsing."""
    import os

    from platewise.sources import process_log as PL
    from platewise.streaming.ingest import run_folder

    root = run_folder(spark, "process-log")
    coil = driver.coil(spark, sf_dir)
    PL.write_process_log(coil, os.path.join(root, "cp949"), "cp949")
    PL.write_process_log(coil, os.path.join(root, "utf8"), "UTF-8")
    return PL.read_process_log(spark, os.path.join(root, "*", "*.csv"))


def mixed_process_log(spark: SparkSession, sf_dir: str) -> str:
    """The flat log as UTF-8 files, and once more as cp949 files with the columns the other
    way round, in which some lines have a field too many, a word for a number or a word
    for the date; returns the glob of both."""
    import os

    from platewise.sources import process_log as PL
    from platewise.streaming.ingest import run_folder

    root = run_folder(spark, "process-log")
    coil = driver.coil(spark, sf_dir)
    PL.write_process_log(coil, os.path.join(root, "utf8"), "UTF-8")
    k = F.substring("plate_no", 5, 1 << 30).cast("bigint")
    text = PL.to_legacy_text(coil).withColumns({
        "spec_long": F.when(k % 89 == 0, "AB,CD").otherwise(F.col("spec_long")),
        "pt_thick": F.when(k % 47 == 0, "wide").otherwise(F.col("pt_thick").cast("string")),
        "rolling_date": F.when(k % 71 == 0, "yesterday").otherwise(F.col("rolling_date"))})
    text.select(*reversed(text.columns)).write.option("header", True).option("encoding", "cp949").option(
        "quote", "").csv(os.path.join(root, "cp949"))
    return os.path.join(root, "*", "*.csv")


@query("process_log_accepted")
def process_log_accepted(spark, sf_dir):
    """The sound lines of files of two layouts and encodings."""
    from platewise.sources import process_log as PL
    return PL.read_process_log(spark, mixed_process_log(spark, sf_dir))


@query("process_log_rejected")
def process_log_rejected(spark, sf_dir):
    """The other lines, with their plate and the reason."""
    from platewise.sources import process_log as PL
    return PL.rejected_lines(spark, mixed_process_log(spark, sf_dir)).select(
        F.regexp_extract("line", r"(PLT_\d+)", 1).alias("plate_no"), "reason")


def multiline_process_log(spark: SparkSession, sf_dir: str) -> str:
    """The flat log with quotes around every field; some plates have a line break inside a
    field (and a doubled quote before it), and some lines repeat the header."""
    from platewise.sources import process_log as PL
    from platewise.streaming.ingest import run_folder

    root = run_folder(spark, "process-log")
    k = F.substring("plate_no", 5, 1 << 30).cast("bigint")
    broken = F.concat(F.lit('two "'), F.lit("\n"), F.lit("lines, "), F.col("spec_long"))
    text = PL.to_legacy_text(driver.coil(spark, sf_dir)).withColumn("spec_long", F.when(k % 59 == 0, broken).otherwise(F.col("spec_long")))
    again = text.filter(k % 997 == 0).select(*[F.lit(c).alias(c) for c in text.columns])
    text.select(*[F.col(c).cast("string") for c in text.columns]).unionByName(again).write.option("header", True).option(
        "quoteAll", True).option("escape", '"').csv(f"{root}/csv")
    return f"{root}/csv/*.csv"


def parsed_in_small_splits(spark: SparkSession, path: str) -> DataFrame:
    """The parsed records, read in file splits of 64 KB so that records cross them; of more text
    than 512 of those in larger ones, since every split reports to the driver several times."""
    from platewise.sources import process_log as PL

    sizes = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    split = str(max(65_536, -(-PL.bytes_of(spark, path) // 512)))
    try:
        for c in sizes:
            spark.conf.set(c, split)
        return settled(PL.parsed_lines(spark, path))
    finally:
        for c, v in sizes.items():
            spark.conf.set(c, v)


@query("process_log_multiline")
def process_log_multiline(spark, sf_dir):
    """Records with line breaks inside quotes, also across file splits."""
    from platewise.sources import process_log as PL
    return PL.typed_records(parsed_in_small_splits(spark, multiline_process_log(spark, sf_dir)))


@query("process_log_multiline_rejected")
def process_log_multiline_rejected(spark, sf_dir):
    """Header lines that come again are kept with a reason."""
    return parsed_in_small_splits(spark, multiline_process_log(spark, sf_dir)).filter("__reason is not null").groupBy(
        F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("processed_table")
def processed_table(spark, sf_dir):
    """The processed feature table written and read again."""
    from platewise.sources import process_log as PL
    from platewise.streaming.ingest import run_folder

    path = run_folder(spark, "processed")
    PL.write_processed(analysis_frame(spark, sf_dir).select(*ANALYSIS_COLUMNS), path)
    return round_cols(spark.read.parquet(path), ["cooling_rate_proxy"])


@query("load_written")
def load_written(spark, sf_dir):
    """P20: the log with faults loaded into tables; rows as observed by each write and as
    read back."""
    from platewise.streaming.ingest import run_folder

    root = run_folder(spark, "load")
    report = NZ.load(driver.raw_coil(spark, sf_dir), root, earlier_plates(spark, sf_dir))
    stored = None
    for name in ("product_spec", "plate", "furnace_process", "rolling_process", "quality_inspection", "quarantine"):
        n = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_stored"))
        stored = n if stored is None else stored.unionByName(n)
    return report.join(stored, "table_name")


#: Instants at which a retraining run reads the labels.
SNAPSHOTS = ["1995-06-17 00:00:00", "1999-01-01 00:00:00"]


def training_frame_as_of(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    t = normalized_tables(spark, sf_dir)
    tf = LT.training_frame(t["plate"], t["spec"], t["furnace"], t["rolling"], t["inspection"],
                           as_of=F.lit(as_of).cast("timestamp_ntz"))
    return tf.withColumn("target", TK.target_from_defect("defect_type"))


@query("labels_as_of")
def labels_as_of(spark, sf_dir):
    """The training labels as the append-only log of inspections stood at two
    instants; later labels change them."""
    t = normalized_tables(spark, sf_dir)
    out = None
    for at in SNAPSHOTS:
        tf = LT.training_frame(t["plate"], t["spec"], t["furnace"], t["rolling"], t["inspection"], as_of=F.lit(at).cast("timestamp_ntz"))
        rows = tf.select(F.lit(at).alias("as_of"), "plate_no", "defect_type", TK.target_from_defect("defect_type").alias("target"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("retrained_versions")
def retrained_versions(spark, sf_dir):
    """Two retraining runs, on the labels of two instants, append their versions
    to the stored registry; the first run's best is activated, later ones wait."""
    from platewise.plans import training as TR
    from platewise.streaming.ingest import run_folder

    root = run_folder(spark, "retrain")
    small = [TR.Family("LogisticRegression", TR.grid_of("LogisticRegression", [{"C": 1}])),
             TR.Family("DecisionTree", TR.grid_of("DecisionTree", [{"max_depth": 5, "min_samples_leaf": 5}]))]
    for n, at in enumerate(SNAPSHOTS):
        frame = settled(training_frame_as_of(spark, sf_dir, at))
        medians, fallback = CL.fit_temp_imputer(frame)
        base = CL.impute_group_median(frame, global_after_group=False, medians=medians, fallback=fallback)
        feats = FE.serving_features(base, keep=["plate_no", "target", "rolling_date"])
        TR.retrain(feats, root, f"run{n}", medians, fallback, small)
    v = RG.stored(spark, root, "model_version")
    active = RG.active_versions(RG.stored(spark, root, "model_activation")).select(F.col("model_id").alias("id"), F.lit(True).alias("a"))
    metrics = RG.extract_metrics(F.col("metrics"), F.col("algorithm"))[0]
    run = F.regexp_extract("version", r"(run\d+)$", 1)
    rows = v.join(active, "id", "left").withColumn("a", F.coalesce("a", F.lit(False)))
    return rows.groupBy(run.alias("run"), "name", "trained_at", "train_row_count").agg(
        F.array_join(F.array_sort(F.collect_list("algorithm")), ",").alias("algorithms"),
        F.bool_and(metrics["cv_best_auc"].between(0.0, 1.0)).alias("has_metrics"), F.count_if("a").alias("n_active"))


@query("model_listing")
def model_listing(spark, sf_dir):
    """T5: the registry, newest first."""
    r = Build(spark, sf_dir).registry.withColumn(
        "trained_at", F.timestamp_add("DAY", F.col("model_id").cast("int") % 3, F.col("trained_at")))
    place = F.row_number().over(Window.orderBy(F.col("trained_at").desc(), F.col("model_id").desc()))  # a few versions
    return RG.listing(r).select(place.alias("place"), "model_id", "algorithm", "trained_at", "train_row_count", "threshold")


@query("what_if_active")
def what_if_active(spark, sf_dir):
    """Every plate under five readings, scored by the active version of the stored
    registry, with the rules and the three strongest contributions; nothing is written."""
    from platewise import api

    asked = driver.coil(spark, sf_dir).drop("scale")
    r = api.what_if(SC.scenario_grid(asked, SCENARIO_TEMPS), plant(spark, sf_dir)[1], keep=["scenario_temp"])
    top = F.transform(F.slice("top_features", 1, 3), lambda x: x["feature"])
    return r.select("plate_no", "scenario_temp", "predicted_prob", "predicted_label", "model_version",
                    RU.rule_codes().alias("fired_rules"), F.array_join(top, ",").alias("top_features"))


# ----------------------------------------------------------------------------- step 11: training (rows-only checks)

def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 -> temperature imputed (training order, fitted on all rows as published) ->
    serving features, with the label from the latest inspection."""
    tf = settled(training_frame_q(spark, sf_dir))  # read for the medians and for the features
    base = CL.impute_group_median(tf, global_after_group=False)
    return FE.serving_features(base, keep=["plate_no", "target", "rolling_date"])


def _train(spark: SparkSession, sf_dir: str, family: str):
    from platewise.plans import training as TR
    fam = [f for f in TR.FAMILIES if f.name == family]
    return TR.train_compare(training_features(spark, sf_dir), fam)


@query("train_logistic_regression")
def train_logistic_regression(spark, sf_dir):
    """M3 + M9-M11: grid search (C) with 5 stratified folds, evaluation on valid/test."""
    return _train(spark, sf_dir, "LogisticRegression").comparison


@query("train_decision_tree")
def train_decision_tree(spark, sf_dir):
    """M4 + M9-M11."""
    return _train(spark, sf_dir, "DecisionTree").comparison


@query("train_svm")
def train_svm(spark, sf_dir):
    """M8 + M9-M11 (both kernels; Platt-scaled probabilities)."""
    return _train(spark, sf_dir, "SVM").comparison


@query("score_trained")
def score_trained(spark, sf_dir):
    """M16 with a fitted model: the decision-tree family's best model scores every
    plate of the training frame; label = probability >= 0.5."""
    from platewise.plans import training as TR
    feats = settled(training_features(spark, sf_dir))
    res = TR.train_compare(feats, [f for f in TR.FAMILIES if f.name == "DecisionTree"])
    model, platt = res.models["DecisionTree"]
    out = TR.score_with_model(feats, model, res.vocab, platt, 0.5, keep=["plate_no", "target"])
    return out.select("plate_no", F.round("prob", 4).alias("predicted_prob"), "predicted_label",
                      F.col("target").cast("boolean").alias("actual_label"))


@query("design_matrix")
def design_matrix_q(spark, sf_dir):
    """M1, M2: every model column of every plate, in long form."""
    from platewise.plans import training as TR
    feats = settled(training_features(spark, sf_dir))
    dm, cols = TR.design_matrix(feats, TR.fit_vocabulary(feats), keep=["plate_no"])
    return dm.unpivot("plate_no", cols, "feature", "value")


def explained_tree(spark: SparkSession, sf_dir: str):
    """A decision tree fitted on the training split, its leaves, the design matrix of every
    plate and the background: 100 training rows in md5 order."""
    from platewise.operators import tree_attribution as TA
    from platewise.plans import training as TR
    from platewise.streaming.ingest import run_folder
    data, cols, _ = TR.prepare(settled(training_features(spark, sf_dir)))
    data = data.checkpoint(eager=True)
    model = TR.fit_one(data, "DecisionTree", {"maxDepth": 8, "minInstancesPerNode": 5})
    path = run_folder(spark, "tree")
    model.write().save(path)
    train_keys = data.filter(F.col("split") == "train").select("plate_no")
    bg = data.join(SP.background_sample(train_keys, "plate_no", 100, 42).select("plate_no"), "plate_no", "left_semi")
    return TA.tree_attribution(data, bg, cols, TA.tree_leaves(spark, path)), model, data, bg


@query("tree_attribution")
def tree_attribution_q(spark, sf_dir):
    """M19 for a tree model: exact Shapley values of every plate's probability."""
    return round_cols(explained_tree(spark, sf_dir)[0], ["contribution"])


@query("attribution_additivity")
def attribution_additivity(spark, sf_dir):
    """The contributions of every plate add up to the model's probability minus its
    mean over the background, within 1e-9."""
    from pyspark.ml.functions import vector_to_array

    long, model, data, bg = explained_tree(spark, sf_dir)

    def prob(df: DataFrame) -> DataFrame:
        return model.transform(df).select("plate_no", vector_to_array("probability")[1].alias("prob"))

    base = prob(bg).agg(F.avg("prob").alias("base"))
    total = long.groupBy("plate_no").agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("n_features"))
    scored, s = with_scalars(prob(data).join(total, "plate_no"), base, "__base")
    return scored.select("plate_no", "n_features",
                         (F.abs(F.col("total") - (F.col("prob") - s["base"])) < 1e-9).alias("additive"))


@query("additivity_by_family")
def additivity_by_family(spark, sf_dir):
    """M19 for every family: the contributions of each plate add up to the model's value
    (probability of trees and forests, log-odds of the others) minus its base value."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from platewise.operators import bundle as BU
    from platewise.operators import tree_attribution as TA
    from platewise.plans import training as TR
    from platewise.streaming.ingest import run_folder

    data, cols, _ = TR.prepare(settled(training_features(spark, sf_dir)))
    data = settled(data)  # each fit reads the vectors only, each explanation the model columns only
    keys = SP.background_sample(data.filter(F.col("split") == "train").select("plate_no"), "plate_no", 100, 42).select("plate_no")
    bg = data.join(keys, "plate_no", "left_semi").checkpoint(eager=True)
    out = None
    for family, params in [("LogisticRegression", {"maxIter": 50, "regParam": 1e-3}), ("DecisionTree", {"maxDepth": 5}),
                           ("RandomForest", {"maxDepth": 4, "numTrees": 5}), ("GradientBoostingA", {"maxDepth": 3, "maxIter": 8}),
                           ("GradientBoostingB", {"maxDepth": 4, "maxIter": 5}), ("SVM", {"maxIter": 20})]:
        fitted = TR.fit_one(data, family, params)
        model = fitted if isinstance(fitted, PipelineModel) else PipelineModel([fitted])
        path = run_folder(spark, "family")
        model.write().save(path)
        platt = {"a": 1.5, "b": 0.25} if family == "SVM" else None
        values, items, _ = BU.explained(data, cols, model, path, bg, platt, "plate_no")
        if items is not None:
            total = data.select("plate_no", F.aggregate(items, F.lit(0.0), lambda a, x: a + x["contribution"]).alias("total"),
                                F.size(items).alias("n_features"))
        else:
            in_row = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
            total = values.select("plate_no", in_row.alias("t"), F.size("phi").alias("n")).groupBy("plate_no").agg(
                F.sum("t").alias("total"), F.sum("n").cast("int").alias("n_features"))
        raw = vector_to_array("rawPrediction")[1]
        value = {"SVM": F.lit(1.5) * raw, "LogisticRegression": raw, "GradientBoostingA": 2 * raw, "GradientBoostingB": 2 * raw}.get(
            family, vector_to_array("probability")[1])

        def valued(df: DataFrame, model=model, value=value) -> DataFrame:
            return model.transform(df).select("plate_no", value.alias("value"))

        if family.startswith("Gradient"):
            last = model.stages[-1]
            leaves = TA.boosted_leaves(spark, f"{path}/stages/0_{last.uid}", list(last.treeWeights))
            base = spark.range(1).select(F.lit(TA.expected(leaves)).alias("base"))
        else:
            base = valued(bg).agg(F.avg("value").alias("base"))
        scored, s = with_scalars(valued(data).join(total, "plate_no"), base, "__base")
        rows = scored.select(F.lit(family).alias("family"), "plate_no", "n_features",
                             (F.abs(F.col("total") - (F.col("value") - s["base"])) < 1e-6).alias("additive"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("training_certificates")
def training_certificates(spark, sf_dir):
    """M3, M4, M9: what must hold of a fitted logistic regression for each C of the grid, of a
    fitted tree and of the folds, each statement with the number of its cases that fail."""
    from platewise.plans import certificates as CE
    from platewise.plans import logistic as LO
    from platewise.plans import training as TR
    from platewise.streaming.ingest import run_folder

    data, cols, _ = TR.prepare(settled(training_features(spark, sf_dir)))
    data = settled(data)
    train = TR.with_weights(data.filter(F.col("split") == "train"), "label", "balanced")
    out = CE.fold_layout(train, "label").agg(F.lit("folds are even").alias("statement"), F.count_if(~F.col("holds")).alias("n_failed"))
    est, grid, described = TR.FAMILIES[0].build(train.count())
    models, _ = LO.fit_together(train, est.copy({est.tol: 1e-12}), [g[est.regParam] for g in grid], 0)
    for model, d in zip(models, described, strict=True):
        slopes = CE.logistic_gradient(train, model, cols)
        out = out.unionByName(slopes.agg(F.lit(f"logistic regression C={d['C']}: slopes vanish").alias("statement"),
                                         F.count_if(F.abs("slope") > 1e-5).alias("n_failed")))
    path = run_folder(spark, "certified-tree")
    TR.fit_one(data, "DecisionTree", {"maxDepth": 4, "minInstancesPerNode": 1}).write().save(path)
    nodes = CE.tree_nodes(spark, path)
    for name, rows in (("tree: leaves hold the shares of their rows", CE.leaf_shares(train, nodes, cols)),
                       ("tree: no split gains more than the chosen one", CE.best_splits(train, nodes, cols))):
        out = out.unionByName(rows.agg(F.lit(name).alias("statement"), F.count_if(~F.col("holds")).alias("n_failed")))
    return out


@query("six_families")
def six_families(spark, sf_dir):
    """The six families in one comparison (grids cut down to finish
    quickly; the published ones are ``training.FAMILIES``).  The row of each family with the
    checks that any row must meet: ranges, F1 from precision and recall, the grid's parameters."""
    from platewise.plans import training as TR

    by = {f.name: f for f in TR.FAMILIES}
    families = [
        TR.Family("LogisticRegression", TR.grid_of("LogisticRegression", [{"C": 1}])),
        TR.Family("DecisionTree", TR.grid_of("DecisionTree", [{"max_depth": 5, "min_samples_leaf": 5}])),
        TR.smaller_ensembles(by["RandomForest"], [3, 8], max_depth=5),
        TR.smaller_ensembles(by["GradientBoostingA"], [2, 5], max_depth=3, learning_rate=0.1),
        TR.smaller_ensembles(by["GradientBoostingB"], [2, 5], max_depth=3, learning_rate=0.1),
        TR.Family("SVM", TR.grid_of("SVM", [{"svc__C": 1, "svc__kernel": "rbf"}]))]
    c = TR.train_compare(training_features(spark, sf_dir), families).comparison

    def sound(split: str) -> F.Column:
        p, r, f1, auc = (F.col(f"{split}_{m}") for m in ("precision", "recall", "f1", "auc"))
        harmonic = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return (F.least(p, r, f1, auc) >= 0) & (F.greatest(p, r, f1, auc) <= 1) & (F.abs(f1 - harmonic) < 2e-4) & (auc > 0.5)

    return c.select("algorithm", "train_row_count", sound("valid").alias("valid_sound"), sound("test").alias("test_sound"),
                    (F.col("cv_best_auc").between(0.5, 1.0)).alias("cv_sound"),
                    F.size(F.from_json("best_params", "map<string,string>")).alias("n_params"))


@query("stream_inspections")
def stream_inspections(spark, sf_dir):
    """Inspection labels arriving as a stream (one per arriving order, a second one
    for re-inspected plates); accepted when the plate exists and the inspector is a known
    user; appended by batch id."""
    from platewise.streaming import ingest as IN

    arriving = driver.coil_from(driver.table_stream(spark, sf_dir, "orders"), driver.table(spark, sf_dir, "customer"))
    labels = driver.inspection_history(arriving).join(
        arriving.select("plate_no", F.concat(F.lit("engineer"), TK.leading_int("work_group").cast("string"),
                                             F.lit("@plant.local")).alias("inspector_email")), "plate_no")
    coil = driver.coil(spark, sf_dir)
    plates = NZ.plates(coil, NZ.assign_spec_codes(coil))
    # known inspectors: engineers of the work groups seen in the plates with furnace history
    users = plant_users(spark, sf_dir)
    out = IN.run_folder(spark, "inspection-ingest")
    IN.start_inspection_ingest(labels, plates, users, out).awaitTermination()
    return IN.BatchOutputs(spark, out).read(
        "inspections", "plate_no string, defect_type string, inspected_at timestamp_ntz, inspector_email string, user_id long")


@query("scored_csv_export")
def scored_csv_export(spark, sf_dir):
    """The scored file written as CSV (fired rule codes joined by ';', rows in risk
    order) and read back."""
    import os

    from platewise.sources import process_log as PL
    from platewise.streaming.ingest import run_folder

    path = os.path.join(run_folder(spark, "scored-export"), "scored")
    scored = rulebook_file(spark, sf_dir).orderBy(F.col("predicted_prob").desc(), "plate_no")
    PL.write_scored(scored.select("plate_no", "predicted_prob", "predicted_label", "fired_rules",
                                  "actual_label", "correct"), path)
    schema = "plate_no string, predicted_prob double, predicted_label boolean, fired_rules string, " \
             "actual_label boolean, correct boolean"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.withColumn("fired_rules", F.coalesce("fired_rules", F.lit("")))


@query("latest_per_plate")
def latest_per_plate(spark, sf_dir):
    """W1 under its plan name: newest furnace record per plate with full tie-breaks."""
    return latest_furnace(spark, sf_dir)


@query("defect_rate_by")
def defect_rate_by(spark, sf_dir):
    """A8 over several dimensions in ONE pass: grouping sets (hsb), (steel_kind),
    (rolling_method), (work_group) -> long rows (dimension, value, n, n_defect, rate)."""
    c = driver.coil(spark, sf_dir).select("hsb", "steel_kind", "rolling_method", "work_group",
                                          TK.target_from_scale("scale").alias("target"))
    dims = ["hsb", "steel_kind", "rolling_method", "work_group"]
    g = c.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("n_defect"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(dim)
        val = F.when(F.col(f"__g_{d}") == 0, F.col(d)).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("value"), "n", "n_defect",
                    (F.col("n_defect") / F.col("n")).alias("rate"))
