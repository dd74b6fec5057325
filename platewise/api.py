"""Public entry points: one function per endpoint / CLI of the original application,
each a composition of the operators (SURVEY §2.12).  All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import features as FE
from platewise.functions import tokens as TK
from platewise.functions import vocab as V
from platewise.operators import clean as CL
from platewise.operators import latest as LT
from platewise.operators import normalize as NZ
from platewise.operators import profile as PR
from platewise.operators import registry as RG
from platewise.operators import report as RP
from platewise.operators import rules as RU
from platewise.operators import score as SC
from platewise.operators import splits as SP
from platewise.operators.attribution import attribution_summary  # noqa: F401  (re-export)
from platewise.operators.rank import latest_by

__all__ = [
    "fit_imputer", "ingest_plates", "ingest_furnace", "ingest_inspections", "normalize", "score_table", "score_active", "score_summary",
    "score_scenarios", "what_if", "load", "alerts_view", "resolve_alerts", "dashboard_summary", "latest_predictions", "rank_models",
    "activate", "clean", "features", "time_split", "group_split", "profile_tables", "attribution_summary",
]


def plate_violations() -> Column:
    """S12 for plate records: positive sizes, steel kind in {C, T}, a plate number."""
    checks = [("plate_no_missing", F.col("plate_no").isNull()),
              ("steel_kind_domain", ~F.coalesce(F.col("steel_kind").isin("C", "T"), F.lit(False)))]
    checks += [(f"{c}_not_positive", ~F.coalesce(F.col(c) > 0, F.lit(False))) for c in ("pt_thick", "pt_width", "pt_length")]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def ingest_plates(records: DataFrame, specs: DataFrame | None = None, existing_plates: DataFrame | None = None,
                  created_at: str = "created_at") -> dict:
    """POST /plates for a batch: validate (S12), keep the first record of each plate of the
    batch and reject the later ones and known plates (S13), number new spec combinations after the existing ones (J2, J4, W6).
    Returns {'plates', 'specs', 'quarantine'}."""
    v = records.withColumn("__v", F.array_join(plate_violations(), ";"))
    order = created_at if created_at in records.columns else None
    v = NZ.mark_first(v, "plate_no", order, F.col("__v") == "", "__first")
    quarantine = v.filter(~F.col("__first")).select("plate_no", F.when(F.col("__v") != "", F.col("__v")).otherwise(
        "duplicate_in_batch").alias("reason"))
    ok = v.filter("__first").drop("__v", "__first")
    if existing_plates is not None:
        quarantine = quarantine.unionByName(ok.join(existing_plates.select("plate_no"), "plate_no", "left_semi")
                                            .select("plate_no", F.lit("plate_exists").alias("reason")))
        ok = NZ.new_rows(ok, existing_plates)
    all_specs = NZ.assign_spec_codes(ok, existing=specs)
    with_ts = ok.withColumn("rolling_date", F.col(created_at) if created_at in ok.columns
                            else F.lit(None).cast("timestamp_ntz"))
    return {"plates": NZ.plates(with_ts, all_specs), "specs": all_specs, "quarantine": quarantine}


def _accept(records: DataFrame, reason: Column, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``reason``)."""
    checked = records.withColumn("reason", reason).drop(*drop)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def _with_plate(records: DataFrame, plates: DataFrame) -> DataFrame:
    return records.join(plates.select("plate_no", F.lit(True).alias("__plate")).distinct(), "plate_no", "left")


def ingest_furnace(records: DataFrame, plates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """POST /furnace-records: (accepted, quarantined with a reason).  Every reading and the
    instant must be there (S12) and the plate must exist (J8)."""
    needed = [*LT.FURNACE_COLS, "recorded_at"]
    reason = (F.when(F.greatest(*[F.col(c).isNull() for c in needed]), "field_missing")
              .when(F.col("__plate").isNull(), "plate_missing"))
    return _accept(_with_plate(records, plates), reason, ["__plate"])


def ingest_inspections(records: DataFrame, plates: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """POST /quality-inspections: (accepted, quarantined with a reason).  The defect type
    must be a known one (S12); plate and inspector must exist (J8, J11); accepted rows
    carry the inspector id; the next training run uses the latest label (E2)."""
    known = users.select(F.col("email").alias("inspector_email"), F.col("user_id").alias("inspector_id")).dropDuplicates(
        ["inspector_email"])
    reason = (F.when(~F.coalesce(F.col("defect_type").isin(V.DEFECT_TYPES), F.lit(False)), "defect_type_domain")
              .when(F.col("__plate").isNull(), "plate_missing")
              .when(F.col("inspector_id").isNull(), "inspector_missing"))
    ok, bad = _accept(_with_plate(records, plates).join(known, "inspector_email", "left"), reason, ["__plate"])
    return ok, bad.drop("inspector_id")


def normalize(flat: DataFrame, existing_plates: DataFrame | None = None, existing_specs: DataFrame | None = None) -> dict:
    """CLI migrate: flat log -> spec, plate, furnace, rolling, inspection tables (P11) for
    plates not loaded yet (J3).  Rows that violate a domain or repeat a plate go to
    'quarantine' with a reason; 'report' counts what becomes of every row (P20)."""
    outcomes = NZ.load_outcomes(flat, existing_plates)
    rows = NZ.written(outcomes)
    specs = NZ.assign_spec_codes(rows, existing=existing_specs)
    return {"product_spec": specs, "plate": NZ.plates(rows, specs), "furnace_process": NZ.furnace_records(rows),
            "rolling_process": NZ.rolling_records(rows), "quality_inspection": NZ.inspections(rows),
            "quarantine": outcomes.filter(F.col("load_status") == "quarantined").drop("load_status"),
            "report": NZ.load_report(outcomes)}


def fit_imputer(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(medians, fallback) of a training log, to be passed to every later scoring."""
    return CL.fit_temp_imputer(_serving_tokens(flat))


def _serving_tokens(flat: DataFrame) -> DataFrame:
    base = flat.select(
        "*", TK.hsb_applied("hsb").alias("__hsb"), TK.method_lenient("rolling_method").alias("__method"),
        TK.leading_int("fur_no").alias("__fur_no"), TK.leading_int("fur_input_row").alias("__row"))
    return base.drop("rolling_method", "fur_no", "fur_input_row").withColumnsRenamed(
        {"__hsb": "hsb_applied", "__method": "rolling_method", "__fur_no": "fur_no", "__row": "fur_input_row"})


def score_table(flat: DataFrame, medians: DataFrame, fallback: DataFrame, coefs: dict = SC.RULEBOOK_COEFS,
                intercept: float = SC.RULEBOOK_INTERCEPT, threshold: float = 0.5) -> DataFrame:
    """POST /batch-predict: impute -> features -> probability -> label -> rules on the imputed
    reading -> actual and correct when a 'scale' column is present (M16).  ``medians`` and
    ``fallback`` come from the training log (:func:`fit_imputer`), so a plate's score
    doesn't depend on the other rows of its file.  For a fitted Spark ML model use
    :func:`platewise.plans.training.score_with_model`."""
    imputed = CL.impute_group_median(_serving_tokens(flat), global_after_group=False, medians=medians, fallback=fallback)
    keep = ["plate_no"] + (["scale"] if "scale" in flat.columns else [])
    feats = FE.serving_features(imputed, keep=keep)
    scored = SC.score_linear(feats, coefs, intercept, threshold)
    if "scale" in flat.columns:
        scored = SC.present(scored.withColumn("target", TK.target_from_scale("scale")), "prob", "target")
    else:
        scored = SC.present(scored, "prob", None)
    return RU.rule_hits(scored)


def score_active(flat: DataFrame, registry: DataFrame, activation_log: DataFrame, name: str = V.MODEL_NAME) -> DataFrame:
    """POST /batch-predict with the active version: the latest activation of ``name`` picks
    the stored bundle, whose medians, vocabulary and threshold decide; the columns are those
    of :func:`score_table`, with the version.  No active version -> ValueError."""
    from platewise.plans import training as TR

    active = RG.active_versions(activation_log.filter(F.col("name") == name)).join(
        registry.select("model_id", "artifact_path", "version"), "model_id").select("artifact_path", "version").first()
    if active is None:
        raise ValueError(f"no active version of {name}")
    keep = ["plate_no"] + (["scale"] if "scale" in flat.columns else [])
    rule_input = ["rolling_temp", "fur_soak_temp", "hsb_applied"]

    def features_of(medians: DataFrame, fallback: DataFrame) -> DataFrame:
        imputed = CL.impute_group_median(_serving_tokens(flat), global_after_group=False, medians=medians, fallback=fallback)
        return FE.serving_features(imputed, keep=keep)

    scored = TR.score_with_bundle(features_of, TR.load_bundle(active["artifact_path"]), [*keep, *rule_input])
    if "scale" in flat.columns:
        scored = SC.present(scored.withColumn("target", TK.target_from_scale("scale")), "prob", "target")
    else:
        scored = SC.present(scored, "prob", None)
    return RU.rule_hits(scored).withColumn("model_version", F.lit(active["version"]))


def _active_bundle(spark, root: str, name: str) -> tuple[str, dict]:
    from platewise.operators import bundle as BU

    active = RG.active_version(spark, root, name)
    if active is None:
        raise ValueError(f"no active version of {name}")
    return f"{active['name']} {active['version']}", BU.load(spark, active["artifact_path"])


def what_if(scenarios: DataFrame, registry: str, keep: list[str] | None = None, name: str = V.MODEL_NAME,
            k: int = V.TOP_N_ATTRIBUTIONS) -> DataFrame:
    """POST /predict-adhoc by the active version of the stored registry (M18): a table of
    scenarios in the flat layout gets probability, label, version label, the rules on the
    imputed reading and ``top_features``, the ``k`` strongest contributions in order.  A
    missing reading is imputed by the bundle.  Nothing is written.  Rows that ask about the
    same plate are told apart by the columns ``keep``."""
    from platewise.operators import attribution as AT
    from platewise.operators import bundle as BU

    label, bundle = _active_bundle(scenarios.sparkSession, registry, name)
    keep = ["plate_no", *(keep or [])]
    rows = _serving_tokens(scenarios).withColumn("__id", F.concat_ws("|", *keep))
    scored = BU.scored(BU.features_for(rows, bundle, [*keep, "__id"]), bundle, key="__id").withColumn("top_features", AT.strongest(k))
    return RU.rule_hits(SC.present(scored, "prob", None)).withColumn("model_version", F.lit(label)).drop("__id", "attributions", "prob")


def load(flat: DataFrame, root: str, existing_plates: DataFrame | None = None, existing_specs: DataFrame | None = None) -> DataFrame:
    """CLI migrate into stored tables; returns (table_name, rows_written) as observed by the
    writes (P20)."""
    return NZ.load(flat, root, existing_plates, existing_specs)


def score_summary(scored: DataFrame, model_label: Column | str) -> DataFrame:
    """Summary of a scored file."""
    return SC.file_summary(scored, model_label, "actual_label" in scored.columns)


def score_scenarios(scenarios: DataFrame, medians: DataFrame, fallback: DataFrame, **kw) -> DataFrame:
    """POST /predict-adhoc for a whole table of scenarios (M18): nothing is written, a NULL
    reading is imputed by the fitted medians, rules see the imputed reading."""
    return score_table(scenarios, medians, fallback, **kw)


def alerts_view(state: DataFrame, status: str = "open", plate_no: str | None = None) -> DataFrame:
    return RU.alerts_view(state, status, plate_no)


def resolve_alerts(alerts: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """PATCH /alerts/{id}/resolve as an append-only log -> current alert state."""
    return RU.alert_state(alerts, requests, users)


def dashboard_summary(plates: DataFrame, predictions: DataFrame, alert_state: DataFrame,
                      active: DataFrame, as_of: DataFrame) -> DataFrame:
    return RP.dashboard_summary(plates, predictions, alert_state, active, as_of)


def latest_predictions(predictions: DataFrame, models: DataFrame, attributions: DataFrame) -> DataFrame:
    """GET /predictions/{plate}: for every plate at once."""
    return RP.latest_prediction_report(predictions, models, attributions)


def rank_models(registry: DataFrame) -> DataFrame:
    """GET /models: newest first, with the five-level rank and parameter text."""
    valid, test = RG.extract_metrics(F.col("metrics"), F.col("algorithm"))
    r = registry.withColumns({"valid": valid, "test": test})
    return RG.listing(RG.rank_models(r, F.col("valid")).withColumn("params", RG.params_text(F.col("valid.best_params"))))


def activate(activation_log: DataFrame, registry: DataFrame, model_id: int, at) -> DataFrame:
    """POST /models/{id}/activate: append an activation event (unknown id -> nothing
    appended); the active version per name is the latest event (M14)."""
    event = registry.filter(F.col("model_id") == model_id).select(
        "name", "model_id", F.lit(at).cast("timestamp_ntz").alias("activated_at"), F.lit("manual").alias("reason"))
    return activation_log.unionByName(event)


def clean(flat: DataFrame, approx: bool = False) -> DataFrame:
    return CL.clean(flat, approx)


def features(cleaned: DataFrame) -> DataFrame:
    return FE.analysis_features(cleaned)


def time_split(df: DataFrame, ts: str = "rolling_date", key: str = "plate_no") -> DataFrame:
    return SP.time_split(df, ts, key)


def group_split(df: DataFrame, group: str = "work_group", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    return SP.group_split(df, group, test_size, seed)


def profile_tables(cleaned_features: DataFrame) -> dict:
    """The notebook tables: label shares, defect rate by breaker, mean drop by label,
    temperature histogram, drop box statistics, parity evidence (A7-A11, A23)."""
    d = cleaned_features
    defect = F.col("scale") == V.SCALE_DEFECT
    drop = F.col("fur_soak_temp") - F.col("rolling_temp")
    return {
        "label_distribution": PR.value_distribution(d, "scale"),
        "defect_rate_by_hsb": PR.rate_by(d, ["hsb"], defect),
        "mean_drop_by_label": PR.mean_by(d, ["scale"], drop, "mean_temp_drop"),
        "temp_histogram": PR.labelled_histogram(d, "rolling_temp", "scale", 40),
        "drop_boxplot": PR.box_stats(d, drop, ["scale"]),
        "descaling_parity": PR.rate_by(d, ["descaling_count"], defect),
    }


def latest_records(df: DataFrame, key: str, ts: str, *tie_breaks) -> DataFrame:
    """W1/W2/W5 in general form: newest row per key, explicit tie-breaks."""
    return latest_by(df, [key], [F.col(ts).desc(), *tie_breaks])


def serving_frame(plate: DataFrame, spec: DataFrame, furnace: DataFrame, rolling: DataFrame) -> DataFrame:
    return LT.serving_frame(plate, spec, furnace, rolling)
