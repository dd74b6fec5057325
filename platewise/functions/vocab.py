"""Domain vocabulary.

Fixed values: these literals must equal the ones used by the source process logs and
by the published rule definitions, so they are stated here plainly and in one place.
"""

# --- fixed values: flat process-log tokens -------------------------------------
HSB_ON = "적용"            # hsb column: breaker applied
HSB_OFF = "미적용"         # hsb column: breaker not applied
SCALE_DEFECT = "불량"      # scale column: defective plate
SCALE_GOOD = "양품"        # scale column: good plate
FURNACE_SUFFIX = "호기"    # fur_no tokens look like '1호기'
ROW_SUFFIX = "열"          # fur_input_row tokens look like '2열'
GROUP_SUFFIX = "조"        # work_group tokens look like '1조'
METHOD_TMCP = "TMCP"
METHOD_CR = "CR"
ROLLING_DATE_FORMAT = "ddMMMyyyy:HH:mm:ss"   # e.g. 03JAN2008:07:07:53

# --- fixed values: inspection defect types (in declaration order) ---------------
DEFECT_NONE = "없음"
DEFECT_TYPES = ["없음", "압입흠", "Scratch", "두께부족", "Scale"]
DEFECT_SCALE = "Scale"

# --- fixed values: thickness bucket labels (thin, medium, thick, extra thick) ---
THICK_LABELS = ["박(20미만)", "중(20-40)", "후(40-60)", "극후(60이상)"]
THICK_EDGES = [20, 40, 60]

# --- fixed values: rolling temperature bin labels and right-closed edges --------
TEMP_BIN_LABELS = ["<800", "800-850", "850-900", "900-950", "950-1000", ">=1000"]
TEMP_BIN_EDGES = [0, 800, 850, 900, 950, 1000]

# --- fixed values: alert rules -------------------------------------------------
ROLLING_TEMP_CRITICAL = 1000
TEMP_DROP_WARNING_BELOW = 190
RULE_HSB = "HSB_NOT_APPLIED"
RULE_HOT = "ROLLING_TEMP_OVER_1000"
RULE_DROP = "TEMP_DROP_INSUFFICIENT"
RULE_ORDER = [RULE_HSB, RULE_HOT, RULE_DROP]
SEVERITY_CRITICAL = "CRITICAL"
SEVERITY_WARNING = "WARNING"
SEVERITY_INFO = "INFO"
MSG_HSB = "Hot Scale Breaker 미적용 — 과거 데이터 기준 해당 조건 100% Scale 불량 발생"
MSG_HOT = "사상압연온도 %s℃ — 임계치(%s℃) 초과, HSB 적용 상태에서도 불량 위험 97.7%%"
MSG_DROP = "온도낙차 %s℃ — 관리 기준(%s℃) 미달, 양품 평균 낙차(228.9℃) 대비 냉각 부족"

# --- fixed values: report labels ------------------------------------------------
SEVERITY_LABELS = {"CRITICAL": "긴급", "WARNING": "주의", "INFO": "정보"}
RULE_LABELS = {
    "HSB_NOT_APPLIED": "HSB 미적용",
    "ROLLING_TEMP_OVER_1000": "사상압연온도 1000℃ 초과",
    "TEMP_DROP_INSUFFICIENT": "온도낙차 부족",
}
RISK_HIGH, RISK_MID, RISK_LOW, RISK_NONE = "고위험", "주의", "저위험", "N/A"
MATCH_YES, MATCH_NO, DASH = "일치", "불일치", "—"
NO_PARAMS_NOTE = "그리드서치 이전 버전"

# --- fixed values: required columns of a flat process log ----------------------
REQUIRED_COLUMNS = [
    "plate_no", "spec_long", "spec_country", "steel_kind", "pt_thick", "pt_width", "pt_length",
    "hsb", "fur_no", "fur_input_row", "fur_heat_temp", "fur_heat_time", "fur_soak_temp",
    "fur_soak_time", "fur_total_time", "rolling_method", "rolling_temp", "descaling_count",
    "work_group", "rolling_date",
]

# --- fixed values: model feature lists (serving form) ---------------------------
NUMERIC_FEATURES = [
    "pt_thick", "pt_width", "pt_length",
    "fur_heat_temp", "fur_heat_time",
    "fur_soak_temp", "fur_soak_time", "fur_total_time",
    "rolling_temp", "descaling_count",
    "temp_drop", "heat_soak_gap", "cooling_rate_proxy",
    "hsb_x_rolling_temp", "hsb_x_descaling",
    "rolling_hour", "rolling_dow",
]
BINARY_FEATURES = ["hsb_applied", "rolling_temp_over_1000", "hsb_x_over1000", "descaling_is_odd"]
ANALYSIS_BINARY_FEATURES = BINARY_FEATURES + ["rolling_temp_was_missing"]
CATEGORICAL_FEATURES = [
    "spec_country", "steel_kind", "fur_no", "fur_input_row", "rolling_method", "work_group", "thick_bucket",
]

# --- fixed values: columns cleaned by median / mode fills -----------------------
MEDIAN_FILL_COLUMNS = [
    "pt_thick", "pt_width", "pt_length", "fur_heat_temp", "fur_heat_time",
    "fur_soak_temp", "fur_soak_time", "fur_total_time", "rolling_temp", "descaling_count",
]
MODE_FILL_COLUMNS = [
    "spec_long", "spec_country", "steel_kind", "hsb", "fur_no", "fur_input_row", "rolling_method", "work_group",
]
OUTLIER_COLUMNS = ["fur_heat_temp", "fur_soak_temp", "rolling_temp"]

MODEL_NAME = "scale_defect_classifier"
TOP_N_ATTRIBUTIONS = 5
