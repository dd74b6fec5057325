"""DuckDB oracle SQL for the registered queries (same names, same output columns).

Each statement runs over the pre-registered driver tables through the view CTEs of
:mod:`platewise.plans.oracle_views`.  Types are cast to the Spark result types (DuckDB
sums of integers are HUGEINT and hour() is BIGINT, so both are cast).
"""

from __future__ import annotations

from platewise.plans.oracle_views import with_views

# What the SQL must know, written out here: nothing is imported from the code under test.
MSG_HSB = "Hot Scale Breaker 미적용 — 과거 데이터 기준 해당 조건 100% Scale 불량 발생"
MSG_HOT = ("사상압연온도 ", "℃ — 임계치(1000℃) 초과, HSB 적용 상태에서도 불량 위험 97.7%")
MSG_DROP = ("온도낙차 ", "℃ — 관리 기준(190℃) 미달, 양품 평균 낙차(228.9℃) 대비 냉각 부족")
NUMERIC = ["pt_thick", "pt_width", "pt_length", "fur_heat_temp", "fur_heat_time", "fur_soak_temp", "fur_soak_time", "fur_total_time",
           "rolling_temp", "descaling_count", "temp_drop", "heat_soak_gap", "cooling_rate_proxy", "hsb_x_rolling_temp",
           "hsb_x_descaling", "rolling_hour", "rolling_dow"]
BINARY = ["hsb_applied", "rolling_temp_over_1000", "hsb_x_over1000", "descaling_is_odd"]
CATEGORICAL = ["spec_country", "steel_kind", "fur_no", "fur_input_row", "rolling_method", "work_group", "thick_bucket"]
# The candidates: (model id, algorithm, intercept, weights).
CANDIDATES = [
    (1, "Rulebook", 7.3, {"hsb_applied": -4.0, "rolling_temp_over_1000": 3.5, "temp_drop": -0.03, "descaling_is_odd": 0.8,
                          "cooling_rate_proxy": -0.5, "pt_thick": 0.01, "fur_heat_time": -0.002, "heat_soak_gap": 0.01,
                          "descaling_count": 0.05}),
    (2, "BreakerOnly", 2.0, {"hsb_applied": -4.0}),
    (3, "TemperatureOnly", 4.0, {"rolling_temp_over_1000": 3.5, "temp_drop": -0.03}),
    (4, "DropAndParity", 4.5, {"temp_drop": -0.03, "descaling_is_odd": 0.8}),
]
RULEBOOK_INTERCEPT, RULEBOOK_COEFS = CANDIDATES[0][2:]

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, furnace: bool = False, inspection: bool = False, raw: bool = False) -> None:
    ORACLES[name] = with_views(body, furnace=furnace, inspection=inspection, raw=raw)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ----------------------------------------------------------------------------- shared SQL fragments

# Serving input: hsb flag, lenient method, leading-integer furnace tokens.
SERVING_INPUT = """
serving_input AS (
  SELECT plate_no, pt_thick, pt_width, pt_length, spec_long, spec_country, steel_kind,
         TRY_CAST(NULLIF(regexp_extract(fur_no, '^(\\d+)', 1), '') AS INTEGER) AS fur_no,
         TRY_CAST(NULLIF(regexp_extract(fur_input_row, '^(\\d+)', 1), '') AS INTEGER) AS fur_input_row,
         fur_heat_temp, fur_heat_time, fur_soak_temp, fur_soak_time, fur_total_time,
         COALESCE(hsb = '적용', false) AS hsb_applied,
         CASE WHEN starts_with(rolling_method, 'TMCP') THEN 'TMCP' ELSE 'CR' END AS rolling_method,
         rolling_temp, descaling_count, work_group, rolling_date,
         CAST(COALESCE(scale = '불량', false) AS INTEGER) AS target
  FROM coil
),
tm_group AS (
  SELECT steel_kind, rolling_method, median(CASE WHEN rolling_temp > 0 THEN rolling_temp END) AS gm
  FROM serving_input GROUP BY steel_kind, rolling_method
),
tm_global AS (SELECT median(CASE WHEN rolling_temp > 0 THEN rolling_temp END) AS m FROM serving_input),
imputed AS (
  SELECT s.* REPLACE (COALESCE(CAST(CASE WHEN s.rolling_temp > 0 THEN s.rolling_temp END AS DOUBLE), g.gm,
                               (SELECT m FROM tm_global)) AS rolling_temp)
  FROM serving_input s LEFT JOIN tm_group g ON s.steel_kind = g.steel_kind AND s.rolling_method = g.rolling_method
)"""

SERVING_FEATURES_SELECT = """
  SELECT plate_no, target,
    CAST(pt_thick AS DOUBLE) AS pt_thick, CAST(pt_width AS DOUBLE) AS pt_width, CAST(pt_length AS DOUBLE) AS pt_length,
    CAST(fur_heat_temp AS DOUBLE) AS fur_heat_temp, CAST(fur_heat_time AS DOUBLE) AS fur_heat_time,
    CAST(fur_soak_temp AS DOUBLE) AS fur_soak_temp, CAST(fur_soak_time AS DOUBLE) AS fur_soak_time,
    CAST(fur_total_time AS DOUBLE) AS fur_total_time, rolling_temp, descaling_count,
    fur_soak_temp - rolling_temp AS temp_drop,
    CAST(fur_heat_temp AS DOUBLE) - fur_soak_temp AS heat_soak_gap,
    COALESCE((fur_soak_temp - rolling_temp) / NULLIF(CAST(fur_total_time AS DOUBLE), 0.0), 0.0) AS cooling_rate_proxy,
    CAST(hsb_applied AS INTEGER) * rolling_temp AS hsb_x_rolling_temp,
    CAST(hsb_applied AS INTEGER) * descaling_count AS hsb_x_descaling,
    CAST(hour(rolling_date) AS INTEGER) AS rolling_hour,
    CAST(isodow(rolling_date) - 1 AS INTEGER) AS rolling_dow,
    CAST(hsb_applied AS INTEGER) AS hsb_applied,
    CAST(rolling_temp >= 1000 AS INTEGER) AS rolling_temp_over_1000,
    CAST(hsb_applied AS INTEGER) * CAST(rolling_temp >= 1000 AS INTEGER) AS hsb_x_over1000,
    CAST(((descaling_count % 2) + 2) % 2 = 1 AS INTEGER) AS descaling_is_odd,
    spec_country, steel_kind, CAST(fur_no AS VARCHAR) AS fur_no, CAST(fur_input_row AS VARCHAR) AS fur_input_row,
    rolling_method, work_group,
    CASE WHEN pt_thick < 20 THEN '박(20미만)' WHEN pt_thick < 40 THEN '중(20-40)'
         WHEN pt_thick < 60 THEN '후(40-60)' WHEN pt_thick IS NOT NULL THEN '극후(60이상)' END AS thick_bucket
  FROM imputed"""

# Analysis path: clean (flag, NULL sentinel, group median + global-after-group fallback,
# numeric median fill, mode fill) then analysis features.
_NUM = ["pt_thick", "pt_width", "pt_length", "fur_heat_temp", "fur_heat_time", "fur_soak_temp", "fur_soak_time", "fur_total_time",
        "rolling_temp", "descaling_count"]
_CAT = ["spec_long", "spec_country", "steel_kind", "hsb", "fur_no", "fur_input_row", "rolling_method", "work_group"]
_FENCED = ["fur_heat_temp", "fur_soak_temp", "rolling_temp"]

ANALYSIS = f"""
a0 AS (
  SELECT * REPLACE (CASE WHEN rolling_temp > 0 THEN rolling_temp END AS rolling_temp),
         CAST(COALESCE(rolling_temp <= 0, false) AS INTEGER) AS rolling_temp_was_missing
  FROM coil
),
a_g AS (SELECT steel_kind, rolling_method, median(CASE WHEN rolling_temp > 0 THEN rolling_temp END) AS gm
        FROM a0 GROUP BY steel_kind, rolling_method),
a1 AS (
  SELECT a0.* REPLACE (COALESCE(CAST(CASE WHEN a0.rolling_temp > 0 THEN a0.rolling_temp END AS DOUBLE), a_g.gm) AS rolling_temp)
  FROM a0 LEFT JOIN a_g ON a0.steel_kind = a_g.steel_kind AND a0.rolling_method = a_g.rolling_method
),
a2 AS (SELECT * REPLACE (COALESCE(rolling_temp, (SELECT median(rolling_temp) FROM a1)) AS rolling_temp) FROM a1),
a3 AS (SELECT * REPLACE ({", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT median({c}) FROM a2)) AS {c}" for c in _NUM)}) FROM a2),
cleaned AS (SELECT * REPLACE ({", ".join(
    f"COALESCE({c}, (SELECT {c} FROM a3 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
    for c in _CAT)}) FROM a3),
f0 AS (
  SELECT *, COALESCE(CAST(hsb = '적용' AS INTEGER), 0) AS hsb_applied,
         fur_soak_temp - rolling_temp AS temp_drop, fur_heat_temp - fur_soak_temp AS heat_soak_gap,
         COALESCE(CAST(rolling_temp >= 1000 AS INTEGER), 0) AS rolling_temp_over_1000,
         CASE WHEN rolling_temp <= 0 THEN NULL WHEN rolling_temp <= 800 THEN '<800' WHEN rolling_temp <= 850 THEN '800-850'
              WHEN rolling_temp <= 900 THEN '850-900' WHEN rolling_temp <= 950 THEN '900-950'
              WHEN rolling_temp <= 1000 THEN '950-1000' WHEN rolling_temp IS NOT NULL THEN '>=1000' END AS rolling_temp_bin,
         (fur_soak_temp - rolling_temp) / NULLIF(CAST(fur_total_time AS DOUBLE), 0.0) AS raw_rate
  FROM cleaned
),
analysis AS (
  SELECT *, hsb_applied * rolling_temp AS hsb_x_rolling_temp,
         hsb_applied * rolling_temp_over_1000 AS hsb_x_over1000,
         hsb_applied * descaling_count AS hsb_x_descaling,
         CASE WHEN pt_thick <= 0 THEN NULL WHEN pt_thick <= 20 THEN '박(20미만)' WHEN pt_thick <= 40 THEN '중(20-40)'
              WHEN pt_thick <= 60 THEN '후(40-60)' WHEN pt_thick IS NOT NULL THEN '극후(60이상)' END AS thick_bucket,
         COALESCE(raw_rate, (SELECT median(raw_rate) FROM f0)) AS cooling_rate_proxy,
         CAST(((descaling_count % 2) + 2) % 2 = 1 AS INTEGER) AS descaling_is_odd,
         CAST(hour(rolling_date) AS INTEGER) AS rolling_hour,
         CAST(isodow(rolling_date) - 1 AS INTEGER) AS rolling_dow,
         COALESCE(CAST(scale = '불량' AS INTEGER), 0) AS target
  FROM f0
)"""

ANALYSIS_COLUMNS = ["plate_no", *NUMERIC, *BINARY, "rolling_temp_was_missing", *CATEGORICAL, "rolling_temp_bin", "target"]

# Ingest rules on the raw reading.
RULES = """
ingest AS (
  SELECT plate_no, rolling_date, fur_soak_temp, work_group, scale,
         CASE WHEN rolling_temp > 0 THEN rolling_temp END AS rolling_temp,
         COALESCE(hsb = '적용', false) AS hsb_applied
  FROM coil
),
fired AS (
  SELECT *, NOT hsb_applied AS r1,
         COALESCE(rolling_temp >= 1000, false) AS r2,
         COALESCE(fur_soak_temp - rolling_temp < 190, false) AS r3
  FROM ingest
),
alerts AS (
  SELECT plate_no, 0 AS rule_pos, 'HSB_NOT_APPLIED' AS rule_code, 'CRITICAL' AS severity,
         '""" + MSG_HSB + """' AS message, rolling_date AS triggered_at FROM fired WHERE r1
  UNION ALL
  SELECT plate_no, CAST(r1 AS INTEGER), 'ROLLING_TEMP_OVER_1000', 'CRITICAL',
         '""" + MSG_HOT[0] + """' || CAST(rolling_temp AS VARCHAR) || '""" + MSG_HOT[1] + """', rolling_date
  FROM fired WHERE r2
  UNION ALL
  SELECT plate_no, CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER), 'TEMP_DROP_INSUFFICIENT', 'WARNING',
         '""" + MSG_DROP[0] + """' || CAST(fur_soak_temp - rolling_temp AS VARCHAR) || '""" + MSG_DROP[1] + """', rolling_date
  FROM fired WHERE r3
)"""

ALERT_STATE = """
users AS (
  SELECT DISTINCT CAST(TRY_CAST(NULLIF(regexp_extract(work_group, '^(\\d+)', 1), '') AS INTEGER) AS BIGINT) AS user_id,
         'engineer' || CAST(TRY_CAST(NULLIF(regexp_extract(work_group, '^(\\d+)', 1), '') AS INTEGER) AS VARCHAR) || '@plant.local' AS email
  FROM coil
),
requests AS (
  SELECT i.plate_no, a.rule_pos, 'engineer' || CAST(TRY_CAST(NULLIF(regexp_extract(c.work_group, '^(\\d+)', 1), '') AS INTEGER) AS VARCHAR) || '@plant.local' AS resolver_email,
         i.inspected_at AS requested_at
  FROM inspection i JOIN coil c ON c.plate_no = i.plate_no JOIN alerts a ON a.plate_no = i.plate_no
  WHERE i.defect_type = '없음'
),
valid AS (
  SELECT r.plate_no, r.rule_pos, r.requested_at, u.user_id, r.resolver_email,
         row_number() OVER (PARTITION BY r.plate_no, r.rule_pos ORDER BY r.requested_at, u.user_id) AS rn
  FROM requests r JOIN users u ON u.email = r.resolver_email
  JOIN alerts a ON a.plate_no = r.plate_no AND a.rule_pos = r.rule_pos
  WHERE r.requested_at >= a.triggered_at
),
state AS (
  SELECT a.*, v.requested_at AS resolved_at, v.resolver_email AS resolved_by
  FROM alerts a LEFT JOIN valid v ON v.plate_no = a.plate_no AND v.rule_pos = a.rule_pos AND v.rn = 1
)"""


# ----------------------------------------------------------------------------- step 1: cleaning

oracle("coil_flat", "SELECT * FROM coil")

_ALL_COLS = ["plate_no", "spec_long", "spec_country", "steel_kind", "pt_thick", "pt_width", "pt_length", "hsb",
             "fur_no", "fur_input_row", "fur_heat_temp", "fur_heat_time", "fur_soak_temp", "fur_soak_time",
             "fur_total_time", "rolling_method", "rolling_temp", "descaling_count", "work_group", "rolling_date",
             "scale"]
oracle("null_profile", "WITH n AS (SELECT * REPLACE (CASE WHEN rolling_temp > 0 THEN rolling_temp END AS rolling_temp) FROM coil)\n"
       + "\nUNION ALL\n".join(
           f"SELECT {_q(c)} AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM n"
           for c in _ALL_COLS), raw=True)

oracle("impute_rolling_temp", """
WITH c AS (
  SELECT plate_no, steel_kind, rolling_method, rolling_temp AS rolling_temp_raw,
         CAST(COALESCE(rolling_temp <= 0, false) AS INTEGER) AS rolling_temp_was_missing,
         CASE WHEN rolling_temp > 0 THEN rolling_temp END AS t
  FROM coil),
g AS (SELECT steel_kind, rolling_method, median(t) AS gm FROM c GROUP BY steel_kind, rolling_method),
f AS (SELECT c.*, COALESCE(CAST(t AS DOUBLE), g.gm) AS filled
      FROM c LEFT JOIN g ON c.steel_kind = g.steel_kind AND c.rolling_method = g.rolling_method)
SELECT plate_no, steel_kind, rolling_method, rolling_temp_raw, rolling_temp_was_missing,
       COALESCE(filled, (SELECT median(filled) FROM f)) AS rolling_temp
FROM f""")

oracle("median_fill", "WITH n AS (SELECT * REPLACE (CASE WHEN rolling_temp > 0 THEN rolling_temp END AS rolling_temp) FROM coil)\n"
       + "\nUNION ALL\n".join(
           f"SELECT {_q(c)} AS \"column\", CAST(median({c}) AS DOUBLE) AS fill_value, "
           f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_filled FROM n" for c in _NUM), raw=True)

oracle("mode_fill", "\nUNION ALL\n".join(
    f"SELECT {_q(c)} AS \"column\", (SELECT {c} FROM coil WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1) AS fill_value, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_filled FROM coil" for c in _CAT), raw=True)

oracle("iqr_outliers", "WITH " + ANALYSIS.strip() + ",\nq AS (\n" + "\nUNION ALL\n".join(
    f"SELECT {_q(c)} AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cleaned"
    for c in _FENCED) + "),\nb AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)\n"
    + "SELECT b.\"column\", round(b.q1, 9) AS q1, round(b.q3, 9) AS q3, round(b.lower, 9) AS lower, "
    + "round(b.upper, 9) AS upper, CAST(CASE b.\"column\" " + " ".join(
        f"WHEN {_q(c)} THEN (SELECT count(*) FROM cleaned WHERE {c} < b.lower OR {c} > b.upper)" for c in _FENCED)
    + " END AS BIGINT) AS n_outliers FROM b", raw=True)

oracle("cleaned_table", "WITH " + ANALYSIS.strip() + "\nSELECT * FROM cleaned")

oracle("cleaned_raw", "WITH " + ANALYSIS.strip() + "\nSELECT * FROM cleaned", raw=True)

# ----------------------------------------------------------------------------- step 2: features

oracle("features_serving", "WITH " + SERVING_INPUT.strip() + SERVING_FEATURES_SELECT)

oracle("features_analysis", "WITH " + ANALYSIS.strip() + "\nSELECT " + ", ".join(
    "round(cooling_rate_proxy, 9) AS cooling_rate_proxy" if c == "cooling_rate_proxy" else c for c in ANALYSIS_COLUMNS)
    + " FROM analysis")

oracle("temp_bins", "WITH " + ANALYSIS.strip() + """
SELECT rolling_temp_bin, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_defect,
       CAST(sum(target) AS DOUBLE) / count(*) AS defect_rate
FROM analysis GROUP BY rolling_temp_bin""")

oracle("thick_buckets", """
SELECT 'left' AS closed,
       CASE WHEN pt_thick < 20 THEN '박(20미만)' WHEN pt_thick < 40 THEN '중(20-40)'
            WHEN pt_thick < 60 THEN '후(40-60)' WHEN pt_thick IS NOT NULL THEN '극후(60이상)' END AS thick_bucket,
       count(*) AS n
FROM coil GROUP BY 1, 2
UNION ALL
SELECT 'right',
       CASE WHEN pt_thick <= 0 THEN NULL WHEN pt_thick <= 20 THEN '박(20미만)' WHEN pt_thick <= 40 THEN '중(20-40)'
            WHEN pt_thick <= 60 THEN '후(40-60)' WHEN pt_thick IS NOT NULL THEN '극후(60이상)' END,
       count(*)
FROM coil GROUP BY 1, 2""")

# ----------------------------------------------------------------------------- step 3: rules

oracle("rule_hits", "WITH " + RULES.strip() + """
SELECT plate_no,
       concat_ws(';', CASE WHEN r1 THEN 'HSB_NOT_APPLIED' END, CASE WHEN r2 THEN 'ROLLING_TEMP_OVER_1000' END,
                 CASE WHEN r3 THEN 'TEMP_DROP_INSUFFICIENT' END) AS rule_codes,
       CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) AS n_rules
FROM fired""")

oracle("rule_hits_imputed", "WITH " + SERVING_INPUT.strip() + """
SELECT plate_no, rolling_temp,
       concat_ws(';', CASE WHEN NOT hsb_applied THEN 'HSB_NOT_APPLIED' END,
                 CASE WHEN rolling_temp >= 1000 THEN 'ROLLING_TEMP_OVER_1000' END,
                 CASE WHEN fur_soak_temp - rolling_temp < 190 THEN 'TEMP_DROP_INSUFFICIENT' END) AS rule_codes,
       CAST(NOT hsb_applied AS INTEGER) + CAST(COALESCE(rolling_temp >= 1000, false) AS INTEGER)
         + CAST(COALESCE(fur_soak_temp - rolling_temp < 190, false) AS INTEGER) AS n_rules
FROM imputed""")

oracle("alerts_exploded", "WITH " + RULES.strip() + "\nSELECT * FROM alerts")

oracle("rule_evidence", """
SELECT COALESCE(hsb = '적용', false) AS hsb_applied,
       COALESCE(rolling_temp > 0 AND rolling_temp >= 1000, false) AS over_1000,
       count(*) AS n, CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS BIGINT) AS n_defect,
       CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS defect_rate
FROM coil GROUP BY 1, 2""")

oracle("alert_state", "WITH " + RULES.strip() + ",\n" + ALERT_STATE.strip() + """
SELECT plate_no, rule_pos, rule_code, severity, triggered_at, resolved_at, resolved_by FROM state""",
       inspection=True)

oracle("open_alerts", "WITH " + RULES.strip() + ",\n" + ALERT_STATE.strip() + """
SELECT plate_no, rule_pos, rule_code, severity, message, triggered_at FROM state WHERE resolved_at IS NULL""",
       inspection=True)

oracle("plate_alerts", "WITH " + RULES.strip() + ",\n" + ALERT_STATE.strip() + """
SELECT plate_no, rule_pos, rule_code, severity, message, triggered_at, resolved_at
FROM state WHERE plate_no = (SELECT max(plate_no) FROM state)""",
       inspection=True)

oracle("alert_labels", "WITH " + RULES.strip() + """
SELECT plate_no, rule_pos,
       CASE severity WHEN 'CRITICAL' THEN '긴급' WHEN 'WARNING' THEN '주의' WHEN 'INFO' THEN '정보' ELSE severity END
         AS severity_label,
       CASE rule_code WHEN 'HSB_NOT_APPLIED' THEN 'HSB 미적용' WHEN 'ROLLING_TEMP_OVER_1000' THEN '사상압연온도 1000℃ 초과'
         WHEN 'TEMP_DROP_INSUFFICIENT' THEN '온도낙차 부족' ELSE rule_code END AS rule_label,
       strftime(triggered_at, '%Y-%m-%d %H:%M') AS minute
FROM alerts""")


# ----------------------------------------------------------------------------- step 4: normalise

SPECS = """
fp AS (SELECT DISTINCT plate_no FROM furnace),
l1 AS (SELECT DISTINCT spec_long, spec_country, steel_kind FROM coil WHERE plate_no IN (SELECT plate_no FROM fp)),
s1 AS (SELECT printf('SPEC%03d', row_number() OVER (ORDER BY spec_long, spec_country, steel_kind)) AS spec_code,
              spec_long, spec_country, steel_kind FROM l1),
l2 AS (SELECT DISTINCT spec_long, spec_country, steel_kind FROM coil
       EXCEPT SELECT spec_long, spec_country, steel_kind FROM s1),
s2 AS (SELECT printf('SPEC%03d', (SELECT count(*) FROM s1) + row_number() OVER (ORDER BY spec_long, spec_country, steel_kind)) AS spec_code,
              spec_long, spec_country, steel_kind FROM l2),
specs AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)"""

PLATES = SPECS + """,
plates AS (
  SELECT c.plate_no, s.spec_code, CAST(TRY_CAST(c.pt_thick AS DOUBLE) AS INTEGER) AS pt_thick,
         CAST(TRY_CAST(c.pt_width AS DOUBLE) AS INTEGER) AS pt_width, CAST(TRY_CAST(c.pt_length AS DOUBLE) AS INTEGER) AS pt_length,
         c.rolling_date AS created_at
  FROM coil c LEFT JOIN specs s ON s.spec_long = c.spec_long AND s.spec_country = c.spec_country AND s.steel_kind = c.steel_kind
)"""

ROLLING = """
rolling AS (
  SELECT plate_no, COALESCE(hsb = '적용', false) AS hsb_applied,
         CASE WHEN starts_with(rolling_method, 'TMCP') THEN 'TMCP' WHEN starts_with(rolling_method, 'CR') THEN 'CR' END AS rolling_method,
         CASE WHEN CAST(TRY_CAST(rolling_temp AS DOUBLE) AS INTEGER) > 0 THEN CAST(TRY_CAST(rolling_temp AS DOUBLE) AS INTEGER) END AS rolling_temp,
         CAST(TRY_CAST(descaling_count AS DOUBLE) AS INTEGER) AS descaling_count, work_group, rolling_date
  FROM coil
)"""

oracle("product_specs", "WITH " + SPECS.strip() + "\nSELECT * FROM specs", furnace=True)

oracle("plates", "WITH " + PLATES.strip() + "\nSELECT * FROM plates", furnace=True)

oracle("furnace_records", """
SELECT plate_no,
       TRY_CAST(NULLIF(regexp_extract(fur_no, '^(\\d+)', 1), '') AS INTEGER) AS fur_no,
       TRY_CAST(NULLIF(regexp_extract(fur_input_row, '^(\\d+)', 1), '') AS INTEGER) AS fur_input_row,
       CAST(TRY_CAST(fur_heat_temp AS DOUBLE) AS INTEGER) AS fur_heat_temp, CAST(TRY_CAST(fur_heat_time AS DOUBLE) AS INTEGER) AS fur_heat_time,
       CAST(TRY_CAST(fur_soak_temp AS DOUBLE) AS INTEGER) AS fur_soak_temp, CAST(TRY_CAST(fur_soak_time AS DOUBLE) AS INTEGER) AS fur_soak_time,
       CAST(TRY_CAST(fur_total_time AS DOUBLE) AS INTEGER) AS fur_total_time, rolling_date AS recorded_at
FROM coil""")

oracle("rolling_records", "WITH " + ROLLING.strip() + "\nSELECT * REPLACE (CAST(rolling_temp AS DOUBLE) AS rolling_temp) FROM rolling")

oracle("inspections", """
SELECT plate_no, CASE WHEN scale = '불량' THEN 'Scale' ELSE '없음' END AS defect_type,
       'system-migration@plant.local' AS inspector_email, rolling_date AS inspected_at FROM coil""")

oracle("fk_violations", """
SELECT plate_no, rolling_date, 'furnace_record_missing' AS violation FROM coil c
WHERE NOT EXISTS (SELECT 1 FROM furnace f WHERE f.plate_no = c.plate_no)""", furnace=True)

_VIOL = {
    "plate_no_missing": "plate_no IS NULL",
    "steel_kind_domain": "NOT COALESCE(steel_kind IN ('C', 'T'), false)",
    "pt_thick_not_positive": "NOT COALESCE(pt_thick > 0, false)",
    "pt_width_not_positive": "NOT COALESCE(pt_width > 0, false)",
    "pt_length_not_positive": "NOT COALESCE(pt_length > 0, false)",
    "descaling_negative": "NOT COALESCE(descaling_count >= 0, false)",
    "rolling_method_unknown": "NOT (COALESCE(starts_with(rolling_method, 'TMCP'), false) OR COALESCE(starts_with(rolling_method, 'CR'), false))",
    "fur_no_unparsable": "TRY_CAST(NULLIF(regexp_extract(fur_no, '^(\\d+)', 1), '') AS INTEGER) IS NULL",
    "fur_input_row_unparsable": "TRY_CAST(NULLIF(regexp_extract(fur_input_row, '^(\\d+)', 1), '') AS INTEGER) IS NULL",
    "rolling_date_missing": "rolling_date IS NULL",
}
# Every row of the log with faults gets an outcome: already loaded, quarantined, written.
LOAD = """
viol AS (
  SELECT *, concat_ws(';', """ + ", ".join(f"CASE WHEN {v} THEN {_q(k)} END" for k, v in _VIOL.items()) + """) AS bad,
         COALESCE(plate_no IN (SELECT plate_no FROM furnace WHERE recorded_at < TIMESTAMP '1995-01-01'), false) AS seen
  FROM coil),
nth AS (SELECT *, row_number() OVER (PARTITION BY plate_no, seen, bad ORDER BY rolling_date) AS rn FROM viol),
outcome AS (
  SELECT * EXCLUDE (bad, seen, rn),
         CASE WHEN seen THEN 'skipped' WHEN bad <> '' OR rn > 1 THEN 'quarantined' ELSE 'written' END AS load_status,
         CASE WHEN seen THEN 'plate_exists' WHEN bad <> '' THEN bad WHEN rn > 1 THEN 'duplicate_in_batch' END AS load_reason
  FROM nth)"""

oracle("load_outcomes", "WITH " + LOAD.strip() + """
SELECT plate_no, rolling_date, COALESCE(load_status, '') AS load_status, COALESCE(load_reason, '') AS load_reason FROM outcome""",
       furnace=True, raw=True)

oracle("incremental_load", "WITH " + LOAD.strip() + """,
r AS (SELECT count(*) AS rows_read, count(*) FILTER (WHERE load_status = 'skipped') AS rows_skipped,
             count(*) FILTER (WHERE load_status = 'quarantined') AS rows_quarantined,
             count(*) FILTER (WHERE load_status = 'written') AS n FROM outcome)
SELECT rows_read, rows_skipped, rows_quarantined, n AS plates_written, n AS furnace_written, n AS rolling_written,
       n AS inspections_written FROM r""", furnace=True, raw=True)

oracle("loaded_rolling", "WITH " + LOAD.strip() + """
SELECT plate_no, COALESCE(hsb = '적용', false) AS hsb_applied,
       CASE WHEN starts_with(rolling_method, 'TMCP') THEN 'TMCP' ELSE 'CR' END AS rolling_method,
       CAST(CASE WHEN rolling_temp > 0 THEN rolling_temp END AS DOUBLE) AS rolling_temp, descaling_count, work_group, rolling_date
FROM outcome WHERE load_status = 'written'""", furnace=True, raw=True)

# Codes of an earlier load (plates rolled before 1996) go first; combinations that come up
# later are numbered after them.
oracle("spec_codes_after_load", """
WITH l1 AS (SELECT DISTINCT spec_long, spec_country, steel_kind FROM coil WHERE rolling_date < TIMESTAMP '1996-01-01'),
s1 AS (SELECT row_number() OVER (ORDER BY spec_long, spec_country, steel_kind) AS n, * FROM l1),
l2 AS (SELECT DISTINCT spec_long, spec_country, steel_kind FROM coil EXCEPT SELECT * FROM l1),
s2 AS (SELECT (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY spec_long, spec_country, steel_kind) AS n, * FROM l2)
SELECT printf('SPEC%03d', n) AS spec_code, spec_long, spec_country, steel_kind
FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)""", raw=True)

oracle("ingested_plates", """
WITH v AS (
  SELECT *, concat_ws(';', CASE WHEN plate_no IS NULL THEN 'plate_no_missing' END,
                      CASE WHEN NOT COALESCE(steel_kind IN ('C', 'T'), false) THEN 'steel_kind_domain' END,
                      CASE WHEN NOT COALESCE(pt_thick > 0, false) THEN 'pt_thick_not_positive' END,
                      CASE WHEN NOT COALESCE(pt_width > 0, false) THEN 'pt_width_not_positive' END,
                      CASE WHEN NOT COALESCE(pt_length > 0, false) THEN 'pt_length_not_positive' END) AS bad,
         COALESCE(plate_no IN (SELECT plate_no FROM furnace WHERE recorded_at < TIMESTAMP '1995-01-01'), false) AS seen
  FROM coil),
nth AS (SELECT *, row_number() OVER (PARTITION BY plate_no, bad ORDER BY rolling_date) AS rn FROM v)
SELECT plate_no, CASE WHEN bad <> '' THEN bad WHEN rn > 1 THEN 'duplicate_in_batch' WHEN seen THEN 'plate_exists'
                      ELSE 'accepted' END AS outcome
FROM nth""", furnace=True, raw=True)

oracle("domain_violations", "\nUNION ALL\n".join(
    f"SELECT {_q(k)} AS violation, count(*) FILTER (WHERE {v}) AS n_rows FROM coil" for k, v in _VIOL.items()), raw=True)

oracle("duplicate_keys", """
SELECT plate_no, recorded_at, count(*) AS n FROM furnace GROUP BY plate_no, recorded_at HAVING count(*) > 1""",
       furnace=True)

# ----------------------------------------------------------------------------- step 5: latest records

LATEST_FURNACE = """
lf AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY plate_no ORDER BY recorded_at DESC, seq, l_partkey, l_suppkey, l_extendedprice) AS rn
    FROM furnace) WHERE rn = 1
)"""

LATEST_INSPECTION = """
li AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY plate_no ORDER BY inspected_at DESC, defect_type) AS rn
    FROM inspection) WHERE rn = 1
)"""

SERVING_FRAME = PLATES + ",\n" + ROLLING.strip() + ",\n" + LATEST_FURNACE.strip() + """,
serving AS (
  SELECT p.plate_no, p.pt_thick, p.pt_width, p.pt_length, s.spec_country, s.steel_kind,
         lf.fur_no, lf.fur_input_row, lf.fur_heat_temp, lf.fur_heat_time, lf.fur_soak_temp, lf.fur_soak_time, lf.fur_total_time,
         r.hsb_applied, r.rolling_method, r.rolling_temp, r.descaling_count, r.work_group, r.rolling_date
  FROM plates p JOIN specs s ON s.spec_code = p.spec_code
  JOIN lf ON lf.plate_no = p.plate_no
  JOIN rolling r ON r.plate_no = p.plate_no
)"""

TRAINING_FRAME = SERVING_FRAME + ",\n" + LATEST_INSPECTION.strip() + """,
training AS (
  SELECT s.*, li.defect_type, CAST(COALESCE(li.defect_type = 'Scale', false) AS INTEGER) AS target
  FROM serving s JOIN li ON li.plate_no = s.plate_no
)"""

oracle("latest_furnace", "WITH " + LATEST_FURNACE.strip() + """
SELECT plate_no, recorded_at, fur_no, fur_input_row, fur_heat_temp, fur_heat_time, fur_soak_temp, fur_soak_time, fur_total_time
FROM lf""", furnace=True)

oracle("latest_event_per_user", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")

# Features of the training frame, imputed by its own medians, with the one-hot levels.
DESIGN = TRAINING_FRAME + """,
tf_group AS (SELECT steel_kind, rolling_method, median(rolling_temp) AS gm FROM training GROUP BY steel_kind, rolling_method),
imputed AS (
  SELECT t.* REPLACE (COALESCE(CAST(t.rolling_temp AS DOUBLE), g.gm, (SELECT median(rolling_temp) FROM training)) AS rolling_temp)
  FROM training t LEFT JOIN tf_group g ON t.steel_kind = g.steel_kind AND t.rolling_method = g.rolling_method
),
tfeat AS (""" + SERVING_FEATURES_SELECT + """),
cats AS (UNPIVOT (SELECT plate_no, spec_country, steel_kind, fur_no, fur_input_row, rolling_method, work_group, thick_bucket
                  FROM tfeat) ON COLUMNS(* EXCLUDE plate_no) INTO NAME col VALUE val),
levels AS (SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY val) AS n FROM (SELECT DISTINCT col, val FROM cats)),
nums AS (UNPIVOT (SELECT plate_no, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC + BINARY) + """
                  FROM tfeat) ON COLUMNS(* EXCLUDE plate_no) INTO NAME feature VALUE value)"""

oracle("design_matrix", "WITH " + DESIGN.strip() + """
SELECT plate_no, feature, value FROM nums
UNION ALL
SELECT c.plate_no, l.col || '_' || l.val, CAST(c.val = l.val AS DOUBLE) FROM cats c JOIN levels l ON l.col = c.col AND l.n > 1""",
       furnace=True, inspection=True)

oracle("attribution_additivity", "WITH " + DESIGN.strip() + """,
n AS (SELECT count(DISTINCT feature) + (SELECT count(*) FROM levels WHERE n > 1) AS n FROM nums)
SELECT plate_no, (SELECT n FROM n) AS n_features, true AS additive FROM training""", furnace=True, inspection=True)

oracle("training_frame", "WITH " + TRAINING_FRAME.strip() + "\nSELECT * REPLACE (CAST(rolling_temp AS DOUBLE) AS rolling_temp) FROM training", furnace=True, inspection=True)

oracle("serving_frame", "WITH " + SERVING_FRAME.strip() + "\nSELECT * REPLACE (CAST(rolling_temp AS DOUBLE) AS rolling_temp) FROM serving", furnace=True)

# ----------------------------------------------------------------------------- step 6: profiles

oracle("label_distribution", """
SELECT scale, count(*) AS n, count(*) / CAST((SELECT count(*) FROM coil) AS DOUBLE) AS share FROM coil GROUP BY scale""")

oracle("defect_rate_by_hsb", """
SELECT hsb, count(*) AS n, CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate
FROM coil GROUP BY hsb""")

oracle("mean_drop_by_label", "WITH " + ANALYSIS.strip() + """
SELECT scale, count(*) AS n, round(avg(fur_soak_temp - rolling_temp), 9) AS mean_temp_drop FROM cleaned GROUP BY scale""")

oracle("temp_histogram", "WITH " + ANALYSIS.strip() + """,
rng AS (SELECT CAST(min(rolling_temp) AS DOUBLE) AS lo, CAST(max(rolling_temp) AS DOUBLE) AS hi FROM cleaned),
b AS (
  SELECT scale, CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(floor((rolling_temp - lo) * 40 / (hi - lo)) AS INTEGER), 39) END AS bin,
         lo, (hi - lo) / 40 AS w
  FROM cleaned, rng WHERE rolling_temp IS NOT NULL
)
SELECT scale, bin, any_value(lo) + bin * any_value(w) AS bin_lo, any_value(lo) + (bin + 1) * any_value(w) AS bin_hi, count(*) AS n
FROM b GROUP BY scale, bin""")

oracle("drop_boxplot", "WITH " + ANALYSIS.strip() + """,
v AS (SELECT scale, CAST(fur_soak_temp - rolling_temp AS DOUBLE) AS v FROM cleaned),
q AS (SELECT scale, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY scale),
j AS (SELECT v.*, q.q1, q.median, q.q3,
             v.v >= q.q1 - 1.5 * (q.q3 - q.q1) AND v.v <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM v JOIN q ON q.scale = v.scale)
SELECT scale, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
       round(min(CASE WHEN inside THEN v END), 9) AS whisker_lo, round(max(CASE WHEN inside THEN v END), 9) AS whisker_hi,
       count(*) FILTER (WHERE NOT inside) AS n_fliers, count(*) AS n
FROM j GROUP BY scale, q1, median, q3""")

oracle("descaling_parity", """
SELECT descaling_count, count(*) AS n, CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate,
       ((descaling_count % 2) + 2) % 2 = 1 AS is_odd
FROM coil GROUP BY descaling_count""")


# ----------------------------------------------------------------------------- step 7: splits

TIME_SPLIT = """
ts AS (
  SELECT plate_no, rolling_date, work_group, CAST(COALESCE(scale = '불량', false) AS INTEGER) AS target,
         row_number() OVER (ORDER BY rolling_date, plate_no) - 1 AS pos, count(*) OVER () AS n
  FROM coil
),
tsplit AS (
  SELECT *, CASE WHEN pos < n - floor(n * 0.15::DOUBLE) - floor(n * 0.15::DOUBLE) THEN 'train'
                 WHEN pos < n - floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split
  FROM ts
),
tr AS (SELECT * FROM tsplit WHERE split = 'train')"""

oracle("time_split", "WITH " + TIME_SPLIT.strip() + "\nSELECT plate_no, rolling_date, pos, split FROM tsplit")

oracle("split_profile", "WITH " + TIME_SPLIT.strip() + """
SELECT split, count(*) AS n, min(rolling_date) AS min_date, max(rolling_date) AS max_date,
       avg(CAST(target AS DOUBLE)) AS defect_rate,
       string_agg(DISTINCT work_group, ',' ORDER BY work_group) AS groups
FROM tsplit GROUP BY split""")

oracle("group_split", """
WITH g AS (SELECT DISTINCT work_group FROM coil WHERE work_group IS NOT NULL),
gr AS (SELECT work_group, row_number() OVER (ORDER BY md5('42' || work_group), work_group) - 1 AS gpos,
              count(*) OVER () AS gn FROM g),
side AS (SELECT work_group, CASE WHEN gpos < ceil(gn * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM gr)
SELECT c.plate_no, c.work_group, side.split FROM coil c LEFT JOIN side ON side.work_group = c.work_group""")


def _fold_sql(k: int = 5) -> str:
    cums, terms = [], []
    for f in range(k):
        cums.append(f"(floor((b - {f} + {k - 1}) / {k}) - floor((a - {f} + {k - 1}) / {k}))")
        if f < k - 1:
            terms.append(f"CAST(({' + '.join(cums)}) <= r AS INTEGER)")
    return " + ".join(terms)


oracle("stratified_folds", "WITH " + TIME_SPLIT.strip() + """,
fl AS (SELECT arg_min(target, pos) AS first_label FROM tr),
enc AS (SELECT tr.*, CAST(tr.target != fl.first_label AS INTEGER) AS enc FROM tr, fl),
cnt AS (SELECT count(*) FILTER (WHERE enc = 0) AS n0, count(*) AS n FROM enc),
rr AS (SELECT enc.plate_no, enc.target, row_number() OVER (PARTITION BY enc.enc ORDER BY enc.pos) - 1 AS r,
              CASE WHEN enc.enc = 0 THEN 0 ELSE cnt.n0 END AS a, CASE WHEN enc.enc = 0 THEN cnt.n0 ELSE cnt.n END AS b
       FROM enc, cnt)
SELECT plate_no, target, CAST(""" + _fold_sql(5) + """ AS INTEGER) AS fold FROM rr""")

oracle("background_sample", "WITH " + TIME_SPLIT.strip() + """
SELECT plate_no, CAST(row_number() OVER (ORDER BY h, plate_no) AS INTEGER) AS sample_rank
FROM (SELECT plate_no, md5('42' || plate_no) AS h FROM tr ORDER BY h, plate_no LIMIT 100)""")

# ----------------------------------------------------------------------------- step 8: metrics

_Z = f"CAST({RULEBOOK_INTERCEPT!r} AS DOUBLE)" + "".join(
    f" + CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE)" for c, w in RULEBOOK_COEFS.items())

SCORED = SERVING_INPUT + ",\nfeats AS (" + SERVING_FEATURES_SELECT + "\n),\n" + f"""scored AS (
  SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_Z}))) AS prob FROM feats
),
pres AS (
  SELECT *, prob >= 0.5 AS predicted_label, round(prob, 4) AS predicted_prob, CAST(target AS BOOLEAN) AS actual_label
  FROM scored
)"""

SCORED_SPLIT = SCORED + ",\n" + TIME_SPLIT.strip() + """,
ss AS (SELECT pres.*, tsplit.split FROM pres JOIN tsplit ON tsplit.plate_no = pres.plate_no)"""


def _ratio(num: str, den: str) -> str:
    return f"round(COALESCE(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0.0), 0.0), 4)"


oracle("score_fixed_linear", "WITH " + SCORED.strip() + """
SELECT plate_no, predicted_prob, predicted_label, actual_label, actual_label = predicted_label AS correct FROM pres""")

oracle("confusion", "WITH " + SCORED.strip() + """
SELECT count(*) FILTER (WHERE actual_label AND predicted_label) AS tp,
       count(*) FILTER (WHERE NOT actual_label AND predicted_label) AS fp,
       count(*) FILTER (WHERE NOT actual_label AND NOT predicted_label) AS tn,
       count(*) FILTER (WHERE actual_label AND NOT predicted_label) AS fn
FROM pres""")

oracle("threshold_metrics", "WITH " + SCORED_SPLIT.strip() + """,
cm AS (
  SELECT split, count(*) FILTER (WHERE target = 1 AND prob >= 0.5) AS tp, count(*) FILTER (WHERE target = 0 AND prob >= 0.5) AS fp,
         count(*) FILTER (WHERE target = 0 AND prob < 0.5) AS tn, count(*) FILTER (WHERE target = 1 AND prob < 0.5) AS fn
  FROM ss GROUP BY split)
SELECT split, tp, fp, tn, fn, """ + _ratio("tp + tn", "tp + fp + tn + fn") + " AS accuracy, " + _ratio("tp", "tp + fp")
       + " AS precision, " + _ratio("tp", "tp + fn") + " AS recall, " + _ratio("2 * tp", "2 * tp + fp + fn") + " AS f1 FROM cm")

oracle("roc_auc", "WITH " + SCORED_SPLIT.strip() + """,
ps AS (SELECT split, prob, CAST(sum(target) AS BIGINT) AS pos, CAST(sum(1 - target) AS BIGINT) AS neg FROM ss GROUP BY split, prob),
c AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY split ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM ps)
SELECT split,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN round(sum(pos * (nb + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 4) END AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM c GROUP BY split""")

oracle("class_weights", "WITH " + TIME_SPLIT.strip() + """,
c AS (SELECT split, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM tsplit GROUP BY split)
SELECT split, n, n_pos, n - n_pos AS n_neg,
       CASE WHEN n_pos > 0 THEN CAST(n - n_pos AS DOUBLE) / n_pos ELSE 1.0::DOUBLE END AS scale_pos_weight,
       CASE WHEN n_pos > 0 THEN n / (2.0::DOUBLE * n_pos) END AS weight_pos,
       CASE WHEN n - n_pos > 0 THEN n / (2.0::DOUBLE * (n - n_pos)) END AS weight_neg
FROM c""")

# ----------------------------------------------------------------------------- step 9: scoring

RULE_CODES_OF = """concat_ws(';', CASE WHEN hsb_applied = 0 THEN 'HSB_NOT_APPLIED' END,
                 CASE WHEN rolling_temp >= 1000 THEN 'ROLLING_TEMP_OVER_1000' END,
                 CASE WHEN fur_soak_temp - rolling_temp < 190 THEN 'TEMP_DROP_INSUFFICIENT' END)"""

oracle("risk_ranking", "WITH " + SCORED.strip() + """
SELECT plate_no, predicted_prob, predicted_label, """ + RULE_CODES_OF + """ AS fired_rules,
       CASE WHEN predicted_prob IS NULL THEN 'N/A' WHEN predicted_prob >= 0.7 THEN '고위험'
            WHEN predicted_prob >= 0.3 THEN '주의' ELSE '저위험' END AS risk,
       (SELECT count(*) FROM pres) AS n_total
FROM pres ORDER BY predicted_prob DESC, plate_no LIMIT 200""")

oracle("risk_top5", "WITH " + SCORED.strip() + """
SELECT CAST(row_number() OVER (ORDER BY predicted_prob DESC, plate_no) AS INTEGER) AS place, plate_no, predicted_prob,
       (SELECT count(*) FROM pres) AS n_total
FROM pres ORDER BY predicted_prob DESC, plate_no LIMIT 5""")

oracle("file_summary", "WITH " + SCORED.strip() + """,
s AS (
  SELECT count(*) AS total_rows, count(*) FILTER (WHERE predicted_label) AS predicted_defect_count,
         count(*) FILTER (WHERE actual_label AND predicted_label) AS tp,
         count(*) FILTER (WHERE NOT actual_label AND predicted_label) AS fp,
         count(*) FILTER (WHERE NOT actual_label AND NOT predicted_label) AS tn,
         count(*) FILTER (WHERE actual_label AND NOT predicted_label) AS fn
  FROM pres)
SELECT total_rows, predicted_defect_count, tp, fp, tn, fn,
       """ + _ratio("predicted_defect_count", "total_rows") + """ AS predicted_defect_rate,
       'rulebook_logistic v1' AS model_version, true AS has_actual_labels,
       """ + _ratio("tp + tn", "total_rows") + " AS accuracy, " + _ratio("tp", "tp + fp") + " AS precision, "
       + _ratio("tp", "tp + fn") + " AS recall FROM s")

_GRID_FEATS = SERVING_FEATURES_SELECT.replace("FROM imputed", "FROM grid").replace(
    "SELECT plate_no, target,", "SELECT plate_no, scenario_temp,")
oracle("what_if_grid", "WITH " + SERVING_INPUT.strip() + """,
grid AS (
  SELECT s.* REPLACE (CAST(t.scenario_temp AS DOUBLE) AS rolling_temp), t.scenario_temp
  FROM serving_input s, (VALUES (850), (900), (950), (1000), (1050)) AS t(scenario_temp)
),
gf AS (""" + _GRID_FEATS + f"""
),
gs AS (SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_Z}))) AS prob FROM gf)
SELECT plate_no, CAST(scenario_temp AS INTEGER) AS scenario_temp, round(prob, 4) AS predicted_prob,
       prob >= 0.5 AS predicted_label, """ + RULE_CODES_OF + " AS fired_rules FROM gs")

oracle("what_if_missing", "WITH " + SERVING_INPUT.strip() + """,
grid AS (
  SELECT s.* REPLACE (CAST(COALESCE(g.gm, (SELECT m FROM tm_global)) AS DOUBLE) AS rolling_temp), 0 AS scenario_temp
  FROM serving_input s LEFT JOIN tm_group g ON s.steel_kind = g.steel_kind AND s.rolling_method = g.rolling_method
),
gf AS (""" + _GRID_FEATS + f"""
),
gs AS (SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_Z}))) AS prob FROM gf)
SELECT plate_no, rolling_temp, round(prob, 4) AS predicted_prob, prob >= 0.5 AS predicted_label, """
       + RULE_CODES_OF + " AS fired_rules FROM gs")

_ATTR_NAMES = list(RULEBOOK_COEFS)
ATTRIBUTION = SCORED + ",\n" + TIME_SPLIT.strip() + """,
bgk AS (SELECT plate_no FROM (SELECT plate_no, md5('42' || plate_no) AS h FROM tr ORDER BY h, plate_no LIMIT 100)),
bg AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in _ATTR_NAMES) + """
       FROM feats WHERE plate_no IN (SELECT plate_no FROM bgk)),
attr AS (""" + "\n  UNION ALL\n".join(
    f"  SELECT f.plate_no, {i} AS feature_index, {_q(c)} AS feature, CAST(f.{c} AS DOUBLE) AS value, "
    f"CAST({RULEBOOK_COEFS[c]!r} AS DOUBLE) * (CAST(f.{c} AS DOUBLE) - bg.{c}) AS contribution FROM feats f, bg"
    for i, c in enumerate(_ATTR_NAMES)) + """
)"""

oracle("linear_attribution", "WITH " + ATTRIBUTION.strip() + "\nSELECT * REPLACE (round(contribution, 9) AS contribution) FROM attr")

oracle("attribution_top5", "WITH " + ATTRIBUTION.strip() + """,
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY plate_no ORDER BY abs(contribution) DESC, feature_index) AS INTEGER) AS rank
       FROM attr),
top AS (SELECT * FROM rk WHERE rank <= 5)
SELECT plate_no, feature_index, feature, value, round(contribution, 9) AS contribution, rank,
       CAST(CASE WHEN max(abs(contribution)) OVER (PARTITION BY plate_no) = 0 THEN 0
            ELSE LEAST(100, CAST(round(abs(contribution) * 100 / max(abs(contribution)) OVER (PARTITION BY plate_no)) AS INTEGER)) END AS INTEGER) AS bar_width
FROM top""")

oracle("attribution_summary", "WITH " + ATTRIBUTION.strip() + """
SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs_contribution FROM attr GROUP BY feature
ORDER BY mean_abs_contribution DESC, feature LIMIT 12""")


# ----------------------------------------------------------------------------- step 10: registry and reports

def _prob_sql(b: float, coefs: dict) -> str:
    z = f"CAST({b!r} AS DOUBLE)" + "".join(f" + CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE)" for c, w in coefs.items())
    return f"CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({z})))"


REGISTRY = (SCORED + ",\n" + TIME_SPLIT.strip() + """,
fl AS (SELECT arg_min(target, pos) AS first_label FROM tr),
enc AS (SELECT tr.*, CAST(tr.target != fl.first_label AS INTEGER) AS enc FROM tr, fl),
cnt AS (SELECT count(*) FILTER (WHERE enc = 0) AS n0, count(*) AS n FROM enc),
rr AS (SELECT enc.plate_no, row_number() OVER (PARTITION BY enc.enc ORDER BY enc.pos) - 1 AS r,
              CASE WHEN enc.enc = 0 THEN 0 ELSE cnt.n0 END AS a, CASE WHEN enc.enc = 0 THEN cnt.n0 ELSE cnt.n END AS b
       FROM enc, cnt),
folds AS (SELECT plate_no, CAST(""" + _fold_sql(5) + """ AS INTEGER) AS fold FROM rr),
cand AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT f.plate_no, f.target, t.split, {mid} AS model_id, {_q(alg)} AS algorithm, {_prob_sql(b, coefs)} AS prob "
    f"FROM feats f JOIN tsplit t ON t.plate_no = f.plate_no" for mid, alg, b, coefs in CANDIDATES) + """
),
cf AS (SELECT cand.*, folds.fold FROM cand LEFT JOIN folds ON folds.plate_no = cand.plate_no),
cmx AS (
  SELECT model_id, algorithm, split,
         count(*) FILTER (WHERE target = 1 AND prob >= 0.5) AS tp, count(*) FILTER (WHERE target = 0 AND prob >= 0.5) AS fp,
         count(*) FILTER (WHERE target = 0 AND prob < 0.5) AS tn, count(*) FILTER (WHERE target = 1 AND prob < 0.5) AS fn
  FROM cf GROUP BY model_id, algorithm, split),
rates AS (
  SELECT model_id, algorithm, split, """ + _ratio("tp", "tp + fp") + " AS precision, " + _ratio("tp", "tp + fn")
    + " AS recall, " + _ratio("2 * tp", "2 * tp + fp + fn") + """ AS f1 FROM cmx),
aps AS (SELECT model_id, split, prob, sum(target) AS pos, sum(1 - target) AS neg FROM cf GROUP BY model_id, split, prob),
apc AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY model_id, split ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM aps),
aucs AS (SELECT model_id, split, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                THEN round(sum(pos * (nb + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 4) END AS auc
         FROM apc GROUP BY model_id, split),
cps AS (SELECT model_id, fold, prob, sum(target) AS pos, sum(1 - target) AS neg FROM cf WHERE split = 'train' GROUP BY model_id, fold, prob),
cpc AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY model_id, fold ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM cps),
cvf AS (SELECT model_id, fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
               THEN sum(pos * (nb + 0.5::DOUBLE * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc
        FROM cpc GROUP BY model_id, fold),
cv AS (SELECT model_id, round(avg(auc), 4) AS cv_best_auc FROM cvf GROUP BY model_id),
run AS (SELECT max(rolling_date) AS trained_at, count(*) AS n FROM tr),
reg AS (
  SELECT v.model_id, v.algorithm, v.precision AS valid_precision, v.recall AS valid_recall, v.f1 AS valid_f1, va.auc AS valid_auc,
         cv.cv_best_auc, ta.auc AS test_auc, run.trained_at,
         v.algorithm || '-' || strftime(run.trained_at, '%Y%m%d%H%M%S') AS version,
         CASE """ + " ".join(f"WHEN v.model_id = {mid} THEN 'features={len(coefs)}'" for mid, _, _, coefs in CANDIDATES) + """ END AS params
  FROM rates v JOIN aucs va ON va.model_id = v.model_id AND va.split = 'valid'
  JOIN aucs ta ON ta.model_id = v.model_id AND ta.split = 'test'
  JOIN cv ON cv.model_id = v.model_id, run
  WHERE v.split = 'valid'
),
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY COALESCE(valid_auc, 0) DESC, round(COALESCE(valid_f1, 0), 3) DESC,
                        round(COALESCE(valid_precision, 0), 3) DESC, round(COALESCE(valid_recall, 0), 3) DESC,
                        COALESCE(cv_best_auc, 0) DESC, model_id) AS INTEGER) AS rank
  FROM reg
),
acts AS (
  SELECT model_id, trained_at AS activated_at, 'bootstrap' AS reason
  FROM (SELECT * FROM reg ORDER BY COALESCE(valid_auc, 0) DESC, model_id LIMIT 1)
  UNION ALL
  SELECT model_id, trained_at + INTERVAL 1 DAY, 'manual' FROM ranked WHERE rank = 1
),
active AS (
  SELECT 'scale_defect_classifier' AS name, a.model_id, r.algorithm, r.version, a.activated_at, a.reason,
         'scale_defect_classifier' || ' ' || r.version AS model_label
  FROM (SELECT * FROM acts ORDER BY activated_at DESC, model_id DESC LIMIT 1) a JOIN reg r ON r.model_id = a.model_id
)""")

oracle("metrics_json", "WITH " + REGISTRY.strip() + """
SELECT model_id, algorithm, CASE WHEN model_id % 2 = 0 THEN 'new' ELSE 'old' END AS shape,
       valid_auc, valid_precision, valid_recall, valid_f1, cv_best_auc, test_auc, params FROM reg""")

oracle("model_ranking", "WITH " + REGISTRY.strip() + """
SELECT rank, model_id, algorithm, version, valid_auc AS auc, valid_f1 AS f1, valid_precision AS precision,
       valid_recall AS recall, cv_best_auc, params FROM ranked""")

oracle("active_model", "WITH " + REGISTRY.strip() + "\nSELECT * FROM active")

oracle("dashboard_summary", "WITH " + RULES.strip() + ",\n" + ALERT_STATE.strip() + ",\n" + REGISTRY.strip() + """,
d AS (SELECT CAST(CAST(max(rolling_date) AS DATE) AS TIMESTAMP) AS d FROM coil)
SELECT strftime((SELECT d FROM d), '%Y-%m-%d') AS as_of_date,
       (SELECT count(*) FROM coil, d WHERE rolling_date >= d.d AND rolling_date < d.d + INTERVAL 1 DAY) AS today_plate_count,
       (SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE p.predicted_label) / CAST(count(*) AS DOUBLE) END
        FROM pres p JOIN coil c ON c.plate_no = p.plate_no, d
        WHERE c.rolling_date >= d.d AND c.rolling_date < d.d + INTERVAL 1 DAY) AS today_predicted_defect_rate,
       (SELECT count(*) FROM state WHERE resolved_at IS NULL) AS open_alert_count,
       (SELECT max(model_label) FROM active) AS active_model""", inspection=True)

oracle("event_props", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
       count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS n_without_k, round(avg(value), 6) AS avg_value
FROM events GROUP BY event_type""")

oracle("prediction_report", "WITH " + ATTRIBUTION.strip() + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY plate_no ORDER BY abs(contribution) DESC, feature_index) AS rank FROM attr),
topf AS (SELECT plate_no, string_agg(feature, ',' ORDER BY rank) AS top_features FROM rk WHERE rank <= 5 GROUP BY plate_no),
p1 AS (SELECT p.plate_no, c.rolling_date AS predicted_at, p.predicted_prob, p.predicted_label, 1 AS model_id
       FROM pres p JOIN coil c ON c.plate_no = p.plate_no),
p2 AS (SELECT p1.plate_no, i.inspected_at AS predicted_at, p1.predicted_prob, p1.predicted_label, p1.model_id
       FROM p1 JOIN inspection i ON i.plate_no = p1.plate_no JOIN coil c ON c.plate_no = p1.plate_no
       WHERE i.inspected_at > c.rolling_date),
preds AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plate_no ORDER BY predicted_at DESC, model_id DESC) AS rn
                          FROM preds) WHERE rn = 1),
run AS (SELECT max(rolling_date) AS trained_at FROM tr)
SELECT l.plate_no, l.predicted_at, l.predicted_prob, l.predicted_label,
       'scale_defect_classifier' || ' ' || 'Rulebook-' || strftime(run.trained_at, '%Y%m%d%H%M%S') AS model_version,
       t.top_features
FROM latest l LEFT JOIN topf t ON t.plate_no = l.plate_no, run""", inspection=True)


# ----------------------------------------------------------------------------- step 12: streaming

STREAM_BASE = SERVING_FRAME.replace("""s1 AS (SELECT printf('SPEC%03d', row_number() OVER (ORDER BY spec_long, spec_country, steel_kind)) AS spec_code,
              spec_long, spec_country, steel_kind FROM l1),""", """s1 AS (SELECT printf('SPEC%03d', row_number() OVER (ORDER BY spec_long, spec_country, steel_kind)) AS spec_code,
              spec_long, spec_country, steel_kind FROM (SELECT DISTINCT spec_long, spec_country, steel_kind FROM coil)),""")

STREAM_RULES = """
sfired AS (
  SELECT *, NOT hsb_applied AS r1, COALESCE(rolling_temp >= 1000, false) AS r2,
         COALESCE(fur_soak_temp - rolling_temp < 190, false) AS r3
  FROM serving
),
salerts AS (
  SELECT plate_no, 0 AS rule_pos, 'HSB_NOT_APPLIED' AS rule_code, 'CRITICAL' AS severity,
         '""" + MSG_HSB + """' AS message, rolling_date AS triggered_at FROM sfired WHERE r1
  UNION ALL
  SELECT plate_no, CAST(r1 AS INTEGER), 'ROLLING_TEMP_OVER_1000', 'CRITICAL',
         '""" + MSG_HOT[0] + """' || CAST(rolling_temp AS VARCHAR) || '""" + MSG_HOT[1] + """', rolling_date
  FROM sfired WHERE r2
  UNION ALL
  SELECT plate_no, CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER), 'TEMP_DROP_INSUFFICIENT', 'WARNING',
         '""" + MSG_DROP[0] + """' || CAST(fur_soak_temp - rolling_temp AS VARCHAR) || '""" + MSG_DROP[1] + """', rolling_date
  FROM sfired WHERE r3
)"""

# Every distinct record that arrives, with its outcome: second records come a day later,
# records of unknown plates carry a number of their own.
STREAM_OUTCOME = """
arrived AS (
  SELECT plate_no, rolling_date, hsb_applied, rolling_method, rolling_temp, descaling_count, work_group, 1 AS nth FROM rolling
  UNION ALL
  SELECT plate_no, rolling_date + INTERVAL 1 DAY, hsb_applied, rolling_method, rolling_temp, descaling_count, work_group, 2
  FROM rolling WHERE CAST(substr(plate_no, 5) AS BIGINT) % 13 = 0
  UNION ALL
  SELECT 'NEW_' || substr(plate_no, 5), rolling_date, hsb_applied, rolling_method, rolling_temp, descaling_count, work_group, 0
  FROM rolling WHERE CAST(substr(plate_no, 5) AS BIGINT) % 101 = 0),
judged AS (
  SELECT *, CASE WHEN nth = 0 THEN 'plate_missing' WHEN plate_no NOT IN (SELECT plate_no FROM furnace) THEN 'furnace_record_missing'
                 WHEN nth = 2 THEN 'second_rolling_record' ELSE 'accepted' END AS outcome
  FROM arrived)"""

oracle("stream_dedup", "WITH " + ROLLING.strip() + ",\n" + STREAM_OUTCOME.strip() + """
SELECT * EXCLUDE (outcome, nth) REPLACE (CAST(rolling_temp AS DOUBLE) AS rolling_temp) FROM judged WHERE outcome = 'accepted'""",
       furnace=True)

oracle("stream_ingest_alerts", "WITH " + STREAM_BASE.strip() + ",\n" + STREAM_RULES.strip() + "\nSELECT * FROM salerts",
       furnace=True)

oracle("stream_quarantine", "WITH " + ROLLING.strip() + ",\n" + STREAM_OUTCOME.strip() + """
SELECT plate_no, rolling_date, outcome AS reason FROM judged WHERE outcome <> 'accepted'""", furnace=True)

# The two registered versions (1 is active, 4 scores plates that are inspected again).
_VERSIONS = {mid: (alg, b, coefs) for mid, alg, b, coefs in CANDIDATES if mid in (1, 4)}


def _logit_sql(b: float, coefs: dict) -> str:
    return f"CAST({b!r} AS DOUBLE)" + "".join(f" + CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE)" for c, w in coefs.items())


_STREAM_FEATS = SERVING_FEATURES_SELECT.replace("SELECT plate_no, target,", "SELECT plate_no, rolling_date,").replace(
    "FROM imputed", "FROM simputed")
_ID = """CAST('0x' || substr(md5(plate_no || '|' || CAST(model_version_id AS VARCHAR) || '|' || strftime(predicted_at, '%Y-%m-%d %H:%M:%S')), 1, 15) AS BIGINT)"""
STREAM_LOG = STREAM_BASE + ",\n" + TIME_SPLIT.strip() + """,
sg AS (SELECT steel_kind, rolling_method, median(CASE WHEN rolling_temp > 0 THEN rolling_temp END) AS gm
       FROM serving GROUP BY steel_kind, rolling_method),
sglob AS (SELECT median(CASE WHEN rolling_temp > 0 THEN rolling_temp END) AS m FROM serving),
simputed AS (
  SELECT s.* REPLACE (COALESCE(CAST(CASE WHEN s.rolling_temp > 0 THEN s.rolling_temp END AS DOUBLE), g.gm,
                               (SELECT m FROM sglob)) AS rolling_temp)
  FROM serving s LEFT JOIN sg g ON s.steel_kind = g.steel_kind AND s.rolling_method = g.rolling_method
),
sfeats AS (""" + _STREAM_FEATS + """
),
sbgk AS (SELECT plate_no FROM (SELECT plate_no, md5('42' || plate_no) AS h FROM tr ORDER BY h, plate_no LIMIT 100)),
sbg AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in _VERSIONS[1][2]) + """
        FROM sfeats WHERE plate_no IN (SELECT plate_no FROM sbgk)),
logged0 AS (
  SELECT f.*, 1 AS model_version_id, f.rolling_date AS predicted_at, {z1} AS z FROM sfeats f
  UNION ALL
  SELECT f.*, 4, i.inspected_at, {z4} FROM sfeats f JOIN inspection i ON i.plate_no = f.plate_no AND i.inspected_at > f.rolling_date
),
logged AS (
  SELECT *, {id} AS id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 4) AS predicted_prob,
         1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) >= 0.5 AS predicted_label
  FROM logged0),
contrib AS (
{items}
),
explained AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY prediction_id ORDER BY abs(shap_value) DESC, i) AS INTEGER) AS rank
  FROM contrib QUALIFY rank <= 5)"""
STREAM_LOG = STREAM_LOG.replace("{z1}", _logit_sql(*_VERSIONS[1][1:])).replace("{z4}", _logit_sql(*_VERSIONS[4][1:])).replace(
    "{id}", _ID).replace("{items}", "\n  UNION ALL\n".join(
        f"  SELECT l.id AS prediction_id, {i} AS i, {_q(c)} AS feature_name, CAST(l.{c} AS DOUBLE) AS feature_value, "
        f"CAST({w!r} AS DOUBLE) * (CAST(l.{c} AS DOUBLE) - sbg.{c}) AS shap_value FROM logged l, sbg WHERE model_version_id = {mid}"
        for mid, (_, _, coefs) in _VERSIONS.items() for i, (c, w) in enumerate(coefs.items())))

oracle("stream_predictions", "WITH " + STREAM_LOG.strip() + """
SELECT plate_no, predicted_at, predicted_prob, predicted_label FROM logged WHERE model_version_id = 1""", furnace=True, inspection=True)

oracle("stream_prediction_log", "WITH " + STREAM_LOG.strip() + """
SELECT * EXCLUDE (rolling_date, z) REPLACE (CAST(model_version_id AS BIGINT) AS model_version_id)
FROM logged WHERE model_version_id = 1""", furnace=True, inspection=True)

oracle("stream_explanations", "WITH " + STREAM_LOG.strip() + """
SELECT prediction_id, feature_name, feature_value, round(shap_value, 9) AS shap_value, rank
FROM explained WHERE prediction_id IN (SELECT id FROM logged WHERE model_version_id = 1)""", furnace=True, inspection=True)

oracle("stream_run", "WITH " + STREAM_LOG.strip() + ",\n" + STREAM_RULES.strip() + ",\n" + STREAM_OUTCOME.strip() + """,
na AS (SELECT plate_no, triggered_at, count(*) AS n FROM salerts GROUP BY 1, 2)
SELECT j.plate_no, j.rolling_date, j.outcome, CASE WHEN j.outcome = 'accepted' THEN COALESCE(na.n, 0) ELSE 0 END AS n_alerts,
       l.predicted_label, e.feature_name AS top_feature
FROM judged j LEFT JOIN na ON na.plate_no = j.plate_no AND na.triggered_at = j.rolling_date
LEFT JOIN logged l ON l.plate_no = j.plate_no AND l.predicted_at = j.rolling_date AND l.model_version_id = 1 AND j.outcome = 'accepted'
LEFT JOIN explained e ON e.prediction_id = l.id AND e.rank = 1""", furnace=True, inspection=True)

oracle("latest_logged_prediction", "WITH " + STREAM_LOG.strip() + """,
run AS (SELECT max(rolling_date) AS trained_at FROM tr),
latest AS (SELECT * FROM logged QUALIFY row_number() OVER (PARTITION BY plate_no ORDER BY predicted_at DESC, id DESC) = 1),
feats2 AS (SELECT prediction_id, string_agg(feature_name, ',' ORDER BY rank) AS top_features, round(sum(round(shap_value, 6)), 6) AS top_sum
           FROM explained GROUP BY prediction_id)
SELECT l.plate_no, l.predicted_at, l.predicted_prob, l.predicted_label,
       'scale_defect_classifier ' || CASE model_version_id WHEN 1 THEN 'Rulebook' ELSE 'DropAndParity' END || '-'
         || strftime(run.trained_at, '%Y%m%d%H%M%S') AS model_version, t.top_features, t.top_sum
FROM latest l JOIN feats2 t ON t.prediction_id = l.id, run""", furnace=True, inspection=True)


# ----------------------------------------------------------------------------- sources and sinks

oracle("process_log_csv", "SELECT * FROM coil UNION ALL SELECT * FROM coil")

_BAD_LINE = """CASE WHEN CAST(substr(plate_no, 5) AS BIGINT) % 89 = 0 THEN 'malformed'
     WHEN CAST(substr(plate_no, 5) AS BIGINT) % 47 = 0 THEN 'pt_thick_unparsable'
     WHEN CAST(substr(plate_no, 5) AS BIGINT) % 71 = 0 THEN 'rolling_date_unparsable' END"""
oracle("process_log_accepted", f"SELECT * FROM coil UNION ALL SELECT * FROM coil WHERE ({_BAD_LINE}) IS NULL")
oracle("process_log_rejected", f"SELECT plate_no, {_BAD_LINE} AS reason FROM coil WHERE ({_BAD_LINE}) IS NOT NULL")

oracle("additivity_by_family", "WITH " + DESIGN.strip() + """,
n AS (SELECT count(DISTINCT feature) + (SELECT count(*) FROM levels WHERE n > 1) AS n FROM nums)
SELECT f.family, t.plate_no, CAST((SELECT n FROM n) AS INTEGER) AS n_features, true AS additive
FROM training t, (SELECT unnest(['LogisticRegression', 'DecisionTree', 'RandomForest', 'GradientBoostingA', 'GradientBoostingB', 'SVM'])
                  AS family) f""", furnace=True, inspection=True)

oracle("training_certificates", """
SELECT unnest(['folds are even', 'logistic regression C=0.01: slopes vanish', 'logistic regression C=0.1: slopes vanish',
               'logistic regression C=1: slopes vanish', 'logistic regression C=10: slopes vanish',
               'tree: leaves hold the shares of their rows', 'tree: no split gains more than the chosen one']) AS statement,
       CAST(0 AS BIGINT) AS n_failed""")

oracle("six_families", "WITH " + TRAINING_FRAME.strip() + """,
n AS (SELECT count(*) AS n FROM training)
SELECT f.algorithm, CAST(n.n - 2 * floor(n.n * 0.15::DOUBLE) AS BIGINT) AS train_row_count, true AS valid_sound, true AS test_sound,
       true AS cv_sound, CAST(f.n_params AS INTEGER) AS n_params
FROM n, (SELECT unnest(['LogisticRegression', 'DecisionTree', 'RandomForest', 'GradientBoostingA', 'GradientBoostingB', 'SVM']) AS algorithm,
                unnest([1, 2, 2, 3, 3, 2]) AS n_params) f""", furnace=True, inspection=True)

_K = "CAST(substr(plate_no, 5) AS BIGINT)"
oracle("process_log_multiline", f"""
SELECT * REPLACE (CASE WHEN {_K} % 59 = 0 THEN 'two "' || chr(10) || 'lines, ' || spec_long ELSE spec_long END AS spec_long) FROM coil""")
oracle("process_log_multiline_rejected", f"""
SELECT 'repeated_header' AS reason, count(*) AS n FROM coil WHERE {_K} % 997 = 0 HAVING count(*) > 0""")

oracle("processed_table", "WITH " + ANALYSIS.strip() + "\nSELECT " + ", ".join(
    "round(cooling_rate_proxy, 9) AS cooling_rate_proxy" if c == "cooling_rate_proxy" else c for c in ANALYSIS_COLUMNS)
    + " FROM analysis")

oracle("load_written", "WITH " + LOAD.strip() + """,
w AS (SELECT count(*) FILTER (WHERE load_status = 'written') AS n, count(*) FILTER (WHERE load_status = 'quarantined') AS q FROM outcome),
t AS (
  SELECT unnest(['plate', 'furnace_process', 'rolling_process', 'quality_inspection']) AS table_name, n FROM w
  UNION ALL SELECT 'quarantine', q FROM w
  UNION ALL SELECT 'product_spec', count(*) FROM (SELECT DISTINCT spec_long, spec_country, steel_kind FROM outcome WHERE load_status = 'written'))
SELECT table_name, n AS rows_written, n AS rows_stored FROM t""", furnace=True, raw=True)

_SNAPSHOTS = ["1995-06-17 00:00:00", "1999-01-01 00:00:00"]
oracle("labels_as_of", "WITH " + SERVING_FRAME.strip() + """,
snap AS (SELECT unnest([""" + ", ".join(_q(x) for x in _SNAPSHOTS) + """]) AS as_of),
lab AS (
  SELECT snap.as_of, i.plate_no, i.defect_type FROM snap JOIN inspection i ON i.inspected_at <= CAST(snap.as_of AS TIMESTAMP)
  QUALIFY row_number() OVER (PARTITION BY snap.as_of, i.plate_no ORDER BY i.inspected_at DESC, i.defect_type) = 1)
SELECT lab.as_of, s.plate_no, lab.defect_type, CAST(lab.defect_type = 'Scale' AS INTEGER) AS target
FROM serving s JOIN lab ON lab.plate_no = s.plate_no""", furnace=True, inspection=True)

# The training split of each run: all but the last 2 x floor(0.15 n) rows by time.
oracle("retrained_versions", "WITH " + SERVING_FRAME.strip() + """,
snap AS (SELECT unnest([0, 1]) AS i, unnest([""" + ", ".join(_q(x) for x in _SNAPSHOTS) + """]) AS as_of),
lab AS (
  SELECT DISTINCT snap.i, n.plate_no FROM snap JOIN inspection n ON n.inspected_at <= CAST(snap.as_of AS TIMESTAMP)),
fr AS (
  SELECT lab.i, s.rolling_date, row_number() OVER (PARTITION BY lab.i ORDER BY s.rolling_date, s.plate_no) AS pos,
         count(*) OVER (PARTITION BY lab.i) AS n
  FROM serving s JOIN lab ON lab.plate_no = s.plate_no)
SELECT 'run' || i AS run, 'scale_defect_classifier' AS name, max(rolling_date) AS trained_at, CAST(count(*) AS BIGINT) AS train_row_count,
       'DecisionTree,LogisticRegression' AS algorithms, true AS has_metrics, CAST(i = 0 AS BIGINT) AS n_active
FROM fr WHERE pos <= n - 2 * floor(n * 0.15::DOUBLE) GROUP BY i""", furnace=True, inspection=True)

oracle("model_listing", "WITH " + REGISTRY.strip() + """,
m AS (SELECT model_id, algorithm, run.trained_at + INTERVAL 1 DAY * (model_id % 3) AS trained_at, run.n AS train_row_count FROM reg, run)
SELECT CAST(row_number() OVER (ORDER BY trained_at DESC, model_id DESC) AS INTEGER) AS place, model_id, algorithm, trained_at,
       train_row_count, 0.5::DOUBLE AS threshold FROM m""")

oracle("what_if_active", "WITH " + STREAM_LOG.strip() + ",\n" + SERVING_INPUT.strip().replace("tm_g", "wi_g") + """,
run AS (SELECT max(rolling_date) AS trained_at FROM tr),
grid AS (
  SELECT s.* REPLACE (CAST(t.scenario_temp AS DOUBLE) AS rolling_temp), t.scenario_temp
  FROM serving_input s, (VALUES (850), (900), (950), (1000), (1050)) AS t(scenario_temp)
),
gf AS (""" + _GRID_FEATS + """
),
gs AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(""" + _logit_sql(*_VERSIONS[1][1:]) + """))) AS prob FROM gf),
gc AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT plate_no, scenario_temp, {i} AS i, {_q(c)} AS feature, CAST({w!r} AS DOUBLE) * (CAST(gf.{c} AS DOUBLE) - sbg.{c}) AS v FROM gf, sbg"
    for i, (c, w) in enumerate(_VERSIONS[1][2].items())) + """
),
gr AS (SELECT *, row_number() OVER (PARTITION BY plate_no, scenario_temp ORDER BY abs(v) DESC, i) AS rank FROM gc),
gt AS (SELECT plate_no, scenario_temp, string_agg(feature, ',' ORDER BY rank) AS top_features FROM gr WHERE rank <= 3 GROUP BY 1, 2)
SELECT gs.plate_no, CAST(gs.scenario_temp AS INTEGER) AS scenario_temp, round(prob, 4) AS predicted_prob, prob >= 0.5 AS predicted_label,
       'scale_defect_classifier Rulebook-' || strftime(run.trained_at, '%Y%m%d%H%M%S') AS model_version,
       """ + RULE_CODES_OF + """ AS fired_rules, gt.top_features
FROM gs JOIN gt ON gt.plate_no = gs.plate_no AND gt.scenario_temp = gs.scenario_temp, run""", furnace=True, inspection=True)

oracle("stream_inspections", """
SELECT i.plate_no, i.defect_type, i.inspected_at,
       'engineer' || CAST(TRY_CAST(NULLIF(regexp_extract(c.work_group, '^(\\d+)', 1), '') AS INTEGER) AS VARCHAR) || '@plant.local' AS inspector_email,
       CAST(TRY_CAST(NULLIF(regexp_extract(c.work_group, '^(\\d+)', 1), '') AS INTEGER) AS BIGINT) AS user_id
FROM inspection i JOIN coil c ON c.plate_no = i.plate_no""", inspection=True)

oracle("scored_csv_export", "WITH " + SCORED.strip() + """
SELECT plate_no, predicted_prob, predicted_label, """ + RULE_CODES_OF + """ AS fired_rules, actual_label,
       actual_label = predicted_label AS correct
FROM pres""")

oracle("latest_per_plate", "WITH " + LATEST_FURNACE.strip() + """
SELECT plate_no, recorded_at, fur_no, fur_input_row, fur_heat_temp, fur_heat_time, fur_soak_temp, fur_soak_time, fur_total_time
FROM lf""", furnace=True)

oracle("defect_rate_by", "\nUNION ALL\n".join(
    f"SELECT {_q(d)} AS dimension, {d} AS value, count(*) AS n, "
    f"CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS BIGINT) AS n_defect, "
    f"CAST(sum(CASE WHEN scale = '불량' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM coil GROUP BY {d}"
    for d in ["hsb", "steel_kind", "rolling_method", "work_group"]))
