"""SQL text of the plate-process views, runnable unchanged by DuckDB and Spark SQL.

The oracles for every registered query start from these common table expressions so
that the Spark operators and the SQL read identical rows.
"""

COIL_SQL = """
SELECT plate_no, spec_long, spec_country, steel_kind, pt_thick, pt_width, pt_length, hsb,
       fur_no, fur_input_row, fur_heat_temp, fur_heat_time, fur_soak_temp, fur_soak_time, fur_total_time,
       rolling_method, rolling_temp, descaling_count, work_group, rolling_date,
       CASE WHEN hsb = '미적용' OR rolling_temp >= 1000
                 OR (fur_soak_temp - rolling_temp < 190 AND k % 3 = 0 AND rolling_temp > 0)
            THEN '불량' ELSE '양품' END AS scale
FROM (
  SELECT o_orderkey AS k,
    concat('PLT_', CAST(o_orderkey AS STRING)) AS plate_no,
    o_orderpriority AS spec_long,
    concat('C', CAST(c_nationkey % 7 AS STRING)) AS spec_country,
    CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE 'T' END AS steel_kind,
    CAST(10 + 5 * (o_orderkey * 7 % 15) AS INT) AS pt_thick,
    CAST(1500 + o_custkey * 37 % 3000 AS INT) AS pt_width,
    CAST(8000 + o_orderkey * 131 % 40000 AS INT) AS pt_length,
    CASE WHEN o_orderkey * 11 % 21 = 0 THEN '미적용' ELSE '적용' END AS hsb,
    concat(CAST(1 + o_orderkey % 3 AS STRING), '호기') AS fur_no,
    concat(CAST(1 + o_custkey % 2 AS STRING), '열') AS fur_input_row,
    CAST(1120 + o_custkey * 13 % 60 AS INT) AS fur_heat_temp,
    CAST(60 + o_orderkey * 5 % 70 AS INT) AS fur_heat_time,
    CAST(1110 + o_orderkey * 17 % 60 AS INT) AS fur_soak_temp,
    CAST(40 + o_custkey * 3 % 50 AS INT) AS fur_soak_time,
    CAST(CASE WHEN o_orderkey % 501 = 0 THEN 0 ELSE 200 + o_orderkey * 23 % 120 END AS INT) AS fur_total_time,
    CASE WHEN o_orderkey % 4 = 0 THEN 'CR(제어압연)' ELSE 'TMCP(온도제어)' END AS rolling_method,
    CAST(CASE WHEN o_orderkey * 19 % 167 = 0 THEN 0 ELSE 800 + o_orderkey * 29 % 251 - 20 * (o_orderkey % 3) - 7 * (o_orderkey % 4) END AS INT) AS rolling_temp,
    CAST(4 + o_orderkey * 3 % 7 AS INT) AS descaling_count,
    concat(CAST(1 + o_custkey % 4 AS STRING), '조') AS work_group,
    o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440) AS rolling_date
  FROM orders JOIN customer ON c_custkey = o_custkey
) s
"""

FURNACE_SQL = """
SELECT concat('PLT_', CAST(l_orderkey AS STRING)) AS plate_no, l_shipdate AS recorded_at, l_linenumber AS seq,
       l_partkey, l_suppkey, l_extendedprice,
       CAST(1 + l_suppkey % 3 AS INT) AS fur_no, CAST(1 + l_partkey % 2 AS INT) AS fur_input_row,
       CAST(1120 + l_partkey % 60 AS INT) AS fur_heat_temp, CAST(60 + l_suppkey % 70 AS INT) AS fur_heat_time,
       CAST(1110 + l_partkey * 7 % 60 AS INT) AS fur_soak_temp, CAST(40 + l_suppkey * 3 % 50 AS INT) AS fur_soak_time,
       CAST(200 + l_partkey * 3 % 120 AS INT) AS fur_total_time
FROM lineitem
"""

INSPECTION_SQL = """
SELECT plate_no, CASE WHEN scale = '불량' THEN 'Scale' ELSE '없음' END AS defect_type, rolling_date AS inspected_at FROM coil
UNION ALL
SELECT plate_no, CASE WHEN scale = '불량' THEN '없음' ELSE 'Scratch' END, rolling_date + INTERVAL '1' DAY
FROM coil WHERE CAST(substr(plate_no, 5) AS BIGINT) % 13 = 0
"""


# The flat log with faults, over the sound one (``sound``).
RAW_SQL = """
SELECT CASE WHEN k % 211 = 0 THEN NULL ELSE plate_no END AS plate_no,
       CASE WHEN k % 89 = 0 AND rolling_date >= TIMESTAMP '1996-01-01' THEN 'NEW-STEEL' ELSE spec_long END AS spec_long,
       spec_country, CASE WHEN k % 43 = 0 THEN 'Z' ELSE steel_kind END AS steel_kind,
       CASE WHEN k % 47 = 0 THEN 0 WHEN k % 107 = 0 THEN 900 ELSE pt_thick END AS pt_thick,
       CASE WHEN k % 53 = 0 THEN NULL ELSE pt_width END AS pt_width,
       CASE WHEN k % 59 = 0 THEN -1 ELSE pt_length END AS pt_length,
       CASE WHEN k % 73 = 0 THEN NULL ELSE hsb END AS hsb,
       CASE WHEN k % 41 = 0 THEN 'unit' ELSE fur_no END AS fur_no,
       CASE WHEN k % 67 = 0 THEN NULL ELSE fur_input_row END AS fur_input_row,
       CASE WHEN k % 97 = 0 THEN 2000 ELSE fur_heat_temp END AS fur_heat_temp, fur_heat_time,
       CASE WHEN k % 103 = 0 THEN 300 ELSE fur_soak_temp END AS fur_soak_temp, fur_soak_time, fur_total_time,
       CASE WHEN k % 113 = 0 THEN NULL WHEN k % 37 = 0 THEN 'AC' ELSE rolling_method END AS rolling_method,
       CASE WHEN k % 109 = 0 THEN 1900 WHEN k % 101 = 0 THEN NULL ELSE rolling_temp END AS rolling_temp,
       CASE WHEN k % 61 = 0 THEN -1 ELSE descaling_count END AS descaling_count,
       CASE WHEN k % 79 = 0 THEN NULL ELSE work_group END AS work_group,
       CASE WHEN k % 71 = 0 THEN NULL ELSE rolling_date + INTERVAL '1' DAY * copy END AS rolling_date, scale
FROM (SELECT *, CAST(substr(plate_no, 5) AS BIGINT) AS k FROM sound) s, (SELECT 0 AS copy UNION ALL SELECT 1) c
WHERE copy = 0 OR k % 29 = 0
"""


def with_views(body: str, furnace: bool = False, inspection: bool = False, raw: bool = False) -> str:
    """Prefix ``body`` with the view CTEs it needs (coil always; with ``raw`` coil is the
    log with faults)."""
    ctes = [f"sound AS ({COIL_SQL})", f"coil AS ({RAW_SQL})"] if raw else [f"coil AS ({COIL_SQL})"]
    if furnace:
        ctes.append(f"furnace AS ({FURNACE_SQL})")
    if inspection:
        ctes.append(f"inspection AS ({INSPECTION_SQL})")
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
