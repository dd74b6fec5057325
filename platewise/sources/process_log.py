"""Flat process-log files (legacy CSV) and table sinks.

Encoding: a legacy file is cp949 or UTF-8.  The published reader tries cp949 first and
falls back to UTF-8 on a decode error; here a file that is valid UTF-8 throughout is read as
UTF-8 and any other as cp949, since a UTF-8 file can also decode as cp949 by accident.
Encoding and header of each file are a small side table that the lines are joined to.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions import tokens as TK
from platewise.functions import vocab as V
from platewise.operators.lookup import settled

INT_COLUMNS = ["pt_thick", "pt_width", "pt_length", "fur_heat_temp", "fur_heat_time", "fur_soak_temp",
               "fur_soak_time", "fur_total_time", "rolling_temp", "descaling_count"]


def missing_columns(columns: list[str], required: list[str] = V.REQUIRED_COLUMNS) -> list[str]:
    """Required columns absent from a header, sorted."""
    return sorted(set(required) - set(columns))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"))


def _quotes(c: str) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit('"')))


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, header, unclosed) of each file, one pass over the text, combined
    map-side: a file with a line that is not valid UTF-8 is cp949, its first line is the
    header; an odd number of quotes leaves the last record unclosed."""
    per_file = _lines(spark, path).groupBy("file").agg(
        F.max(~F.is_valid_utf8("value")).alias("legacy"), F.min_by("value", F.struct("split", "line")).alias("header"),
        (F.sum(_quotes("value")) % 2 == 1).alias("unclosed"))
    encoding = F.when(F.col("legacy"), "cp949").otherwise("UTF-8")
    return per_file.select("file", encoding.alias("encoding"), _decoded("header", encoding).alias("header"), "unclosed")


def _decoded(c: str, encoding: Column) -> Column:
    return F.when(encoding == "cp949", F.decode(F.col(c).cast("binary"), "cp949")).otherwise(F.col(c))


def _records(spark: SparkSession, path: str, layouts: DataFrame) -> DataFrame:
    """(value, file, split, line, open): the records of the files, which may span lines and
    file splits.  A line break inside quotes belongs to the record, so the number of quotes
    before a line decides whether it begins one: that number's parity is summed up per
    split, combined over the splits of a file, and counted line by line only in splits that
    have an odd line or begin inside quotes; all other lines are records as they are and
    aren't shuffled.  ``open`` marks the lines of a last record whose quotes never close."""
    lines = _lines(spark, path)
    odd = _quotes("value") % 2
    splits = lines.groupBy("file", "split").agg(F.sum(odd).alias("odd"))
    # one row per file split
    before = F.coalesce(F.sum("odd").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = settled(splits.withColumn("inside", before % 2)).filter("odd > 0 or inside > 0").select("file", "split", "inside")
    simple = lines.join(splits, ["file", "split"], "left_anti").select("value", "file", "split", "line", F.lit(False).alias("open"))

    order = Window.partitionBy("file", "split").orderBy("line")     # the lines of one file split
    counted = lines.join(splits, ["file", "split"]).withColumn("odd", odd)
    state = F.col("inside") + F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("begins", (state % 2 == 0).cast("int")).withColumn("leaves", (state + F.col("odd")) % 2)
    counted = settled(counted.withColumn("nth", F.sum("begins").over(order)).drop("inside", "odd"))
    # a split's first lines may belong to the last record of the one before
    starts = counted.groupBy("file", "split").agg(F.sum("begins").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counted.join(settled(starts.select("file", "split", offset.alias("offset"))), ["file", "split"]).join(
        layouts.select("file", "unclosed"), "file").withColumn("record", F.col("offset") + F.col("nth"))
    last = settled(numbered.groupBy("file").agg(F.max("record").alias("last")))
    numbered = numbered.join(last, "file").withColumn("open", F.col("unclosed") & (F.col("record") == F.col("last")))
    whole = (F.col("begins") == 1) & (F.col("leaves") == 0) | F.col("open")
    single = numbered.filter(whole).select("value", "file", "split", "line", "open")
    # the lines of one record
    joined = numbered.filter(~whole).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("x")).select(
        F.array_join("x.value", "\n").alias("value"), "file", F.col("x")[0]["split"].alias("split"), F.col("x")[0]["line"].alias("line"),
        F.lit(False).alias("open"))
    return simple.unionByName(single).unionByName(joined)


def parsed_lines(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """Every data record of the files with its text columns, ``__line``, ``__file`` and
    ``__reason`` (NULL when sound).  Columns are found by the names in each file's own
    header.  A record with too few or too many fields is 'malformed', a non-empty number
    that doesn't parse '<column>_unparsable', likewise the date; a header line that comes again
    is 'repeated_header', a line of a record whose quotes never close 'unclosed_quote'.
    Raises ValueError with the missing columns (sorted) if any file lacks a required one
    (S11).  The driver sees the distinct headers only."""
    layouts = settled(file_layouts(spark, path))
    if encoding != "auto":
        layouts = layouts.withColumn("encoding", F.lit(encoding))
    headers = [r["header"] for r in layouts.select("header").distinct().orderBy("header").collect()]
    if not headers:
        raise ValueError(f"no files under {path}")
    names = {h: [c.strip() for c in next(csv.reader([h]))] for h in headers}
    missing = sorted({c for cols in names.values() for c in missing_columns(cols)})
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    every = list(dict.fromkeys(c for cols in names.values() for c in cols))
    lines = _records(spark, path, layouts).join(layouts.drop("unclosed"), "file").select(
        "file", "header", "open", _decoded("value", F.col("encoding")).alias("line"))
    is_header = F.col("line") == F.col("header")
    # one of the lines equal to a file's header is the header
    again = lines.filter(is_header).groupBy("file", "header", "line").agg(F.count(F.lit(1)).alias("n")).select(
        "file", "header", F.lit(False).alias("open"), "line", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).filter(
        "nth > 1").drop("nth")
    lines = lines.filter(~is_header & (F.trim("line") != "")).unionByName(again)
    # The lambda's argument and the generator keep it at one parse a line: as a plain column
    # the parse would be copied into every use of a field and into pushed-down filters.
    def by_name(cols: list[str]):
        return lambda p: F.struct(
            *[(p[f"c{cols.index(c)}"] if c in cols else F.lit(None).cast("string")).alias(c) for c in every],
            p["bad"].isNotNull().alias("__malformed"))

    record = None
    for h, cols in names.items():
        schema = ", ".join([*[f"c{i} string" for i in range(len(cols))], "bad string"])
        fields = F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "escape": '"'})
        row = F.transform(F.array(fields), by_name(cols))
        record = F.when(F.col("header") == h, row) if record is None else record.when(F.col("header") == h, row)
    out = lines.select(F.col("file").alias("__file"), F.col("line").alias("__line"), F.col("open").alias("__open"),
                       (F.col("line") == F.col("header")).alias("__again"), F.inline(record))
    reason = F.when(F.col("__open"), "unclosed_quote").when(F.col("__again"), "repeated_header").when(F.col("__malformed"), "malformed")
    for c in INT_COLUMNS:
        reason = reason.when(F.col(c).isNotNull() & TK.truncating_int(c).isNull(), f"{c}_unparsable")
    reason = reason.when(F.col("rolling_date").isNotNull() & TK.parse_rolling_date("rolling_date").isNull(),
                         "rolling_date_unparsable")
    return out.withColumn("__reason", reason).drop("__malformed", "__open", "__again")


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files that a glob names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sum(f.getLen() for f in files or [])


def read_process_log(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """The sound lines of flat process-log CSV files in typed columns; the others
    are in :func:`rejected_lines`.

    Text stays text (tokens are parsed downstream), numbers become integers and
    ``rolling_date`` is parsed with the legacy pattern into TIMESTAMP_NTZ.  Columns go
    by name, also where files differ in order; a column that only some files have is
    NULL for the others.
    """
    return typed_records(parsed_lines(spark, path, encoding))


def typed_records(parsed: DataFrame) -> DataFrame:
    """The sound records of :func:`parsed_lines` in typed columns."""
    raw = parsed.filter(F.col("__reason").isNull()).drop("__file", "__line", "__reason")

    def typed(c: str) -> Column:
        if c in INT_COLUMNS:
            return TK.truncating_int(c).alias(c)
        return TK.parse_rolling_date(c).alias(c) if c == "rolling_date" else F.col(c)
    return raw.select(*[typed(c) for c in raw.columns])


def rejected_lines(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """S8 quarantine: (file, line, reason) of the lines that :func:`read_process_log` leaves out."""
    return parsed_lines(spark, path, encoding).filter(F.col("__reason").isNotNull()).select(
        F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__reason").alias("reason"))


def to_legacy_text(df: DataFrame) -> DataFrame:
    """Inverse formatting for export: rolling_date as '03JAN2008:07:07:53'."""
    return df.withColumn("rolling_date", F.upper(F.date_format("rolling_date", V.ROLLING_DATE_FORMAT)))


def write_process_log(df: DataFrame, path: str, encoding: str = "cp949") -> None:
    """Write a flat log in the legacy CSV layout (header, legacy date text)."""
    to_legacy_text(df).write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3: the processed feature table (parquet by default; CSV export with header)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_scored(df: DataFrame, path: str, rules_col: str = "fired_rules") -> None:
    """Scored rows with the fired rule codes joined by ';' as CSV."""
    out = df
    if rules_col in df.columns and isinstance(df.schema[rules_col].dataType, T.ArrayType):
        elem = df.schema[rules_col].dataType.elementType
        codes = F.transform(rules_col, lambda r: r["rule_code"]) if isinstance(elem, T.StructType) else F.col(rules_col)
        out = df.withColumn(rules_col, F.concat_ws(";", codes))
    out.write.mode("overwrite").option("header", True).csv(path)


# ----------------------------------------------------------------------------- S6: table definitions

def _s(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


TS, STR, INT, LONG, BOOL, DBL = T.TimestampNTZType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()

TABLE_SCHEMAS = {
    "users": T.StructType([_s("id", LONG, False), _s("name", STR, False), _s("email", STR, False), _s("role", STR, False),
                           _s("work_group", STR), _s("created_at", TS)]),
    "product_spec": T.StructType([_s("spec_code", STR, False), _s("spec_long", STR, False), _s("spec_country", STR, False),
                                  _s("steel_kind", STR, False)]),
    "plate": T.StructType([_s("plate_no", STR, False), _s("spec_code", STR, False), _s("pt_thick", INT, False),
                           _s("pt_width", INT, False), _s("pt_length", INT, False), _s("created_at", TS)]),
    "furnace_process": T.StructType([_s("id", LONG), _s("plate_no", STR, False), _s("fur_no", INT), _s("fur_input_row", INT),
                                     _s("fur_heat_temp", INT), _s("fur_heat_time", INT), _s("fur_soak_temp", INT),
                                     _s("fur_soak_time", INT), _s("fur_total_time", INT), _s("recorded_at", TS, False)]),
    "rolling_process": T.StructType([_s("id", LONG), _s("plate_no", STR, False), _s("hsb_applied", BOOL, False),
                                     _s("rolling_method", STR, False), _s("rolling_temp", INT), _s("descaling_count", INT, False),
                                     _s("work_group", STR, False), _s("rolling_date", TS, False), _s("recorded_at", TS)]),
    "quality_inspection": T.StructType([_s("id", LONG), _s("plate_no", STR, False), _s("defect_type", STR, False),
                                        _s("inspector_id", LONG), _s("inspected_at", TS, False), _s("note", STR)]),
    "model_version": T.StructType([_s("id", LONG, False), _s("name", STR, False), _s("version", STR, False),
                                   _s("algorithm", STR, False), _s("trained_at", TS, False), _s("train_row_count", INT),
                                   _s("metrics", STR), _s("threshold", T.DecimalType(4, 3)), _s("artifact_path", STR),
                                   _s("created_at", TS)]),
    "model_activation": T.StructType([_s("name", STR, False), _s("model_id", LONG, False), _s("activated_at", TS, False),
                                      _s("reason", STR)]),
    "prediction": T.StructType([_s("id", LONG), _s("plate_no", STR, False), _s("model_version_id", LONG, False),
                                _s("predicted_prob", T.DecimalType(5, 4), False), _s("predicted_label", BOOL, False),
                                _s("feature_snapshot", STR), _s("predicted_at", TS, False)]),
    "shap_explanation": T.StructType([_s("prediction_id", LONG, False), _s("feature_name", STR, False),
                                      _s("feature_value", DBL), _s("shap_value", DBL, False), _s("rank", INT, False)]),
    "alert": T.StructType([_s("plate_no", STR, False), _s("rule_pos", INT, False), _s("rule_code", STR, False),
                           _s("severity", STR, False), _s("message", STR, False), _s("triggered_at", TS, False)]),
    "alert_resolution": T.StructType([_s("plate_no", STR, False), _s("rule_pos", INT, False), _s("resolver_email", STR, False),
                                      _s("requested_at", TS, False)]),
}


def create_tables(spark: SparkSession, root: str, only_missing: bool = True) -> list[str]:
    """Empty parquet tables with explicit schemas (state changes are append-only
    logs: model_activation and alert_resolution replace in-place updates)."""
    from platewise.session import path_exists

    made = []
    for name, schema in TABLE_SCHEMAS.items():
        path = f"{root.rstrip('/')}/{name}"
        if only_missing and path_exists(spark, path):
            continue
        spark.createDataFrame([], schema).write.mode("errorifexists" if only_missing else "overwrite").parquet(path)
        made.append(name)
    return made


# ----------------------------------------------------------------------------- S7: database connector

def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Read a database table; with a numeric partition column the read is split into
    parallel range queries.  The JDBC driver jar is supplied by the deployment."""
    props = dict(properties or {})
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None) -> None:
    df.write.jdbc(url, table, mode=mode, properties=dict(properties or {}))
