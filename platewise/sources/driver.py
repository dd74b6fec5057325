"""Driver tables (one parquet file per table) and the plate-process views over them.

The driver tables hold orders, customers and line items, not plates.  The ``coil``
view maps them one-to-one onto the flat process log (one row per plate, the 21
columns of the legacy CSV); ``furnace_history`` maps line items onto furnace records
(many per plate) and ``inspection_history`` yields inspection labels (one or two per
plate).  The same mapping exists as SQL text in :mod:`platewise.plans.oracle`, so
every query and its DuckDB oracle read identical rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import vocab as V

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c: Column) -> Column:
    return c.cast("string")


def coil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat process log, one row per plate (orders joined to their customer).

    The orders-customer join is a plain equi-join: customer grows with the data, so
    the planner (AQE) picks broadcast only when the measured size allows it.
    """
    return coil_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream (the glob keeps the single file a valid source)."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def coil_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The coil mapping over any orders frame (batch or stream) and a customer table."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey")
    s = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    temp = F.when((k * 19) % 167 == 0, F.lit(0)).otherwise(
        800 + (k * 29) % 251 - 20 * (k % 3) - 7 * (k % 4))
    total = F.when(k % 501 == 0, F.lit(0)).otherwise(200 + (k * 23) % 120)
    mapped = s.select(
        k.alias("k"),
        F.concat(F.lit("PLT_"), _s(k)).alias("plate_no"),
        F.col("o_orderpriority").alias("spec_long"),
        F.concat(F.lit("C"), _s(F.col("c_nationkey") % 7)).alias("spec_country"),
        F.when(k % 3 == 0, "C").otherwise("T").alias("steel_kind"),
        (10 + 5 * ((k * 7) % 15)).cast("int").alias("pt_thick"),
        (1500 + (ck * 37) % 3000).cast("int").alias("pt_width"),
        (8000 + (k * 131) % 40000).cast("int").alias("pt_length"),
        F.when((k * 11) % 21 == 0, V.HSB_OFF).otherwise(V.HSB_ON).alias("hsb"),
        F.concat(_s(1 + k % 3), F.lit(V.FURNACE_SUFFIX)).alias("fur_no"),
        F.concat(_s(1 + ck % 2), F.lit(V.ROW_SUFFIX)).alias("fur_input_row"),
        (1120 + (ck * 13) % 60).cast("int").alias("fur_heat_temp"),
        (60 + (k * 5) % 70).cast("int").alias("fur_heat_time"),
        (1110 + (k * 17) % 60).cast("int").alias("fur_soak_temp"),
        (40 + (ck * 3) % 50).cast("int").alias("fur_soak_time"),
        total.cast("int").alias("fur_total_time"),
        F.when(k % 4 == 0, "CR(제어압연)").otherwise("TMCP(온도제어)").alias("rolling_method"),
        temp.cast("int").alias("rolling_temp"),
        (4 + (k * 3) % 7).cast("int").alias("descaling_count"),
        F.concat(_s(1 + ck % 4), F.lit(V.GROUP_SUFFIX)).alias("work_group"),
        F.timestamp_add("MINUTE", k % 1440, F.col("o_orderdate")).alias("rolling_date"),
    )
    t = F.col("rolling_temp")
    defect = ((F.col("hsb") == V.HSB_OFF) | (t >= 1000)
              | ((F.col("fur_soak_temp") - t < 190) & (F.col("k") % 3 == 0) & (t > 0)))
    return mapped.withColumn(
        "scale", F.when(defect, V.SCALE_DEFECT).otherwise(V.SCALE_GOOD)
    ).drop("k")


def raw_coil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat log as a plant would send it: NULLs, unparsable tokens, values outside
    their domain, outliers, spec combinations that come up later, and every 29th plate
    sent a second time a day later."""
    k = F.substring("plate_no", 5, 1 << 30).cast("bigint")

    def faulty(c: str, *faults: tuple[int, object]) -> Column:
        out = F.col(c)
        for every, value in faults:
            out = F.when(F.col("k") % every == 0, F.lit(value)).otherwise(out)
        return out.alias(c)

    copies = F.when(F.col("k") % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = coil(spark, sf_dir).withColumn("k", k).withColumn("copy", F.explode(copies))
    new_spec = (F.col("k") % 89 == 0) & (F.col("rolling_date") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return c.select(
        faulty("plate_no", (211, None)), F.when(new_spec, "NEW-STEEL").otherwise(F.col("spec_long")).alias("spec_long"),
        "spec_country", faulty("steel_kind", (43, "Z")), faulty("pt_thick", (107, 900), (47, 0)),
        faulty("pt_width", (53, None)), faulty("pt_length", (59, -1)), faulty("hsb", (73, None)),
        faulty("fur_no", (41, "unit")), faulty("fur_input_row", (67, None)), faulty("fur_heat_temp", (97, 2000)),
        "fur_heat_time", faulty("fur_soak_temp", (103, 300)), "fur_soak_time", "fur_total_time",
        faulty("rolling_method", (37, "AC"), (113, None)), faulty("rolling_temp", (101, None), (109, 1900)),
        faulty("descaling_count", (61, -1)), faulty("work_group", (79, None)),
        F.when(F.col("k") % 71 == 0, F.lit(None)).otherwise(
            F.timestamp_add("DAY", F.col("copy"), F.col("rolling_date"))).alias("rolling_date"), "scale")


def furnace_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furnace records: one per line item, many per plate (latest wins downstream)."""
    li = table(spark, sf_dir, "lineitem")
    p, sp = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.concat(F.lit("PLT_"), _s(F.col("l_orderkey"))).alias("plate_no"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_linenumber").alias("seq"),
        "l_partkey", "l_suppkey", "l_extendedprice",
        (1 + sp % 3).cast("int").alias("fur_no"),
        (1 + p % 2).cast("int").alias("fur_input_row"),
        (1120 + p % 60).cast("int").alias("fur_heat_temp"),
        (60 + sp % 70).cast("int").alias("fur_heat_time"),
        (1110 + (p * 7) % 60).cast("int").alias("fur_soak_temp"),
        (40 + (sp * 3) % 50).cast("int").alias("fur_soak_time"),
        (200 + (p * 3) % 120).cast("int").alias("fur_total_time"),
    )


def inspection_history(coil_df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Inspection labels: a first verdict for every plate, a later different one for
    every 13th plate (so 'latest inspection' really changes the label).  Both come from
    ONE pass over the flat log (an explode of a one- or two-element array); ``extra``
    columns of the flat log are carried along."""
    defect = F.col("scale") == V.SCALE_DEFECT
    first = F.struct(F.when(defect, V.DEFECT_SCALE).otherwise(V.DEFECT_NONE).alias("defect_type"),
                     F.col("rolling_date").alias("inspected_at"))
    later = F.when(F.substring("plate_no", 5, 1 << 30).cast("bigint") % 13 == 0, F.struct(
        F.when(defect, V.DEFECT_NONE).otherwise("Scratch").alias("defect_type"),
        F.timestamp_add("DAY", F.lit(1), F.col("rolling_date")).alias("inspected_at")))
    extra = extra or []
    return (coil_df.select("plate_no", *extra, F.explode(F.array_compact(F.array(first, later))).alias("i"))
                   .select("plate_no", "i.defect_type", "i.inspected_at", *extra))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
