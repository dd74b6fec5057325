"""Structured Streaming ingestion of rolling records and inspection labels.

E1: arriving rolling records -> flags from one key table (plate known, furnace record known)
-> keyed state (:mod:`platewise.streaming.gate`): a record sent again is dropped, the first
sound record of a plate is accepted, all others get a reason -> NULL sentinel -> rules on
the raw reading -> alerts; the active model's bundle imputes, scores and explains -> logged
predictions with their feature snapshot and five strongest contributions.  A micro-batch's
five tables become visible together (:mod:`platewise.streaming.outputs`), and nothing that
was stored before is read again.

E2: arriving inspection labels -> plate and inspector must exist, else quarantine with a
reason -> appended; the next training run picks the latest label per plate (W2).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators import bundle as BU
from platewise.operators import latest as LT
from platewise.operators import registry as RG
from platewise.operators import rules as RU
from platewise.operators.lookup import settled
from platewise.session import ensure_checkpoint_dir
from platewise.sources.process_log import TABLE_SCHEMAS
from platewise.streaming import gate as GA
from platewise.streaming.outputs import BatchOutputs

ROLLING_STREAM_COLUMNS = ["plate_no", "hsb_applied", "rolling_method", "rolling_temp", "descaling_count",
                          "work_group", "rolling_date"]
ROLLING_SCHEMA = T.StructType([TABLE_SCHEMAS["rolling_process"][c] for c in ROLLING_STREAM_COLUMNS])
STREAM_TABLES = {
    "rolling": ROLLING_SCHEMA,
    "quarantine": T.StructType([*ROLLING_SCHEMA, T.StructField("reason", T.StringType())]),
    "alerts": TABLE_SCHEMAS["alert"],
    "predictions": TABLE_SCHEMAS["prediction"],
    "explanations": TABLE_SCHEMAS["shap_explanation"],
}

MICRO_BATCHES = 8  # of a backlog that is read to its end


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def plate_facts(plates: DataFrame, specs: DataFrame, latest_furnace: DataFrame) -> DataFrame:
    """Plate + spec + latest furnace record: everything static that a rolling record needs, in
    one table, so a micro-batch joins once.  To be stored before the stream starts."""
    p = plates.join(specs.select("spec_code", "spec_country", "steel_kind"), "spec_code").select(
        "plate_no", "pt_thick", "pt_width", "pt_length", "spec_country", "steel_kind")
    return p.join(latest_furnace.select("plate_no", *LT.FURNACE_COLS), "plate_no")


def enrich(accepted: DataFrame, facts: DataFrame) -> DataFrame:
    """Rolling record + :func:`plate_facts`, raw temperature NULLed, rules on the raw reading."""
    rows = accepted.join(facts, "plate_no").withColumn(
        "rolling_temp", F.when(F.col("rolling_temp") > 0, F.col("rolling_temp")))
    return RU.rule_hits(rows, temp_col="rolling_temp")


def active_bundle(spark: SparkSession, registry: str) -> Callable[[], tuple[int, dict] | None]:
    """Looks up the active version of the stored registry at every call, so an activation
    takes effect with the next micro-batch; a bundle is loaded once."""
    loaded: dict[str, dict] = {}

    def look_up() -> tuple[int, dict] | None:
        active = RG.active_version(spark, registry)
        if active is None:
            return None
        if active["artifact_path"] not in loaded:
            loaded[active["artifact_path"]] = BU.load(spark, active["artifact_path"])
        return active["id"], loaded[active["artifact_path"]]

    return look_up


def predictions_of(rows: DataFrame, model_id: int, bundle: dict, at: str = "rolling_date") -> tuple[DataFrame, DataFrame]:
    """(prediction, shap_explanation) rows for enriched records."""
    feats = BU.features_for(rows.withColumn("__at", F.col(at)), bundle, ["plate_no", "__at"])
    return BU.log_rows(BU.scored(feats, bundle), model_id, "__at")


def start_rolling_ingest(stream: DataFrame, plates: DataFrame, specs: DataFrame, furnace: DataFrame,
                         rolling_history: DataFrame | None, registry: str | None, out_root: str,
                         trigger_available_now: bool = True):
    """Start E1; returns the StreamingQuery.  The tables of ``STREAM_TABLES`` are read back by
    :func:`stream_table`.  ``registry``: root of the stored registry whose active version
    scores; without one (or without an active version) nothing is predicted.  The key table and
    the plates with their specs and latest furnace records are stored once, not computed per
    micro-batch."""
    spark = stream.sparkSession
    facts = settled(plate_facts(plates, specs, LT.latest_furnace(furnace)))
    rows = GA.arrivals(stream, GA.key_table(plates, furnace), ROLLING_STREAM_COLUMNS, rolling_history)
    outputs = BatchOutputs(spark, out_root)
    model = active_bundle(spark, registry) if registry else lambda: None

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = GA.judged(batch, ROLLING_STREAM_COLUMNS).persist()
        try:
            good = enrich(batch.filter(F.col("outcome") == GA.ACCEPTED).drop("outcome"), facts).persist()
            tables = {"rolling": batch.filter(F.col("outcome") == GA.ACCEPTED).drop("outcome"),
                      "quarantine": batch.filter(F.col("outcome") != GA.ACCEPTED).withColumnRenamed("outcome", "reason"),
                      "alerts": RU.alerts(good, at="rolling_date")}
            found = model()
            if found is not None:
                tables["predictions"], tables["explanations"] = predictions_of(good, *found)
            outputs.write(batch_id, tables)
            good.unpersist()
        finally:
            batch.unpersist()

    return _started(rows, each_batch, out_root, trigger_available_now)


def files_per_batch(spark: SparkSession, path: str, least: int = 8, batches: int = MICRO_BATCHES) -> int:
    """Files of a micro-batch of a backlog at ``path``: every micro-batch joins with all known
    plates, so a longer backlog is read in larger micro-batches, not in more of them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    n = sum(1 for f in listed if not f.getPath().getName().startswith(("_", ".")))
    return max(least, -(-n // batches))


def stream_table(spark: SparkSession, out_root: str, name: str) -> DataFrame:
    """Committed rows of one of ``STREAM_TABLES``."""
    return BatchOutputs(spark, out_root).read(name, STREAM_TABLES[name])


def _started(rows: DataFrame, each_batch: Callable, out_root: str, available_now: bool):
    w = rows.writeStream.foreachBatch(each_batch).option("checkpointLocation", os.path.join(out_root, "_checkpoint"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def start_inspection_ingest(stream: DataFrame, plates: DataFrame, users: DataFrame, out_root: str,
                            trigger_available_now: bool = True):
    """Accept labels whose plate and inspector exist, quarantine the others with a
    reason; both are appended and committed together.  Read back by
    ``BatchOutputs(spark, out_root).read('inspections' or 'quarantine', schema)``."""
    plates = settled(plates.select("plate_no", F.lit(True).alias("__plate")).distinct())
    users = settled(users.select(F.col("email").alias("inspector_email"), "user_id"))
    checked = stream.join(plates, "plate_no", "left").join(users, "inspector_email", "left").withColumn(
        "reason", F.when(F.col("__plate").isNull(), "plate_missing").when(F.col("user_id").isNull(), "inspector_missing"))
    outputs = BatchOutputs(stream.sparkSession, out_root)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop("__plate").persist()
        try:
            outputs.write(batch_id, {"inspections": batch.filter("reason is null").drop("reason"),
                                     "quarantine": batch.filter("reason is not null").drop("user_id")})
        finally:
            batch.unpersist()

    return _started(checked, each_batch, out_root, trigger_available_now)
