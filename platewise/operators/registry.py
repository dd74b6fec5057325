"""Model registry as tables.

Parquet has no UPDATE, so model state is append-only: the registry holds one row per
registered version (metrics as a JSON document) and an activation log holds events;
the active version of a name is its latest activation event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import vocab as V
from platewise.operators.rank import latest_by
from platewise.session import path_exists
from platewise.sources.process_log import TABLE_SCHEMAS

_METRIC = "struct<precision:double,recall:double,f1:double,auc:double,cv_best_auc:double,best_params:map<string,string>>"
METRICS_SCHEMA = (f"struct<valid:{_METRIC},valid_comparison:map<string,{_METRIC}>,selected:string,"
                  f"test:struct<precision:double,recall:double,f1:double,auc:double>>")


def version_tag(algorithm: Column, run_at: Column) -> Column:
    """'<algorithm>-YYYYMMDDHHMMSS' from an explicit run instant (never now())."""
    return F.concat_ws("-", algorithm, F.date_format(run_at, "yyyyMMddHHmmss"))


def extract_metrics(metrics_json: Column, algorithm: Column) -> tuple[Column, Column]:
    """(valid, test) from either document shape: ``valid`` if present, else
    ``valid_comparison[algorithm]``; test or NULL."""
    doc = F.from_json(metrics_json, METRICS_SCHEMA)
    valid = F.coalesce(doc["valid"], doc["valid_comparison"][algorithm])
    return valid, doc["test"]


def params_text(params: Column) -> Column:
    """'k=v, k=v' in the order of the document; empty or missing -> the fixed note."""
    entries = F.map_entries(params)
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(F.coalesce(F.size(params), F.lit(0)) <= 0, F.lit(V.NO_PARAMS_NOTE)).otherwise(text)


def rank_key(valid: Column) -> list[Column]:
    """T6 ordering: AUC, then F1 / precision / recall compared at 3 decimals, then the
    cross-validated AUC; a missing value counts as 0."""
    def z(c):
        return F.coalesce(c, F.lit(0.0))
    return [z(valid["auc"]).desc(), F.round(z(valid["f1"]), 3).desc(), F.round(z(valid["precision"]), 3).desc(),
            F.round(z(valid["recall"]), 3).desc(), z(valid["cv_best_auc"]).desc()]


def rank_models(registry: DataFrame, valid: Column, by: list[str] | None = None, tie: str = "model_id") -> DataFrame:
    """1-based rank per model name (the registry is small: a few rows per run)."""
    w = Window.partitionBy(*(by or ["name"])).orderBy(*rank_key(valid), F.col(tie).asc())
    return registry.withColumn("rank", F.row_number().over(w))


def bootstrap_choice(registry: DataFrame, auc: Column, by: list[str] | None = None, tie: str = "model_id") -> DataFrame:
    """The AUC-only best per name; the first registered wins ties."""
    return latest_by(registry.withColumn("__auc", F.coalesce(auc, F.lit(0.0))), by or ["name"],
                     [F.col("__auc").desc(), F.col(tie).asc()]).drop("__auc")


def active_versions(activations: DataFrame) -> DataFrame:
    """Active model per name = its latest activation event (activating one
    version implicitly deactivates the others of the same name)."""
    return latest_by(activations, ["name"], [F.col("activated_at").desc(), F.col("model_id").desc()])


def listing(registry: DataFrame) -> DataFrame:
    """T5: registry newest first."""
    return registry.orderBy(F.col("trained_at").desc(), F.col("model_id").desc())


# ---- the stored registry: tables model_version and model_activation under a root

def append_versions(versions: DataFrame, root: str) -> None:
    """Append rows (any of the columns of ``model_version``) to the stored registry."""
    schema = TABLE_SCHEMAS["model_version"]
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in versions.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema]
    versions.select(*cols).write.mode("append").parquet(f"{root}/model_version")


def append_activations(events: DataFrame, root: str) -> None:
    """Append activation events (name, model_id, activated_at, reason)."""
    schema = TABLE_SCHEMAS["model_activation"]
    events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(
        f"{root}/model_activation")


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the stored registry; empty before anything was appended."""
    path = f"{root}/{name}"
    schema = TABLE_SCHEMAS[name]
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def active_version(spark: SparkSession, root: str, name: str = V.MODEL_NAME) -> Row | None:
    """The stored version that the latest activation of ``name`` names, if any."""
    events = stored(spark, root, "model_activation").filter(F.col("name") == name)
    return active_versions(events).select(F.col("model_id").alias("id")).join(
        stored(spark, root, "model_version"), "id").first()
