"""Latest-record selection and frame assembly.

All joins are keyed by plate_no.  ``latest_by`` leaves its output hash-partitioned
on plate_no, so the assembly joins reuse that partitioning instead of shuffling the
histories again; the spec dimension is settled first, so the planner knows its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.lookup import settled
from platewise.operators.rank import latest_by

FURNACE_COLS = ["fur_no", "fur_input_row", "fur_heat_temp", "fur_heat_time", "fur_soak_temp",
                "fur_soak_time", "fur_total_time"]


def latest_furnace(furnace: DataFrame, tie_breaks: list | None = None) -> DataFrame:
    """Newest furnace record per plate; explicit tie-breaks make equal instants
    deterministic (default: any extra key columns present, ascending)."""
    ties = tie_breaks if tie_breaks is not None else [c for c in ("seq", "l_partkey", "l_suppkey", "l_extendedprice", "id")
                                                       if c in furnace.columns]
    return latest_by(furnace, ["plate_no"], [F.col("recorded_at").desc(), *ties])


def latest_inspection(insp: DataFrame, tie_breaks: list | None = None, as_of=None) -> DataFrame:
    """Newest inspection per plate (ties: defect_type ascending unless given).  ``as_of``
    (a timestamp column or value) reads the append-only log as it stood at that instant."""
    ties = tie_breaks if tie_breaks is not None else ["defect_type"]
    if as_of is not None:
        insp = insp.filter(F.col("inspected_at") <= (as_of if isinstance(as_of, Column) else F.lit(as_of)))
    return latest_by(insp, ["plate_no"], [F.col("inspected_at").desc(), *ties])


def serving_frame(plate: DataFrame, spec: DataFrame, furnace: DataFrame, rolling: DataFrame) -> DataFrame:
    """Plate -> spec -> latest furnace -> rolling; a plate missing any side has no row."""
    lf = latest_furnace(furnace).select("plate_no", *FURNACE_COLS)
    p = plate.join(settled(spec.select("spec_code", "spec_country", "steel_kind")), "spec_code", "inner")
    return (p.join(lf, "plate_no", "inner")
             .join(rolling.select("plate_no", "hsb_applied", "rolling_method", "rolling_temp", "descaling_count",
                                  "work_group", "rolling_date"), "plate_no", "inner")
             .select("plate_no", "pt_thick", "pt_width", "pt_length", "spec_country", "steel_kind", *FURNACE_COLS,
                     "hsb_applied", "rolling_method", "rolling_temp", "descaling_count", "work_group", "rolling_date"))


def training_frame(plate: DataFrame, spec: DataFrame, furnace: DataFrame, rolling: DataFrame,
                   inspection: DataFrame, as_of=None) -> DataFrame:
    """The serving frame plus the latest inspection label (inner join), with ``as_of``
    the latest one at that instant (M15: a retraining run is repeatable)."""
    li = latest_inspection(inspection, as_of=as_of).select("plate_no", "defect_type")
    return serving_frame(plate, spec, furnace, rolling).join(li, "plate_no", "inner")
