"""Flat process log -> keyed tables, with validation (P3-P11, J2-J4, J8, W6, S12, S13,
P20, A21, A27, U1, U2).

Surrogate spec codes are numbered over the *distinct new* combinations only, after the
count of existing codes, with the distributed global rank.  Validation never drops a
row silently: each row gets a ``violations`` array and lands either in the accepted or
in the quarantine output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from platewise.functions import tokens as TK
from platewise.operators.lookup import settled
from platewise.operators.rank import global_rank
from platewise.session import ensure_checkpoint_dir

SPEC_KEY = ["spec_long", "spec_country", "steel_kind"]


def spec_combinations(flat: DataFrame) -> DataFrame:
    """Distinct (spec_long, spec_country, steel_kind) triples."""
    return flat.select(*SPEC_KEY).distinct()


def assign_spec_codes(flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """J4 + W6: number new triples 'SPEC%03d' after the existing count, in sorted
    triple order; existing codes are kept.  Returns the full spec table."""
    combos = spec_combinations(flat)
    if existing is not None:
        combos = combos.join(existing.select(*SPEC_KEY), SPEC_KEY, "left_anti")
        n0 = existing.agg(F.count(F.lit(1)).alias("n0")).scalar()
    else:
        n0 = F.lit(0)
    ranked = global_rank(combos, SPEC_KEY, "pos")
    new = ranked.select(F.format_string("SPEC%03d", n0 + F.col("pos") + 1).alias("spec_code"), *SPEC_KEY)
    return new if existing is None else existing.select("spec_code", *SPEC_KEY).unionByName(new)


def spec_codes_of_loads(flat: DataFrame, earlier: Column) -> DataFrame:
    """J4 + W6 for two loads at once: combinations among the rows ``earlier`` are numbered
    first, those that only come later after them, as two calls of
    :func:`assign_spec_codes` would, but with one ranking."""
    combos = flat.groupBy(*SPEC_KEY).agg(F.bool_or(F.coalesce(earlier, F.lit(False))).alias("__earlier"))
    ranked = global_rank(combos.withColumn("__load", F.when(F.col("__earlier"), 0).otherwise(1)), ["__load", *SPEC_KEY], "pos")
    return ranked.select(F.format_string("SPEC%03d", F.col("pos") + 1).alias("spec_code"), *SPEC_KEY)


def plates(flat: DataFrame, specs: DataFrame) -> DataFrame:
    """Plate table with the spec surrogate key (three-column lookup)."""
    return flat.join(settled(specs), SPEC_KEY, "left").select(
        "plate_no", "spec_code",
        TK.truncating_int("pt_thick").alias("pt_thick"), TK.truncating_int("pt_width").alias("pt_width"),
        TK.truncating_int("pt_length").alias("pt_length"), F.col("rolling_date").alias("created_at"))


def furnace_records(flat: DataFrame) -> DataFrame:
    """One furnace record per flat row, recorded at the rolling instant."""
    return flat.select(
        "plate_no", TK.leading_int("fur_no").alias("fur_no"), TK.leading_int("fur_input_row").alias("fur_input_row"),
        *[TK.truncating_int(c).alias(c) for c in
          ["fur_heat_temp", "fur_heat_time", "fur_soak_temp", "fur_soak_time", "fur_total_time"]],
        F.col("rolling_date").alias("recorded_at"))


def rolling_records(flat: DataFrame) -> DataFrame:
    """Rolling record; strict method (unknown -> NULL, quarantined by
    validation), non-positive temperature -> NULL."""
    t = TK.truncating_int("rolling_temp")
    return flat.select(
        "plate_no", TK.hsb_applied("hsb").alias("hsb_applied"), TK.method_strict("rolling_method").alias("rolling_method"),
        F.when(t > 0, t).alias("rolling_temp"), TK.truncating_int("descaling_count").alias("descaling_count"),
        "work_group", "rolling_date")


def inspections(flat: DataFrame, inspector_email: str = "system-migration@plant.local") -> DataFrame:
    """One inspection per flat row (defective -> 'Scale', else none)."""
    return flat.select("plate_no", TK.defect_type_from_scale("scale").alias("defect_type"),
                       F.lit(inspector_email).alias("inspector_email"),
                       F.col("rolling_date").alias("inspected_at"))


def domain_violations(flat: DataFrame) -> Column:
    """Array of violated domain rules of a flat row (empty when valid)."""
    checks = [
        ("plate_no_missing", F.col("plate_no").isNull()),
        ("steel_kind_domain", ~F.coalesce(F.col("steel_kind").isin("C", "T"), F.lit(False))),
        ("pt_thick_not_positive", ~F.coalesce(F.col("pt_thick") > 0, F.lit(False))),
        ("pt_width_not_positive", ~F.coalesce(F.col("pt_width") > 0, F.lit(False))),
        ("pt_length_not_positive", ~F.coalesce(F.col("pt_length") > 0, F.lit(False))),
        ("descaling_negative", ~F.coalesce(F.col("descaling_count") >= 0, F.lit(False))),
        ("rolling_method_unknown", TK.method_strict("rolling_method").isNull()),
        ("fur_no_unparsable", TK.leading_int("fur_no").isNull()),
        ("fur_input_row_unparsable", TK.leading_int("fur_input_row").isNull()),
        ("rolling_date_missing", F.col("rolling_date").isNull()),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


VIOLATION_CODES = ["plate_no_missing", "steel_kind_domain", "pt_thick_not_positive", "pt_width_not_positive",
                   "pt_length_not_positive", "descaling_negative", "rolling_method_unknown", "fur_no_unparsable",
                   "fur_input_row_unparsable", "rolling_date_missing"]


def validate(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S12 split: (accepted rows, quarantined rows with their violations)."""
    v = flat.withColumn("violations", domain_violations(flat))
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)


def violation_summary(flat: DataFrame) -> DataFrame:
    """Count of rows per violated rule (every rule listed, zero included)."""
    v = flat.select(domain_violations(flat).alias("v"))
    wide = v.agg(*[F.count_if(F.array_contains("v", code)).alias(code) for code in VIOLATION_CODES])
    return wide.unpivot([], VIOLATION_CODES, "violation", "n_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity (partial agg)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_parent(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """J8 quarantine: child rows whose parent key does not exist."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """J8 accept: child rows whose parent key exists."""
    return child.join(parent.select(*keys).distinct(), keys, "left_semi")


def new_rows(flat: DataFrame, existing_plates: DataFrame) -> DataFrame:
    """Skip plates already loaded (idempotent re-run)."""
    return flat.join(existing_plates.select("plate_no"), "plate_no", "left_anti")


def mark_first(df: DataFrame, key: str, order: str | None, candidate: Column, out: str) -> DataFrame:
    """S13 in a batch: ``out`` is true for the first row of each key under ``order``, then
    in the order of the input, among the rows that ``candidate`` names.  The rows are
    numbered once in a checkpoint; the first of each key is a minimum (combined map-side)
    joined back on that number, so a key with a third of the rows stays spread."""
    ensure_checkpoint_dir(df.sparkSession)
    numbered = df.withColumn("__row", F.monotonically_increasing_id()).checkpoint(eager=True)
    pos = F.struct(*([F.col(order).alias("o")] if order else []), F.col("__row").alias("row"))
    first = numbered.filter(candidate).groupBy(key).agg(F.min(pos).alias("__f")).select(
        F.col("__f.row").alias("__row"), F.lit(True).alias("__is_first"))
    return (numbered.join(first, "__row", "left").withColumn(out, F.coalesce("__is_first", F.lit(False)))
            .drop("__row", "__is_first"))


def load_outcomes(flat: DataFrame, existing_plates: DataFrame | None = None) -> DataFrame:
    """Every row of the flat log with ``load_status`` and ``load_reason``:
    'skipped' when its plate is already loaded, 'quarantined' when it violates a domain
    or repeats a plate of the batch (the first by rolling date stays), else 'written'."""
    tagged = flat.withColumn("__bad", F.array_join(domain_violations(flat), ";"))
    if existing_plates is None:
        tagged = tagged.withColumn("__seen", F.lit(False))
    else:
        seen = existing_plates.select("plate_no").distinct().withColumn("__seen", F.lit(True))
        tagged = tagged.join(seen, "plate_no", "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    good = ~F.col("__seen") & (F.col("__bad") == "")
    tagged = mark_first(tagged, "plate_no", "rolling_date", good, "__first")
    status = F.when(F.col("__seen"), "skipped").when(F.col("__first"), "written").otherwise("quarantined")
    reason = (F.when(F.col("__seen"), "plate_exists").when(F.col("__bad") != "", F.col("__bad"))
              .when(~F.col("__first"), "duplicate_in_batch"))
    return tagged.withColumns({"load_status": status, "load_reason": reason}).select(
        *flat.columns, "load_status", "load_reason")


def written(outcomes: DataFrame) -> DataFrame:
    """The rows of :func:`load_outcomes` that go into the tables."""
    return outcomes.filter(F.col("load_status") == "written").drop("load_status", "load_reason")


def load_report(outcomes: DataFrame) -> DataFrame:
    """P20: rows read, skipped, quarantined and written per table, in one pass over
    :func:`load_outcomes` (each written row gives one record per table)."""
    def n(status: str, name: str) -> Column:
        return F.count_if(F.col("load_status") == status).alias(name)
    return outcomes.agg(F.count(F.lit(1)).alias("rows_read"), n("skipped", "rows_skipped"),
                        n("quarantined", "rows_quarantined"),
                        *[n("written", f"{t}_written") for t in ("plates", "furnace", "rolling", "inspections")])


def write_tables(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Append each table to ``root/<name>``; returns (table_name, rows_written) as observed by
    the writes themselves, without another job over the data.  The writes run in a session of
    their own: an observation leaves a listener in its session that can't be serialised,
    and fitted models of that session would carry it into their tasks."""
    spark = next(iter(tables.values())).sparkSession
    apart, counts = spark.newSession(), []
    for name, df in tables.items():
        seen, view = Observation(name), f"load_{uuid.uuid4().hex}"
        df.createGlobalTempView(view)
        try:
            apart.table(f"global_temp.{view}").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{root}/{name}")
        finally:
            spark.catalog.dropGlobalTempView(view)
        counts.append((name, seen.get["n"]))
    return spark.createDataFrame(counts, "table_name string, rows_written long")


def load(flat: DataFrame, root: str, existing_plates: DataFrame | None = None, existing_specs: DataFrame | None = None) -> DataFrame:
    """Load the rows of a flat log that validation lets through into the tables
    under ``root``, rejected ones into ``root/quarantine``; returns the report of
    :func:`write_tables`."""
    outcomes = settled(load_outcomes(flat, existing_plates))
    rows = written(outcomes)
    specs = settled(assign_spec_codes(rows, existing=existing_specs))
    return write_tables({"product_spec": specs, "plate": plates(rows, specs), "furnace_process": furnace_records(rows),
                         "rolling_process": rolling_records(rows), "quality_inspection": inspections(rows),
                         "quarantine": outcomes.filter(F.col("load_status") == "quarantined").drop("load_status")}, root)
