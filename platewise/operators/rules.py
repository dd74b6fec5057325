"""Deterministic alert rules and the alert lifecycle.

Rules are column predicates; a row's fired rules are an ordered array of structs built
without exploding, and ``alerts`` explodes them into one row per fired rule.  Alert
state is append-only: resolutions are a log and the current state is the alert with its first
valid resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import vocab as V


def _rule(code: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))


def rule_array(temp: Column, soak: Column, hsb: Column) -> Column:
    """All matching rules in the order HSB, over-1000, small drop.

    ``temp`` may be the raw reading (NULL when missing, ingest semantics) or the imputed
    one (batch/what-if semantics); with NULL only the HSB rule can fire.
    The message interpolates the reading and the drop in the column's own type.
    """
    drop = soak - temp
    r1 = F.when(~F.coalesce(hsb.cast("boolean"), F.lit(False)), _rule(V.RULE_HSB, V.SEVERITY_CRITICAL, F.lit(V.MSG_HSB)))
    r2 = F.when(temp.isNotNull() & (temp >= V.ROLLING_TEMP_CRITICAL),
                _rule(V.RULE_HOT, V.SEVERITY_CRITICAL,
                      F.format_string(V.MSG_HOT, temp.cast("string"), F.lit(str(V.ROLLING_TEMP_CRITICAL)))))
    r3 = F.when(temp.isNotNull() & (drop < V.TEMP_DROP_WARNING_BELOW),
                _rule(V.RULE_DROP, V.SEVERITY_WARNING,
                      F.format_string(V.MSG_DROP, drop.cast("string"), F.lit(str(V.TEMP_DROP_WARNING_BELOW)))))
    return F.array_compact(F.array(r1, r2, r3))


def rule_hits(df: DataFrame, temp_col: str = "rolling_temp", soak_col: str = "fur_soak_temp",
              hsb_col: str = "hsb_applied", out: str = "fired_rules") -> DataFrame:
    """Add ``fired_rules`` (array<struct<rule_code, severity, message>>)."""
    return df.withColumn(out, rule_array(F.col(temp_col), F.col(soak_col), F.col(hsb_col)))


def rule_codes(c: str | Column = "fired_rules") -> Column:
    """rule codes joined by ';' ('' when none fired)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(";", F.transform(c, lambda r: r["rule_code"]))


def alerts(df: DataFrame, key: str = "plate_no", at: str = "rolling_date",
           rules_col: str = "fired_rules") -> DataFrame:
    """One alert row per fired rule, keyed by (plate, rule position)."""
    return (df.select(key, F.col(at).alias("triggered_at"), F.posexplode(rules_col).alias("rule_pos", "r"))
              .select(key, "rule_pos", F.col("r.rule_code").alias("rule_code"),
                      F.col("r.severity").alias("severity"), F.col("r.message").alias("message"),
                      "triggered_at"))


def alert_state(alert_df: DataFrame, resolutions: DataFrame, users: DataFrame,
                alert_key: list[str] | None = None) -> DataFrame:
    """Current state of each alert from an append-only resolution log.

    A resolution request (alert key, resolver_email, requested_at) is valid when the
    resolver exists (semi-join on users) and it is not before the alert; the first
    valid request resolves the alert, later ones are no-ops (an alert is resolved once).
    """
    alert_key = alert_key or ["plate_no", "rule_pos"]
    known = resolutions.join(users.select(F.col("email").alias("resolver_email"), "user_id"), "resolver_email").select(
        *[F.col(c).alias(f"__{c}") for c in alert_key], F.struct("requested_at", "user_id", "resolver_email").alias("__request"))
    valid = F.col("__request.requested_at") >= F.col("triggered_at")
    for c in alert_key:
        valid = valid & (F.col(c) == F.col(f"__{c}"))
    # one join, and one aggregate on the partitioning that the join leaves
    first = alert_df.join(known, valid, "left").groupBy(*alert_key, *[c for c in alert_df.columns if c not in alert_key]).agg(
        F.min("__request").alias("__first"))
    return first.select(*alert_df.columns, F.col("__first.requested_at").alias("resolved_at"),
                        F.col("__first.resolver_email").alias("resolved_by"))


def alerts_view(state: DataFrame, status: str = "open", plate_no: str | None = None) -> DataFrame:
    """P12/P13/T4: 'open' keeps unresolved alerts, any other status keeps all;
    optional plate filter; newest first."""
    out = state.filter(F.col("resolved_at").isNull()) if status == "open" else state
    if plate_no:
        out = out.filter(F.col("plate_no") == plate_no)
    return out.orderBy(F.col("triggered_at").desc(), "plate_no", "rule_pos")
