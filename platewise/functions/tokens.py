"""Token parsers and label encoders as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.functions import vocab as V


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def leading_int(c) -> Column:
    """'1호기' -> 1, '12열' -> 12; no leading digits or NULL -> NULL (quarantine upstream)."""
    digits = F.regexp_extract(_c(c).cast("string"), r"^(\d+)", 1)
    return F.when(digits != "", digits).try_cast("int")


def method_strict(c) -> Column:
    """Prefix TMCP -> 'TMCP', prefix CR -> 'CR', anything else -> NULL (a violation)."""
    c = _c(c)
    return (F.when(c.startswith(V.METHOD_TMCP), V.METHOD_TMCP)
            .when(c.startswith(V.METHOD_CR), V.METHOD_CR))


def method_lenient(c) -> Column:
    """Scoring form: prefix TMCP -> 'TMCP', anything else (NULL too) -> 'CR'."""
    return F.when(_c(c).startswith(V.METHOD_TMCP), V.METHOD_TMCP).otherwise(V.METHOD_CR)


def hsb_applied(c) -> Column:
    """Breaker flag from the flat log; NULL counts as not applied."""
    return F.coalesce(_c(c) == V.HSB_ON, F.lit(False))


def defect_type_from_scale(c) -> Column:
    return F.when(_c(c) == V.SCALE_DEFECT, V.DEFECT_SCALE).otherwise(V.DEFECT_NONE)


def target_from_scale(c) -> Column:
    return F.coalesce(_c(c) == V.SCALE_DEFECT, F.lit(False)).cast("int")


def target_from_defect(c) -> Column:
    """Only a Scale defect is a positive; other defect types encode to 0."""
    return F.coalesce(_c(c) == V.DEFECT_SCALE, F.lit(False)).cast("int")


def parse_rolling_date(c) -> Column:
    """'03JAN2008:07:07:53' -> TIMESTAMP_NTZ; unparsable -> NULL."""
    return F.try_to_timestamp(_c(c), F.lit(V.ROLLING_DATE_FORMAT)).cast("timestamp_ntz")


def truncating_int(c) -> Column:
    """int(x) semantics: truncate toward zero; dirty text -> NULL instead of an error."""
    return _c(c).try_cast("double").try_cast("int")
