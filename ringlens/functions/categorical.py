"""Categorical mappings as column expressions (CASE chains / map lookups)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringlens.constants import (
    CAMPAIGN_OTHER,
    CAMPAIGN_PATTERNS,
    CHURN_ALIASES,
    CHURN_GROUPS,
    ENGAGEMENT_MAP,
    NO_REASON_VALUES,
    SENTIMENT_ORDINAL,
)
from ringlens.functions.text import normalize_category


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lookup(col: Column, mapping: dict, default: Column) -> Column:
    """``mapping[col]`` as a CASE chain (codegen-friendly, no map materialised)."""
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return default if expr is None else expr.otherwise(default)


def campaign_type(name_col="name", patterns=CAMPAIGN_PATTERNS, strict_nulls: bool = False) -> Column:
    """Campaign type from its name: lower-case, ordered regex list, first match wins.

    Null name -> ``otro`` (or null with ``strict_nulls``).
    """
    low = F.lower(_c(name_col))
    expr = None
    for pattern, label in patterns:
        cond = low.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(CAMPAIGN_OTHER))
    if strict_nulls:
        return F.when(_c(name_col).isNull(), F.lit(None).cast("string")).otherwise(expr)
    return expr


def churn_alias(col) -> Column:
    """Alias map on an already normalised churn reason (unmapped values unchanged)."""
    return _lookup(_c(col), CHURN_ALIASES, _c(col))


def churn_reason(col) -> Column:
    """Normalised churn reason with the alias map applied (null stays null)."""
    return churn_alias(normalize_category(col))


def engagement(reason_col="disconnected_reason") -> Column:
    """user_hangup 2, agent_hangup 1, anything else (incl. null) 0."""
    return _lookup(_c(reason_col), ENGAGEMENT_MAP, F.lit(0)).cast("double")


def sentiment_ordinal(col="pca_sentimiento") -> Column:
    """positivo 2, neutral 1, negativo 0, null / other 1."""
    return _lookup(_c(col), SENTIMENT_ORDINAL, F.lit(1)).cast("double")


def has_reason(col="pca_razon_churn", no_reason=NO_REASON_VALUES) -> Column:
    """1.0 when a churn reason is documented, 0.0 for null and the no-reason values."""
    c = _c(col)
    return F.when(c.isNull() | c.isin(list(no_reason)), F.lit(0.0)).otherwise(F.lit(1.0))


def reason_label(col="pca_razon_churn", no_reason=NO_REASON_VALUES) -> Column:
    """``con_motivo`` / ``sin_motivo``."""
    return F.when(has_reason(col, no_reason) == 1.0, F.lit("con_motivo")).otherwise(F.lit("sin_motivo"))


def churn_group(col="pca_razon_churn") -> Column:
    """Macro group of a churn reason: null -> sin_motivo, unmapped -> otro."""
    key = F.lower(F.trim(_c(col)))
    return F.when(_c(col).isNull(), F.lit("sin_motivo")).otherwise(_lookup(key, CHURN_GROUPS, F.lit("otro")))


def any_true(cols) -> Column:
    """Row-wise OR of boolean columns, null counted as False."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(c), F.lit(False)) for c in cols])


def significance(p_col) -> Column:
    """Significance label of a p-value (NaN/null -> insufficient data)."""
    p = _c(p_col)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("N/A"))
        .when(p < 0.001, F.lit("***"))
        .when(p < 0.01, F.lit("**"))
        .when(p < 0.05, F.lit("*"))
        .otherwise(F.lit("ns"))
    )
