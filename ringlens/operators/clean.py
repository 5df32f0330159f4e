"""Cleaning stage: typed and derived columns (P1-P12) and the row filters.

Row-level steps are pure projections (no shuffle, one codegen stage). The
two steps that need a statistic of the whole column (p99 outlier flag, IQR
fence) obtain it as a driver scalar from one small aggregate and then apply
it as a literal, so the same functions also accept a streaming DataFrame
when the limits are passed in frozen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.constants import (
    DAY_LABELS,
    IQR_MULTIPLIER,
    P99_QUANTILE,
    PCA_ALL_FIELDS,
    PCA_FIELDS,
    TEST_CAMPAIGN,
)
from ringlens.functions.categorical import campaign_type, churn_alias
from ringlens.functions.quantiles import nearest_quantiles, quantile_scalars
from ringlens.functions.text import normalize_category, ustrip

#: Local wall-clock text, ``yyyy-MM-dd HH:mm:ss`` with up to six fraction digits.
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
PCA_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PCA_ALL_FIELDS])


def local_timestamp(df: DataFrame, name: str) -> Column:
    """``name`` as a timestamp without zone (bad text -> null): a local time never moves with the session's zone."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    return F.when(F.col(name).rlike(TIMESTAMP_PATTERN), F.col(name).try_cast("timestamp_ntz"))


def parse_datetime(df: DataFrame) -> DataFrame:
    """``executed_at`` -> timestamp (bad text -> null) plus hour, day, date, weekday label."""
    df = df.withColumn("executed_at", local_timestamp(df, "executed_at"))
    days = F.array(*[F.lit(d) for d in DAY_LABELS])
    return df.withColumns({
        "hour": F.hour("executed_at"),
        "day_of_month": F.dayofmonth("executed_at"),
        "date": F.date_format("executed_at", "dd/MM/yyyy"),
        "day_of_week": F.element_at(days, F.weekday("executed_at") + 1),
    })


def normalize_duration(df: DataFrame) -> DataFrame:
    """``duration_ms`` -> double (bad -> null) and ``duration_sec``."""
    ms = F.col("duration_ms")
    if not isinstance(df.schema["duration_ms"].dataType, T.DoubleType):
        ms = F.expr("try_cast(duration_ms AS DOUBLE)")
    return df.withColumn("duration_ms", ms).withColumn("duration_sec", F.col("duration_ms") / F.lit(1000.0))


def flag_duration_outliers(df: DataFrame, p99: float | None = None, q: float = P99_QUANTILE) -> DataFrame:
    """``duration_outlier = duration_ms > p99`` (null -> False).

    ``p99`` is the nearest-rank quantile over non-null durations; pass it in
    to freeze it (streaming, or reuse across jobs).
    """
    if p99 is None:
        (p99,) = nearest_quantiles(df, "duration_ms", [q])
    flag = F.lit(False) if p99 is None else F.coalesce(F.col("duration_ms") > F.lit(p99), F.lit(False))
    return df.withColumn("duration_outlier", flag)


def normalize_categoricals(df: DataFrame) -> DataFrame:
    """Campaign id as text, trimmed name, reason trimmed + lower-case (null -> ``unknown``)."""
    return df.withColumns({
        "campaign_id": F.col("campaign_id").cast("string"),
        "name": ustrip("name"),
        "disconnected_reason": F.coalesce(F.lower(ustrip("disconnected_reason")), F.lit("unknown")),
    })


def parse_post_call_analysis(df: DataFrame) -> DataFrame:
    """JSON object -> six ``pca_*`` columns; empty strings -> null.

    Malformed JSON gives nulls (PERMISSIVE) instead of aborting the job;
    ``validation_report`` counts such rows.
    """
    # parsed once into a struct column, then the fields are read from it
    df = df.withColumn("_pca", F.from_json(F.col("post_call_analysis"), PCA_SCHEMA))
    s = F.col("_pca")
    return df.withColumns({f"pca_{f}": F.nullif(s.getField(f), F.lit("")) for f in PCA_FIELDS}).drop("_pca")


def normalize_pca_fields(df: DataFrame) -> DataFrame:
    """Churn reason (normalised + aliases) and recoverability (normalised)."""
    if "pca_razon_churn" in df.columns:
        # normalised value first, alias lookup on the materialised value
        df = df.withColumn("pca_razon_churn", normalize_category("pca_razon_churn"))
        df = df.withColumn("pca_razon_churn", churn_alias("pca_razon_churn"))
    if "pca_posible_recuperacion" in df.columns:
        df = df.withColumn("pca_posible_recuperacion", normalize_category("pca_posible_recuperacion"))
    return df


def parse_transcript(df: DataFrame) -> DataFrame:
    """JSON list -> newline-joined stripped text (null items skipped, ``[]`` -> ``''``) and its length."""
    lines = F.from_json(F.col("transcript"), T.ArrayType(T.StringType()))
    text = ustrip(F.array_join(lines, "\n"))
    return df.withColumn("transcript_text", text).withColumn("transcript_length", F.length("transcript_text"))


def add_inconsistency_flag(df: DataFrame) -> DataFrame:
    """``connected`` (null -> False) differs from ``call_completed``."""
    return df.withColumn(
        "inconsistency_flag", F.coalesce(F.col("connected"), F.lit(False)) != F.col("call_completed")
    )


def add_campaign_type(df: DataFrame, strict_nulls: bool = False) -> DataFrame:
    return df.withColumn("campaign_type", campaign_type("name", strict_nulls=strict_nulls))


def prepare_calls(df: DataFrame, with_campaign_type: bool = True) -> DataFrame:
    """All row-level cleaning steps (P1-P4, P6-P12) in order; Catalyst merges their projections."""
    if "call_completed" not in df.columns:
        df = df.withColumn("call_completed", F.col("call_url").isNotNull())
    for step in (parse_datetime, normalize_duration, normalize_categoricals, parse_post_call_analysis, normalize_pca_fields,
                 parse_transcript, add_inconsistency_flag):
        df = step(df)
    return add_campaign_type(df) if with_campaign_type else df


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    q1: float | None
    q3: float | None
    multiplier: float = IQR_MULTIPLIER

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - self.multiplier * (self.q3 - self.q1)

    @property
    def upper(self) -> float | None:
        return None if self.q3 is None else self.q3 + self.multiplier * (self.q3 - self.q1)


def pre_fence_condition(exclude_test_campaign: bool = True) -> Column:
    """F1 (+F2): hour != 0 (null hour fails) and, optionally, campaign != prueba."""
    cond = F.col("hour") != 0
    if exclude_test_campaign:
        cond = cond & (F.col("campaign_type") != F.lit(TEST_CAMPAIGN))
    return cond


def duration_fence(df: DataFrame, exclude_test_campaign: bool = True, multiplier: float = IQR_MULTIPLIER,
                   approx: bool = False) -> Fence:
    """IQR fence on ``duration_sec``, nearest quantiles taken after F1/F2."""
    q1, q3 = nearest_quantiles(df.filter(pre_fence_condition(exclude_test_campaign)), "duration_sec",
                               [0.25, 0.75], approx=approx)
    return Fence(q1, q3, multiplier)


def clean_limits(df: DataFrame, exclude_test_campaign: bool = True, q: float = P99_QUANTILE,
                 multiplier: float = IQR_MULTIPLIER) -> tuple[float | None, Fence]:
    """p99 of ``duration_ms`` (all rows) and the IQR fence (rows passing F1/F2), counted in one pass."""
    pre = pre_fence_condition(exclude_test_campaign)
    sec = F.when(pre, F.col("duration_sec"))
    p99, q1, q3 = quantile_scalars(df, [("duration_ms", "nearest", q), (sec, "nearest", 0.25), (sec, "nearest", 0.75)])
    return p99, Fence(q1, q3, multiplier)


def fence_condition(fence: Fence) -> Column:
    """Both ends closed; null duration fails (calls that never connected)."""
    if fence.q1 is None:
        return F.lit(False)
    return F.col("duration_sec").between(F.lit(fence.lower), F.lit(fence.upper))


def filter_outliers(df: DataFrame, fence: Fence | None = None, exclude_test_campaign: bool = True) -> DataFrame:
    """F1 -> F2 -> F3. The IQR fence is computed unless given."""
    fence = fence or duration_fence(df, exclude_test_campaign)
    return df.filter(pre_fence_condition(exclude_test_campaign) & fence_condition(fence))


def removal_step(fence: Fence, exclude_test_campaign: bool = True) -> Column:
    """Name of the filter step that removes a row, or null when kept (first failing step)."""
    step = F.when(F.coalesce(F.col("hour") != 0, F.lit(False)) == F.lit(False), F.lit("hour_0"))
    if exclude_test_campaign:
        step = step.when(F.coalesce(F.col("campaign_type") != F.lit(TEST_CAMPAIGN), F.lit(False)) == F.lit(False),
                         F.lit("campaign_prueba"))
    return step.when(F.coalesce(fence_condition(fence), F.lit(False)) == F.lit(False), F.lit("outlier_duration"))


def filter_funnel(df: DataFrame, fence: Fence | None = None, exclude_test_campaign: bool = True) -> DataFrame:
    """Rows removed by each filter step and rows kept, in one pass."""
    fence = fence or duration_fence(df, exclude_test_campaign)
    step = F.coalesce(removal_step(fence, exclude_test_campaign), F.lit("kept"))
    return df.select(step.alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def clean(df: DataFrame, exclude_test_campaign: bool = True, p99: float | None = None,
          fence: Fence | None = None) -> DataFrame:
    """Full cleaning stage: row-level steps, p99 flag, filters.

    The campaign-type filter is applied by default (the type is classified
    before filtering); ``exclude_test_campaign=False`` keeps those rows.
    """
    df = prepare_calls(df)
    if p99 is None or fence is None:
        p, f = clean_limits(df, exclude_test_campaign)
        p99 = p if p99 is None else p99
        fence = f if fence is None else fence
    df = flag_duration_outliers(df, p99)
    return filter_outliers(df, fence, exclude_test_campaign)
