"""Accounting for every removed row.

The removed rows are found on a real row key, not by position. Because the
cleaning filters are row-level predicates with literal limits, the kept /
removed status is a column of the prepared table; reports then need a single
aggregation and no join. ``eliminated_rows`` offers the explicit anti join
for arbitrary pairs of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.quantiles import MEDIAN, attach_quantiles
from ringlens.operators.clean import Fence, fence_condition, pre_fence_condition
from ringlens.operators.reports import describe

CAUSE_ORDER = ["hour_0", "campaign_prueba", "outlier_duration", "disconnected_or_incomplete"]


def eliminated_rows(raw: DataFrame, clean: DataFrame, key: str = "call_id") -> DataFrame:
    """Rows of ``raw`` whose key is absent from ``clean`` (left anti join)."""
    return raw.join(clean.select(key), key, "left_anti")


def kept_flag(fence: Fence, exclude_test_campaign: bool = True) -> Column:
    return F.coalesce(pre_fence_condition(exclude_test_campaign) & fence_condition(fence), F.lit(False))


def elimination_cause(fence: Fence, test_campaign: str = K.TEST_CAMPAIGN) -> Column:
    """Cause of a removed row, first rule that applies (hour 0, test campaign, duration outside the fence)."""
    d = F.col("duration_sec")
    outside = d.isNotNull() & ((d < F.lit(fence.lower)) | (d > F.lit(fence.upper))) if fence.q1 is not None else F.lit(False)
    return (
        F.when(F.coalesce(F.col("hour") == 0, F.lit(False)), F.lit("hour_0"))
        .when(F.coalesce(F.col("campaign_type") == test_campaign, F.lit(False)), F.lit("campaign_prueba"))
        .when(outside, F.lit("outlier_duration"))
        .otherwise(F.lit("disconnected_or_incomplete"))
    )


def with_status(df: DataFrame, fence: Fence, exclude_test_campaign: bool = True) -> DataFrame:
    kept = kept_flag(fence, exclude_test_campaign)
    return df.withColumn("kept", kept).withColumn(
        "cause", F.when(F.col("kept"), F.lit(None).cast("string")).otherwise(elimination_cause(fence)))


def elimination_causes(df: DataFrame, fence: Fence) -> DataFrame:
    """Removed rows per cause, share of removed, presentation rank."""
    st = with_status(df, fence).filter(~F.col("kept"))
    out = st.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(c) for c in CAUSE_ORDER]), F.col("cause"))
    return out.withColumns({"pct": F.col("n") / F.sum("n").over(Window.partitionBy()), "cause_rank": rank.cast("int")})


def removed_by(df: DataFrame, fence: Fence, by: str) -> DataFrame:
    """Total, removed, kept and share removed per value of ``by``."""
    st = with_status(df, fence)
    out = st.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("kept")).alias("removed"))
    return out.withColumns({"kept": F.col("total") - F.col("removed"), "pct_removed": F.col("removed") / F.col("total")})


def kept_vs_removed(df: DataFrame, fence: Fence) -> DataFrame:
    """Per status, calls, connected, connection rate and duration profile of connected calls."""
    st = with_status(df, fence).withColumn("status", F.when(F.col("kept"), "kept").otherwise("removed"))
    base = st.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                   F.coalesce(F.sum(F.col("connected").cast("int")), F.lit(0)).alias("n_connected"))
    base = base.withColumn("connection_rate", F.col("n_connected") / F.col("n"))
    dur = describe(st.filter(F.col("connected")), "duration_sec", ["status"]).withColumnRenamed("n", "n_duration")
    return base.join(dur, "status", "left")


def cause_detail(df: DataFrame, fence: Fence) -> DataFrame:
    """Per removal cause, connected share and duration of connected calls."""
    st = with_status(df, fence).filter(~F.col("kept"))
    conn = F.coalesce(F.col("connected"), F.lit(False))
    out = st.groupBy("cause").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(conn).alias("n_connected"),
        F.avg(F.when(conn, F.col("duration_sec"))).alias("dur_mean"),
    )
    return attach_quantiles(out, st.filter(conn), ["cause"], "duration_sec", {"dur_median": MEDIAN}).withColumn("pct_connected", F.col("n_connected") / F.col("n"))


def duration_histogram(df: DataFrame, fence: Fence, bins: int = 50) -> DataFrame:
    """``bins``-bin histogram of connected durations, kept and removed each over its own range.

    The per-status min/max come from one small aggregate joined back on the
    status (two rows); the maximum value falls in the last bin.
    """
    st = with_status(df, fence).filter(F.col("connected") & F.col("duration_sec").isNotNull()) \
        .withColumn("status", F.when(F.col("kept"), "kept").otherwise("removed")).select("status", "duration_sec")
    rng = st.groupBy("status").agg(F.min("duration_sec").alias("lo"), F.max("duration_sec").alias("hi"))
    x = st.join(F.broadcast(rng), "status")
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.width_bucket(F.col("duration_sec"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
               ).otherwise(F.lit(1))
    out = x.withColumn("bin", b.cast("int")).groupBy("status", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return out.select("status", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                      (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "n")
