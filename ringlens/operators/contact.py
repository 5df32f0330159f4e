"""Contactability reports (A1-A13): when are contacts reachable.

Each report is one hash aggregation with map-side partial aggregation; any
share, min/max or order is computed on the *aggregated* table, whose size is
bounded by the number of groups (7 days x 24 hours for the windows), never
on raw rows. A skewed group (one campaign holding a third of the calls) is
absorbed by the partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.quantiles import MEDIAN, Q25, Q75, group_quantiles, quantiles_of_counts, value_counts

DAY_HOUR = ["day_of_week", "hour"]


def _int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def connection_rate(df: DataFrame, by) -> DataFrame:
    """Total calls, connected calls and their ratio per group (A1)."""
    by = [by] if isinstance(by, str) else list(by)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("connected").cast("int")), F.lit(0)).alias("connected_count"),
    )
    return out.withColumn("connection_rate", F.col("connected_count") / F.col("total"))


def day_spine(order=K.DOW_ORDER_SUNDAY_FIRST, spark=None, df: DataFrame | None = None) -> DataFrame:
    """The seven day labels with their display rank, as a tiny literal table."""
    src = df.sparkSession if df is not None else spark
    return src.createDataFrame([(d, i) for i, d in enumerate(order)], "day_of_week string, day_rank int")


def connection_rate_by_day(df: DataFrame, order=K.DOW_ORDER_SUNDAY_FIRST) -> DataFrame:
    """A2: one row per day label, absent days with zeros, in display order."""
    rates = connection_rate(df, "day_of_week")
    spine = day_spine(order, df=df)
    out = spine.join(F.broadcast(rates), "day_of_week", "left")
    return out.select(
        "day_of_week", "day_rank",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("connected_count", F.lit(0)).alias("connected_count"),
        F.coalesce("connection_rate", F.lit(0.0)).alias("connection_rate"),
    )


def rate_by_day_hour(df: DataFrame, numerator: Column, where: Column | None = None, min_total: int = 0) -> DataFrame:
    """A3: ``sum(numerator) / count`` per (day, hour), optional row filter and minimum volume."""
    base = df.filter(where) if where is not None else df
    out = base.groupBy(*DAY_HOUR).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(numerator), F.lit(0)).alias("n"),
    ).withColumn("val", F.col("n") / F.col("total"))
    return out.filter(F.col("total") >= min_total) if min_total > 0 else out


def connection_heat(df: DataFrame) -> DataFrame:
    return rate_by_day_hour(df, _int(F.col("connected")))


def agent_hangup_heat(df: DataFrame, min_total: int = K.MIN_HEATMAP_CALLS) -> DataFrame:
    return rate_by_day_hour(df, _int(F.col("disconnected_reason") == "agent_hangup"), F.col("connected"), min_total)


def positive_sentiment_heat(df: DataFrame, min_total: int = K.MIN_HEATMAP_CALLS) -> DataFrame:
    return rate_by_day_hour(df, _int(F.col("sentiment_own") == "positivo"), F.col("connected"), min_total)


def duration_heat(df: DataFrame) -> DataFrame:
    """A5: mean duration per (day, hour) over connected calls."""
    return df.filter(F.col("connected")).groupBy(*DAY_HOUR).agg(F.avg("duration_sec").alias("val"))


def complete_grid(cells: DataFrame, hours: DataFrame, order=K.DOW_ORDER_SUNDAY_FIRST, value: str = "val") -> DataFrame:
    """Every (day, hour) of ``order`` x hours present, absent cells 0.

    The grid is generated from the distinct hours (<= 24 rows) with an
    ``explode`` of the day labels - no join of raw rows.
    """
    days = F.array(*[F.lit(d) for d in order])
    grid = hours.select("hour").distinct().select(F.explode(days).alias("day_of_week"), "hour")
    out = grid.join(F.broadcast(cells.select(*DAY_HOUR, value)), DAY_HOUR, "left")
    return out.select(*DAY_HOUR, F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def category_share(df: DataFrame, group: str, category: str, order: list[str] | None = None,
                   connected_only: bool = True) -> DataFrame:
    """Share of each category within its group (+ category display rank)."""
    base = df.filter(F.col("connected")) if connected_only else df
    counts = base.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    out = counts.withColumn("total", F.sum("n").over(w)).withColumn("pct", F.col("n") / F.col("total"))
    if order:
        rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(category))
        out = out.withColumn("category_rank", F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1)))
    return out


def box_stats(df: DataFrame, group: str, value: str = "duration_sec", connected_only: bool = True,
              whisker: float = 1.5) -> DataFrame:
    """Quartiles (linear), whisker ends, outlier count and median per group.

    Everything is taken from one table of value counts per group: quartiles,
    then whiskers and outliers against the group's fences. Raw rows meet no join.
    """
    base = df.filter(F.col("connected")) if connected_only else df
    counts = value_counts(base, [group], value)
    q = quantiles_of_counts(counts, [group], {"q1": Q25, "median": MEDIAN, "q3": Q75, "min": ("nearest", 0.0), "max": ("nearest", 1.0)})
    q = q.where(F.col(group).isNotNull())
    reach = whisker * (F.col("q3") - F.col("q1"))
    fences = q.select(group, (F.col("q1") - reach).alias("lo_fence"), (F.col("q3") + reach).alias("hi_fence"))
    inside = F.col("v").between(F.col("lo_fence"), F.col("hi_fence"))
    w = counts.join(fences, group).groupBy(group).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).alias("n_outliers"),
    )
    return q.join(w, group)


def group_order_by_median(df: DataFrame, group: str, value: str = "duration_sec") -> DataFrame:
    """A10: groups of connected calls ranked by median duration, descending (null median -> 0)."""
    conn = df.filter(F.col("connected"))
    medians = group_quantiles(conn, [group], value, {"median": MEDIAN}).select(group, "median")
    every = conn.select(group, F.lit(None).cast("double").alias("median"))  # a group without values has a row too
    med = medians.unionByName(every).groupBy(group).agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("median"))
    w = Window.orderBy(F.desc("median"), F.asc(group))
    return med.withColumn("rank", F.row_number().over(w))


def window_score(df: DataFrame, min_calls: int = K.MIN_WINDOW_CALLS, top: int | None = 10,
                 days=K.DOW_ORDER_SUNDAY_FIRST) -> DataFrame:
    """Composite window score = connection rate x min-max(mean duration) x positive share.

    One aggregation with conditional aggregates (no self-join); the min/max
    are taken over the <=168 aggregated windows.
    """
    conn = F.coalesce(F.col("connected"), F.lit(False))
    agg = df.groupBy(*DAY_HOUR).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(_int(F.col("connected"))), F.lit(0)).alias("n_conn"),
        F.avg(F.when(conn, F.col("duration_sec"))).alias("dur_mean"),
        F.sum(conn.cast("int")).alias("n_conn_rows"),
        F.sum((conn & (F.col("sentiment_own") == "positivo")).cast("int")).alias("n_pos"),
    )
    agg = agg.filter((F.col("total") >= min_calls) & F.col("day_of_week").isin(list(days)))
    agg = agg.select(
        *DAY_HOUR, "total", "n_conn",
        (F.col("n_conn") / F.col("total")).alias("conn_rate"),
        F.coalesce(F.col("dur_mean"), F.lit(0.0)).alias("dur_mean"),
        F.coalesce(F.col("n_pos") / F.when(F.col("n_conn_rows") > 0, F.col("n_conn_rows")), F.lit(0.0)).alias("pct_pos"),
    )
    allw = Window.partitionBy()
    mn, mx = F.min("dur_mean").over(allw), F.max("dur_mean").over(allw)
    agg = agg.withColumn("dur_norm", F.when(mx > mn, (F.col("dur_mean") - mn) / (mx - mn)).otherwise(F.lit(0.0)))
    agg = agg.withColumn("score", F.col("conn_rate") * F.col("dur_norm") * F.col("pct_pos"))
    out = agg.orderBy(F.desc_nulls_first("score"), "day_of_week", "hour")
    return out.limit(top) if top else out


def top_windows(df: DataFrame, min_calls: int = K.MIN_WINDOW_CALLS, top: int = 10,
                days=K.DOW_ORDER_SUNDAY_FIRST) -> DataFrame:
    """Windows (day, hour) with >= ``min_calls`` ranked by connection rate."""
    agg = connection_heat(df).filter((F.col("total") >= min_calls) & F.col("day_of_week").isin(list(days)))
    out = agg.select(*DAY_HOUR, "total", F.col("n").alias("connected_count"), F.col("val").alias("connection_rate"))
    return out.orderBy(F.desc_nulls_first("connection_rate"), F.desc("total"), "day_of_week", "hour").limit(top)
