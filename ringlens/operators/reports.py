"""Generic report queries: value counts, pivots, describes, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.quantiles import MEDIAN, Q25, Q75, attach_quantiles


def with_total_share(counts: DataFrame, n_col: str = "n", pct_name: str = "pct") -> DataFrame:
    """Share of each group in the grand total.

    The total is a one-row aggregate attached by a broadcast equi-join on a
    constant key, so the grouped table keeps its partitioning (a global
    window would move every group into one task).
    """
    total = counts.agg(F.sum(n_col).alias("_total")).withColumn("_k", F.lit(1))
    out = counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return out.withColumn(pct_name, F.col(n_col) / F.col("_total")).drop("_k", "_total")


def value_counts(df: DataFrame, col: str, pct_name: str = "pct") -> DataFrame:
    """Count per value (null is a value) and share of all rows."""
    return with_total_share(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), "n", pct_name)


def pivot_counts(df: DataFrame, by: str, on: str, values: list) -> DataFrame:
    """Long -> wide counts with listed pivot values (no discovery job), absent -> 0."""
    vals = list(values)
    return df.groupBy(by).pivot(on, vals).agg(F.count(F.lit(1))).na.fill(0, subset=[str(v) for v in vals])


def sentiment_pivot(df: DataFrame, by: str, values=K.SENTIMENTS) -> DataFrame:
    """Counts of each sentiment per group (absent -> 0), total and share of negatives.

    One aggregation with a conditional count per listed value (what ``pivot``
    compiles to) plus the group total, so no join of pivot and totals.
    """
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count(F.when(F.col("sentiment_own") == v, 1)).alias(v) for v in values]
    out = df.groupBy(by).agg(*aggs)
    return out.withColumn("pct_neg", F.col("negativo") / F.col("total"))


def duration_by_sentiment(df: DataFrame) -> DataFrame:
    """Mean, median and count of duration per own sentiment (connected calls)."""
    conn = df.filter(F.col("connected"))
    out = conn.groupBy("sentiment_own").agg(F.avg("duration_sec").alias("dur_mean"), F.count(F.lit(1)).alias("n"))
    return attach_quantiles(out, conn, ["sentiment_own"], "duration_sec", {"dur_median": MEDIAN})


def top_hours_for(df: DataFrame, count_name: str, k: int = 5) -> DataFrame:
    """The ``k`` hours with most rows (ties broken by hour)."""
    out = df.groupBy("hour").agg(F.count(F.lit(1)).alias(count_name))
    return out.orderBy(F.desc(count_name), "hour").limit(k)


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """N, mean, median, population std, q25, q75 (linear), min, max of non-null values."""
    x = F.col(col)
    base = df.filter(x.isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    ]
    out = attach_quantiles(base.groupBy(*(by or [])).agg(*aggs), base, list(by or []), col, {"median": MEDIAN, "q25": Q25, "q75": Q75})
    stats = ["mean", "median", "std", "q25", "q75", "min", "max"]
    return out.withColumns({s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in stats})


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col).distinct().orderBy(col)


def share_within(df: DataFrame, group: str, category: str) -> DataFrame:
    """Count per (group, category), share of the group and share of the category overall."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({
        "pct_of_group": F.col("n") / F.sum("n").over(Window.partitionBy(group)),
        "pct_of_category": F.col("n") / F.sum("n").over(Window.partitionBy(category)),
    })


def top_n_per_group(df: DataFrame, group: str, category: str, n: int, exclude: list | None = None) -> DataFrame:
    """Most frequent ``n`` categories per group (ties by category), nulls and ``exclude`` dropped."""
    base = df.filter(F.col(category).isNotNull())
    if exclude:
        base = base.filter(~F.col(category).isin(list(exclude)))
    counts = base.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(category))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
