"""Global cumulative counts and mid-ranks without a single-partition sort.

``Window.orderBy(x)`` with no partition key moves every row to one task. Here
the input is first reduced to one row per distinct value (map-side combine),
then cut into value ranges whose bounds are fixed once (approximate
quantiles of the distinct values, kept as literals of the plan, so every
re-evaluation - including task retries - cuts the same ranges). Each range
is summed with a window partitioned by the range, and shifted by the totals
of the preceding ranges. The offsets table has one row per (range, key); its
size is bounded by the number of ranges times the number of keys, not by the
data (broadcast when there are no keys). Callers pass a written table of value
counts (``sources.sinks.materialise``): the bounds, the local sums and the
totals all read it, and the rows are counted once.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(agg: DataFrame, order_col: str, ranges: int, rel_error: float = 0.001) -> list[float]:
    """Split points for ``ranges`` balanced value ranges (driver literals, <= ranges - 1 values)."""
    if ranges <= 1:
        return [-math.inf, math.inf]
    qs = [i / ranges for i in range(1, ranges)]
    probe = agg.select(F.col(order_col).cast("double").alias("_v")).filter(~F.isnan("_v"))
    bounds = probe.approxQuantile("_v", qs, rel_error)
    inner = sorted({b for b in bounds if b is not None and not math.isnan(b) and not math.isinf(b)})
    return [-math.inf, *inner, math.inf]


def join_groups(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """``left`` with the other columns of ``right`` for equal ``on`` columns, null equal to null.

    ``small`` broadcasts the right side; only for tables whose size has a proven bound.
    """
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    cond = F.col(on[0]).eqNullSafe(F.col(f"_r_{on[0]}"))
    for k in on[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(F.broadcast(named) if small else named, cond, how).drop(*[f"_r_{k}" for k in on])


def cumulative_before(agg: DataFrame, order_col: str, count_col: str, keys: list[str] | None = None,
                      ranges: int | None = None, total: str | None = None) -> DataFrame:
    """Add ``before`` = sum of ``count_col`` over rows with a smaller ``order_col`` (within ``keys``).

    ``total`` names a further column for the sum over all rows of the keys.

    ``agg`` must hold one row per (keys, order_col) and ``order_col`` must be
    numeric. NaN sorts after every number, as in Spark.
    """
    keys = list(keys or [])
    spark = agg.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = range_bounds(agg, order_col, n)
    if len(splits) < 3:  # a single range
        bucketed = agg.withColumn("_b", F.lit(0.0))
    else:
        src = agg.withColumn("_v", F.col(order_col).cast("double"))
        bucketed = Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(src) \
            .drop("_v")
    w = Window.partitionBy("_b", *keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumn("_local", F.coalesce(F.sum(count_col).over(w), F.lit(0)).cast("long"))
    totals = bucketed.groupBy("_b", *keys).agg(F.sum(count_col).alias("_tot"))
    wo = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(wo), F.lit(0)))
    if total:  # over the (range, key) totals, not over the values
        offsets = offsets.withColumn(total, F.sum("_tot").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("_tot")
    # without keys the offsets table has at most `ranges` rows and is broadcast; with keys its
    # size grows with the number of keys, so the join strategy is left to AQE
    out = join_groups(local, offsets, ["_b", *keys], small=not keys)
    before = (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).cast("long").alias("before")
    return out.select(*agg.columns, before, *([total] if total else []))


def midranks(agg: DataFrame, order_col: str, count_col: str, keys: list[str] | None = None) -> DataFrame:
    """Average (mid) rank of each distinct value: ``before + (count + 1) / 2``."""
    out = cumulative_before(agg, order_col, count_col, keys)
    return out.withColumn("midrank", F.col("before") + (F.col(count_col) + F.lit(1)) / F.lit(2.0))
