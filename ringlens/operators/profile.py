"""Data-audit operators (A28-A35): column profile, validation, cross-tabs, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens import constants as K
from ringlens.operators.clean import Fence, fence_condition, pre_fence_condition
from ringlens.operators.stats import segments


def _comparable(df: DataFrame, f: T.StructField):
    """The column as a value that can be hashed and compared: a map becomes its entries sorted by key."""
    c = F.col(f"`{f.name}`")
    return F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c


def column_profile(df: DataFrame, method: str = "hash", rsd: float = 0.01) -> DataFrame:
    """Per column type, nulls, valid, shares, distinct values counting null as a value.

    ``method``:

    * ``"hash"`` (default) - every cell becomes one narrow row
      (column index, 128-bit value hash from two seeded xxhash64, is-null),
      reduced by a single aggregation with map-side combine. Distinct counts
      are exact unless two different values of one column share all 128 hash
      bits (probability below 1e-14 even at 10^12 distinct values). The
      exchange carries 3 longs per distinct (column, value) and partition.
    * ``"exact"`` - distinct over the values themselves (Catalyst expands every
      row once per column, which carries wide rows through the shuffle).
    * ``"approx"`` - HyperLogLog (``approx_count_distinct``) with ``rsd``.
    """
    fields = df.schema.fields
    if method == "hash":
        cells = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(1), _comparable(df, f)).alias("h1"),
                     F.xxhash64(F.lit(2), _comparable(df, f)).alias("h2"),
                     F.col(f"`{f.name}`").isNull().alias("isnull"))
            for i, f in enumerate(fields)])).alias("c")).select("c.*")
        per_value = cells.groupBy("i", "h1", "h2", "isnull").agg(F.count(F.lit(1)).alias("n"))
        per_col = per_value.groupBy("i").agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.coalesce(F.sum(F.when(F.col("isnull"), F.col("n"))), F.lit(0)).alias("nulls"),
            F.sum("n").alias("__rows"),
        )
        names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                                "i int, column string, dtype string")
        long = names.join(F.broadcast(per_col), "i").drop("i")
    else:
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, f in enumerate(fields):
            c = _comparable(df, f)
            aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
            d = F.approx_count_distinct(c, rsd) if method == "approx" else F.count_distinct(c)
            aggs.append((d + F.max(c.isNull().cast("int"))).alias(f"d{i}"))
        wide = df.agg(*aggs)
        rows = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', n{i}, d{i}" for i, f in enumerate(fields))
        long = wide.selectExpr("__rows", f"stack({len(fields)}, {rows}) AS (column, dtype, nulls, n_distinct)")
    total = F.col("__rows")
    return long.select(
        "column", "dtype", F.col("nulls").cast("long").alias("nulls"),
        (total - F.col("nulls")).cast("long").alias("valid"),
        (F.col("nulls") / total).alias("pct_null"),
        ((total - F.col("nulls")) / total).alias("pct_valid"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
    )


def connected_totals(df: DataFrame) -> DataFrame:
    """Calls, connected and not connected."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("connected")).alias("connected"),
        F.count_if(~F.coalesce(F.col("connected"), F.lit(False))).alias("not_connected"),
    )


def raw_checks() -> dict[str, Column]:
    """The counts that need the raw text, as aggregates of the prepared table (for ``sinks.write_observed``)."""
    unread = F.get_json_object(F.col("post_call_analysis"), "$").isNull()
    return {"n_original": F.count(F.lit(1)),
            "bad_json_pca": F.count_if(F.col("post_call_analysis").isNotNull() & unread),
            "bad_json_transcript": F.count_if(F.col("transcript").isNotNull() & F.col("transcript_text").isNull())}


def validation_after_write(table: DataFrame, observed: dict, fence: Fence, exclude_test_campaign: bool = True,
                           expected_columns: list[str] | None = None) -> DataFrame:
    """``validation_report`` of a written stage table without raw text.

    ``observed``: the values of ``raw_checks`` taken while it was written. Only the counts behind the
    fence, whose limits are known after the write, scan the narrow table.
    """
    blank = [c for c in ("post_call_analysis", "transcript", "transcript_text") if c not in table.columns]
    rest = validation_report(table.withColumns({c: F.lit(None).cast("string") for c in blank}), fence, exclude_test_campaign, expected_columns)
    return rest.withColumns({name: F.lit(observed[name]).cast("long") for name in raw_checks()})


def validation_report(prepared: DataFrame, fence: Fence, exclude_test_campaign: bool = True,
                      expected_columns: list[str] | None = None) -> DataFrame:
    """Post-clean validation in one pass over the prepared (unfiltered) table.

    Rows kept by the filters are counted with the row-level filter predicate,
    so the clean table need not be joined or re-scanned.
    """
    expected = expected_columns or ["hour", "day_of_week", "day_of_month", "date", "duration_sec",
                                    "duration_outlier", "transcript_text", "transcript_length",
                                    "inconsistency_flag"] + [f"pca_{f}" for f in K.PCA_FIELDS]
    missing = [c for c in expected if c not in prepared.columns]
    kept = pre_fence_condition(exclude_test_campaign) & fence_condition(fence)
    kept = F.coalesce(kept, F.lit(False))
    raw_pca_ok = F.get_json_object(F.col("post_call_analysis"), "$").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n_original"),
        F.count_if(kept).alias("n_clean"),
        F.count_if(kept & F.col("executed_at").isNull()).alias("null_executed_at"),
        F.count_if(kept & F.col("inconsistency_flag")).alias("inconsistent"),
        F.count_if(F.col("post_call_analysis").isNotNull() & ~raw_pca_ok).alias("bad_json_pca"),
        F.count_if(F.col("transcript").isNotNull() & F.col("transcript_text").isNull()).alias("bad_json_transcript"),
    ]
    if "duration_outlier" in prepared.columns:
        aggs.append(F.count_if(kept & F.col("duration_outlier")).alias("outliers_p99"))
    out = prepared.agg(*aggs)
    return out.withColumn("missing_columns", F.array(*[F.lit(c) for c in missing]).cast("array<string>"))


def unexpected_values(df: DataFrame, col: str = "pca_sentimiento", domain=K.SENTIMENTS) -> DataFrame:
    """Values outside the domain (null allowed) and their counts."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(domain))) \
             .groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def connected_completed_crosstab(df: DataFrame) -> DataFrame:
    """Counts of the four (connected, call_completed) combinations and the equality verdict."""
    ct = df.groupBy("connected", "call_completed").agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy()
    differs = F.sum(F.when(~F.col("connected").eqNullSafe(F.col("call_completed")), F.col("n")).otherwise(0)).over(allw)
    return ct.withColumn("n_differing", differs).withColumn("columns_equal", F.col("n_differing") == 0)


def hour_distribution(df: DataFrame, candidate_hour: int = 0) -> DataFrame:
    """Calls per hour, share of all calls, candidate mark."""
    out = df.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({
        "pct": F.col("n") / F.sum("n").over(Window.partitionBy()),
        "candidate": F.coalesce(F.col("hour") == candidate_hour, F.lit(False)),
    })


def segment_summary(df: DataFrame) -> DataFrame:
    """Per audit segment: calls, connected, rate, transcript coverage."""
    seg = segments(df)
    has_t = F.coalesce(F.col("transcript_length") > 0, F.lit(False))  # length is null iff the text is
    out = seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("connected").cast("int")), F.lit(0)).alias("n_connected"),
        F.count_if(has_t).alias("n_transcript"),
    )
    return out.withColumns({"connection_rate": F.col("n_connected") / F.col("n"),
                            "transcript_rate": F.col("n_transcript") / F.col("n")})


def segment_distribution(df: DataFrame, category: str) -> DataFrame:
    """Distribution of ``category`` within each segment (connected calls)."""
    seg = segments(df.filter(F.col("connected")))
    out = seg.groupBy("segment", category).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy("segment")))
