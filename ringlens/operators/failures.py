"""Agent-failure flags (G1-G5) and their summaries.

Flags are set only on connected calls; other rows get False.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.categorical import any_true
from ringlens.functions.text import normalize_text, speaker_lines


def repeated_agent_line(text_col: str = "transcript_text", min_chars: int = K.REPEAT_MIN_CHARS,
                        min_repeat: int = K.REPEAT_MIN_COUNT) -> Column:
    """Some agent line longer than ``min_chars`` (raw length) repeats >= ``min_repeat`` times after normalisation."""
    long_lines = F.filter(speaker_lines(text_col, "Agent"), lambda l: F.length(l) > min_chars)
    norm = F.transform(long_lines, lambda l: normalize_text(l))
    if min_repeat == 2:
        return F.size(norm) > F.size(F.array_distinct(norm))
    return F.exists(norm, lambda x: F.size(F.filter(norm, lambda y: y == x)) >= min_repeat)


def detect_failures(df: DataFrame, short_call_sec: float = K.SHORT_CALL_SEC, strict_nulls: bool = False) -> DataFrame:
    """Add the five ``fail_*`` booleans. Missing ``sentiment_own`` counts as neutral."""
    connected = F.coalesce(F.col("connected"), F.lit(False))
    sent = F.col("sentiment_own") if "sentiment_own" in df.columns else F.lit("neutral")
    reason = F.col("disconnected_reason")
    recov = F.col("pca_posible_recuperacion")
    # normalised long agent lines, materialised once (referenced twice by the test)
    long_lines = F.filter(speaker_lines("transcript_text", "Agent"), lambda l: F.length(l) > K.REPEAT_MIN_CHARS)
    df = df.withColumn("_agent", F.transform(long_lines, lambda l: normalize_text(l)))
    repetitive = F.size("_agent") > F.size(F.array_distinct("_agent"))
    if strict_nulls:
        repetitive = F.when(F.col("transcript_text").isNull(), F.lit(None).cast("boolean")).otherwise(repetitive)
    flags = {
        "fail_repetitive": repetitive,
        "fail_inactivity": reason == "inactivity",
        "fail_objection": F.col("pca_razon_churn").isNotNull() & (sent == "negativo")
        & (recov.isNull() | F.lower(recov).isin("no")),
        "fail_misunderstanding": (F.coalesce(F.col("duration_sec"), F.lit(0.0)) < short_call_sec)
        & (reason == "user_hangup") & (sent == "negativo"),
        "fail_agent_hangup": reason == "agent_hangup",
    }
    return df.withColumns({k: F.when(connected, v).otherwise(F.lit(False)) for k, v in flags.items()}).drop("_agent")


def failure_summary(df: DataFrame) -> DataFrame:
    """Count and rate of each failure over connected calls, plus any-failure, as a long table."""
    conn = df.filter(F.col("connected"))
    aggs = [F.count(F.lit(1)).alias("n_connected")]
    aggs += [F.sum(F.col(c).cast("int")).alias(c) for c in K.FAIL_COLUMNS]
    aggs.append(F.sum(any_true(K.FAIL_COLUMNS).cast("int")).alias("any_failure"))
    wide = conn.agg(*aggs)
    names = K.FAIL_COLUMNS + ["any_failure"]
    stack = "stack({}, {}) AS (failure, n)".format(len(names), ", ".join(f"'{n}', `{n}`" for n in names))
    long = wide.selectExpr("n_connected", stack)
    return long.select(
        "failure",
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        "n_connected",
        (F.coalesce(F.col("n"), F.lit(0)) / F.col("n_connected")).alias("rate"),
    )


def failure_rates_by(df: DataFrame, by: str) -> DataFrame:
    """Per group of connected calls: n, count and rate of each failure."""
    conn = df.filter(F.col("connected"))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(c).cast("int")).alias(f"n_{c[5:]}") for c in K.FAIL_COLUMNS]
    out = conn.groupBy(by).agg(*aggs)
    return out.withColumns({f"rate_{c[5:]}": F.col(f"n_{c[5:]}") / F.col("n") for c in K.FAIL_COLUMNS})
