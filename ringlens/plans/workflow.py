"""End-to-end run over a raw calls CSV: load -> clean -> sentiment -> failures -> filters -> clusters -> tables.

The same stage order as the original command-line run, expressed as Spark
jobs: the scored table is written once (Parquet) and every later step and
report reads it; the two data-dependent limits (p99, IQR fence) are computed
once and applied as literals; cluster ids are attached to every call in the
assignment pass (no join back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens.operators import clusters as CL
from ringlens.operators import contact
from ringlens.operators.clean import clean_limits, fence_condition, flag_duration_outliers, pre_fence_condition, prepare_calls
from ringlens.operators.failures import detect_failures, failure_summary
from ringlens.operators.features import hash_sample_per_group
from ringlens.operators.sentiment import DEFAULT_LEXICON, Lexicon, analyze_sentiment
from ringlens.sources.calls import load_raw
from ringlens.sources.sinks import write_samples_csv, write_table


#: Calls of each campaign type in the audit sample.
AUDIT_ROWS = 20


def audit_sample(calls: DataFrame, group: str, n: int = AUDIT_ROWS) -> DataFrame:
    """Up to ``n`` calls of every group, the same in any partitioning, without nested columns (they have no CSV form)."""
    flat = [c for c, t in calls.dtypes if not t.startswith(("array", "struct", "map"))]
    keyed = calls.select(*flat).withColumn("audit_key", F.xxhash64("call_id"))
    return hash_sample_per_group(keyed, group, n, key="audit_key").drop("audit_key")


def run_calls_workflow(spark: SparkSession, raw_csv: str, out_dir: str, k: int = 4, n_init: int = 10,
                       lexicon: Lexicon = DEFAULT_LEXICON, exclude_test_campaign: bool = True) -> dict[str, DataFrame]:
    """Run all stages on ``raw_csv``; write the stage tables under ``out_dir``; return the main reports.

    Tables written: ``calls_scored`` (every call with cleaning columns, own
    sentiment, failure flags, outlier flag, kept flag and cluster id; raw text
    dropped), ``calls_clean`` (rows kept by the filters) and
    ``clusters_contacts`` (clean connected calls with their cluster); as CSV for reading by
    eye, ``samples_by_campaign`` (some clean calls of every campaign type).
    """
    out = out_dir.rstrip("/")
    raw = load_raw(spark, raw_csv)
    scored = detect_failures(analyze_sentiment(prepare_calls(raw), lexicon=lexicon))
    write_table(scored.drop("transcript", "post_call_analysis"), f"{out}/_scored_stage")
    base = spark.read.parquet(f"{out}/_scored_stage")

    p99, fence = clean_limits(base, exclude_test_campaign)
    base = flag_duration_outliers(base, p99)
    kept = F.coalesce(pre_fence_condition(exclude_test_campaign) & fence_condition(fence), F.lit(False))
    base = base.withColumn("kept", kept)
    clustered = CL.kmeans_all_calls(base, F.col("kept") & F.col("connected"), k=k, n_init=n_init)
    final = clustered.select(*base.columns, "cluster_id")
    write_table(final, f"{out}/calls_scored")

    calls = spark.read.parquet(f"{out}/calls_scored")
    write_table(calls.filter("kept").drop("kept"), f"{out}/calls_clean")
    write_table(calls.filter(F.col("kept") & F.col("connected")), f"{out}/clusters_contacts")
    clean = spark.read.parquet(f"{out}/calls_clean")
    write_samples_csv(audit_sample(clean, "campaign_type"), f"{out}/samples_by_campaign")
    return {
        "calls": calls,
        "clean": clean,
        "connection_by_hour": contact.connection_rate(clean, "hour"),
        "connection_by_day": contact.connection_rate_by_day(clean),
        "connection_by_campaign": contact.connection_rate(clean, "campaign_type"),
        "top_windows": contact.top_windows(clean),
        "window_score": contact.window_score(clean),
        "failures": failure_summary(clean),
        "limits": spark.createDataFrame([(p99, fence.q1, fence.q3, fence.lower, fence.upper)],
                                        "p99_ms double, q1 double, q3 double, lower double, upper double"),
        "cluster_sizes": clean.filter("connected").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")),
    }

