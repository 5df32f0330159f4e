"""Row-level stages on a streaming DataFrame.

The cleaning, sentiment and failure stages hold no state, so the same column
expressions run unchanged under Structured Streaming. The two statistics the
batch path computes from the whole table (p99 outlier limit, IQR fence) are
passed in frozen - typically taken from the last batch run - instead of being
recomputed per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringlens.operators.clean import Fence, fence_condition, flag_duration_outliers, pre_fence_condition, prepare_calls
from ringlens.operators.failures import detect_failures
from ringlens.operators.sentiment import DEFAULT_LEXICON, Lexicon, analyze_sentiment
from ringlens.sources.calls import calls_from_events


def score_calls(df: DataFrame, p99: float, fence: Fence | None = None, lexicon: Lexicon = DEFAULT_LEXICON,
                exclude_test_campaign: bool = True) -> DataFrame:
    """Clean + sentiment + failure flags with frozen limits; works on batch and streaming input."""
    out = prepare_calls(df)
    out = flag_duration_outliers(out, p99=p99)
    out = analyze_sentiment(out, lexicon=lexicon)
    out = detect_failures(out)
    if fence is not None:
        out = out.filter(pre_fence_condition(exclude_test_campaign) & fence_condition(fence))
    return out


def events_stream(spark: SparkSession, events_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming call log from parquet ``events`` files arriving in ``events_dir``."""
    schema = spark.read.parquet(events_dir).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(events_dir)
    return calls_from_events(raw)
