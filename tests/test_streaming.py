import tempfile


from ringlens.operators.clean import prepare_calls
from ringlens.functions.quantiles import nearest_quantiles
from ringlens.sources.calls import load_calls
from ringlens.streaming.calls_stream import score_calls

from conftest import SF_SMALL


def test_row_stages_run_on_a_stream(spark):
    (p99,) = nearest_quantiles(prepare_calls(load_calls(spark, SF_SMALL)), "duration_ms", [0.99])
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    from ringlens.sources.calls import calls_from_events
    scored = score_calls(calls_from_events(stream), p99)
    assert scored.isStreaming
    ck = tempfile.mkdtemp(prefix="ringlens-stream-")
    q = (scored.select("call_id", "sentiment_own", "fail_inactivity", "duration_outlier")
         .writeStream.format("memory").queryName("scored_calls").option("checkpointLocation", ck)
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM scored_calls")
    batch = score_calls(load_calls(spark, SF_SMALL), p99).select("call_id", "sentiment_own", "fail_inactivity",
                                                                 "duration_outlier")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
