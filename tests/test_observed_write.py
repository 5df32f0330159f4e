"""Validation while writing: the counts of a write equal those of a scan."""

from ringlens.operators.clean import clean_limits, flag_duration_outliers, prepare_calls
from ringlens.operators.profile import raw_checks, validation_after_write, validation_report
from ringlens.sources.calls import normalize_raw
from ringlens.sources.sinks import write_observed

RAW = ["transcript", "post_call_analysis", "transcript_text"]


def _rows():
    good, bad = '{"sentimiento": "positivo"}', '{"sentimiento": '
    said = '[{"role": "user", "content": "hola"}]'
    return [(i, "c", "promo", i, f"u{i}", i % 3 > 0, "user_hangup", str(1000 * (i % 50 + 1)), said if i % 5 else "[{",
             good if i % 7 else bad, f"2024-01-{i % 28 + 1:02d} 10:00:00" if i % 11 else None) for i in range(300)] + [
        (900, None, None, None, None, None, None, None, None, None, None)]


def test_written_checks_equal_a_scan(spark, calls_df, tmp_path):
    prepared = prepare_calls(normalize_raw(calls_df(_rows())))
    path = str(tmp_path / "stage")
    # the stage table has no raw text: the checks are taken before those columns are dropped
    observed = write_observed(prepared.repartition(5), path, raw_checks())
    table = spark.read.parquet(path).drop(*RAW)
    p99, fence = clean_limits(table)
    expected = [c for c in table.columns if c not in RAW]
    scan = validation_report(flag_duration_outliers(prepared, p99=p99), fence, expected_columns=expected).first().asDict()
    written = validation_after_write(flag_duration_outliers(table, p99=p99), observed, fence, expected_columns=expected).first().asDict()
    assert written == scan
    assert scan["bad_json_pca"] > 0 and scan["n_original"] == 301 and scan["n_clean"] > 0


def test_empty_table_has_zero_counts(spark, calls_df, tmp_path):
    prepared = prepare_calls(normalize_raw(calls_df(_rows()))).where("rand() > 2")
    assert write_observed(prepared, str(tmp_path / "none"), raw_checks()) == {"n_original": 0, "bad_json_pca": 0, "bad_json_transcript": 0}
