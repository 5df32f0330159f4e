"""Samples of overlapping labels: brute force, ties, skew, one scan."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ringlens.operators.features import SAMPLE_BASE, SAMPLE_PRIME, labelled_samples


def test_overlapping_labels_against_brute_force(spark):
    """A hot label on every row, a rare one, one on no row; repeated and null keys; each label has its own n."""
    rows = [(i, i % 3 == 0, i % 97 == 0) for i in range(3000)] + [(6, True, False), (6, True, True), (None, True, False)]
    df = spark.createDataFrame(rows, "call_id long, third boolean, rare boolean").repartition(7)
    labels = [(F.lit("all"), 4), (F.when(F.col("third"), "third"), 9), (F.when(F.col("rare"), "rare"), 1000), (F.lit(None).cast("string"), 5)]
    got = {}
    for r in labelled_samples(df, labels).collect():
        got.setdefault(r["sample"], []).append(r.call_id)
    m = pow(SAMPLE_BASE, 1042, SAMPLE_PRIME)

    def first(keys, n):
        return sorted(keys, key=lambda k: (-1, 0) if k is None else (k % SAMPLE_PRIME * m % SAMPLE_PRIME, k))[:n]

    def same(a, b):
        return sorted(a, key=str) == sorted(b, key=str)

    assert set(got) == {"all", "third", "rare"}
    assert same(got["all"], first([r[0] for r in rows], 4))
    assert same(got["third"], first([r[0] for r in rows if r[1]], 9))
    assert same(got["rare"], [r[0] for r in rows if r[2]])


def test_one_scan_and_a_limit_before_the_shuffle(spark):
    for name in ["failure_examples", "audit_samples"]:
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan, name


def test_empty_table(spark):
    df = spark.createDataFrame([], "call_id long, a string")
    assert labelled_samples(df, [(F.col("a"), 3)]).count() == 0
