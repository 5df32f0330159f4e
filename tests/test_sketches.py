"""Stored sketches: merging, error bounds, one pass per new file."""

import os

import pytest
from pyspark.sql import functions as F

from ringlens.operators import sketches as S
from ringlens.sources.incremental import SOURCE


@pytest.fixture
def numbers(spark):
    """60,000 rows in 3 days: a skewed value, a key of 7,000 values, nulls and NaN."""
    x = F.col("id")
    return spark.range(60_000).select((x % 3).alias("day"), F.when(x % 10 == 0, None).when(x % 1000 == 1, float("nan"))
                                      .otherwise((x * 7919 % 10_007).cast("double") * (x % 5)).alias("v"), (x % 7000).alias("k"))


def test_merged_quantiles_stay_within_the_rank_error(spark, numbers):
    rows = S.sketch_rows(numbers.repartition(7), ["day"], numbers=["v"], counted=["k"])
    for by in (["day"], []):
        asked = S.sketched_quantiles(rows, by, "v", [0.0, 0.1, 0.5, 0.9, 1.0])
        off = S.rank_distance(numbers, asked, by, "v").collect()
        assert len(off) == 5 * (3 if by else 1) and all(r.off <= 2 * S.rank_error() for r in off)
    whole = {r.p: r for r in S.sketched_quantiles(rows, [], "v", [0.0, 1.0]).collect()}
    exact = numbers.where("v is not null and not isnan(v)").agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert (whole[0.0].value, whole[1.0].value, whole[0.0].valid) == tuple(exact)


def test_merged_distinct_counts(spark, numbers):
    rows = S.sketch_rows(numbers, ["day"], counted=["k"])
    r = S.sketched_distinct(rows, [], "k").first()
    assert r.n == 60_000 and abs(r.n_distinct - 7000) <= 5 * S.distinct_error() * 7000


def test_small_groups_are_exact_and_empty_ones_defined(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 2.0, 2), (None, 5.0, None), (None, None, 3), ("b", None, None)], "g string, v double, k int")
    rows = S.sketch_rows(df, ["g"], numbers=["v"], counted=["k"])
    assert {(r.g, r.p): r.value for r in S.sketched_quantiles(rows, ["g"], "v", [0.5, 1.0]).collect()} == \
        {("a", 0.5): 2.0, ("a", 1.0): 3.0, (None, 0.5): 5.0, (None, 1.0): 5.0}
    assert {r.g: (r.n, r.n_distinct) for r in S.sketched_distinct(rows, ["g"], "k").collect()} == {"a": (3, 2), None: (2, 1), "b": (1, 0)}
    assert all(r.off == 0 for r in S.rank_distance(df, S.sketched_quantiles(rows, ["g"], "v", [0.5]), ["g"], "v").collect())
    none = S.sketch_rows(df.limit(0), ["g"], numbers=["v"], counted=["k"])
    assert S.sketched_quantiles(none, [], "v", [0.5]).count() == 0 and S.sketched_quantiles(none, ["g"], "v", [0.5]).count() == 0


def test_store_reads_only_new_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def write(name, values, stamp):
        (source / f"{name}.csv").write_text("\n".join(f"{d},{v}" for d, v in values))
        os.utime(source / f"{name}.csv", (stamp, stamp))

    seen = []

    def read(paths):
        seen.append(sorted(os.path.basename(p) for p in paths))
        return spark.read.schema("day string, v double").csv(paths).withColumn(SOURCE, F.col("_metadata.file_path"))

    store = S.SketchStore(spark, str(tmp_path / "sketches"), read, ["day"], numbers=["v"], counted=["v"])

    def median():
        return {r.day: (r.valid, r.value) for r in S.sketched_quantiles(store.refresh(str(source)).rows, ["day"], "v", [0.5]).collect()}

    write("one", [("mon", 1), ("mon", 2), ("tue", 9)], 100)
    write("two", [("mon", 3)], 100)
    assert median() == {"mon": (3, 2.0), "tue": (1, 9.0)}
    write("three", [("tue", 1), ("tue", 2)], 100)
    assert median() == {"mon": (3, 2.0), "tue": (3, 2.0)}
    write("two", [("mon", 0), ("mon", 0), ("mon", 0)], 200)
    os.remove(source / "three.csv")
    assert median() == {"mon": (5, 0.0), "tue": (1, 9.0)}
    assert seen == [["one.csv", "two.csv"], ["three.csv"], ["two.csv"]]
    # other parameters hold none of the old sketches
    S.SketchStore(spark, str(tmp_path / "sketches"), read, ["day"], numbers=["v"], k=400).refresh(str(source))
    assert seen[-1] == ["one.csv", "two.csv"]
