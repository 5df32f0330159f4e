import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ringlens.functions.quantiles import nearest_quantiles
from ringlens.operators.clean import Fence, filter_outliers, flag_duration_outliers, prepare_calls
from ringlens.sources import calls as call_sources
from ringlens.sources.calls import load_raw, read_table
from ringlens.sources.sinks import attach_checkpoint, reuse_or_build


def test_quantile_definitions(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "x double")
    assert nearest_quantiles(df, "x", [0.25]) == [2.0]
    row = df.select(F.percentile("x", 0.25).alias("lin"), F.median("x").alias("med")).first()
    assert (row["lin"], row["med"]) == (1.75, 2.5)


def test_nearest_quantile_matches_sorted_list(spark):
    vals = [float((i * 37) % 101) for i in range(997)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    s = sorted(vals)
    for q in [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]:
        k = int((len(s) - 1) * q + 0.5)
        assert nearest_quantiles(df, "x", [q]) == [s[k]]


def test_prepare_and_flags(spark, calls_df):
    rows = [
        (1, "7", "  Aviso corte ", 1, None, True, " User_Hangup ", "abc", None, "{bad json", "2024-01-01 10:00:00"),
        (2, "7", "x", 1, "u2", None, None, "2000", "[]", '{"sentimiento":"","razon_churn":" No supo recargar "}',
         "2024-01-07 00:30:00.25"),
        (3, "7", "x", 1, "u3", False, "inactivity", "1000", '["User: a", null, "Agent: b"]', None, "garbage"),
    ]
    df = {r["call_id"]: r for r in prepare_calls(calls_df(rows)).collect()}
    assert df[1]["name"] == "Aviso corte" and df[1]["disconnected_reason"] == "user_hangup"
    assert df[1]["duration_ms"] is None and df[1]["inconsistency_flag"] is True
    assert df[1]["campaign_type"] == "aviso" and df[1]["pca_sentimiento"] is None
    assert df[2]["disconnected_reason"] == "unknown" and df[2]["inconsistency_flag"] is True
    assert df[2]["pca_sentimiento"] is None and df[2]["pca_razon_churn"] == "no_sabe_recargar"
    assert df[2]["transcript_text"] == "" and df[2]["transcript_length"] == 0
    assert (df[2]["hour"], df[2]["day_of_week"], df[2]["date"]) == (0, "do", "07/01/2024")
    assert df[3]["transcript_text"] == "User: a\nAgent: b" and df[3]["hour"] is None


def test_filters_drop_null_duration_and_hour0(spark, calls_df):
    rows = [(i, "1", "x", 1, f"u{i}", True, "user_hangup", None if d is None else str(d), None, None,
             f"2024-01-01 {h:02d}:00:00")
            for i, (d, h) in enumerate([(1000, 10), (2000, 10), (3000, 0), (None, 10), (4000, 11), (100000, 12)])]
    df = flag_duration_outliers(prepare_calls(calls_df(rows)))
    kept = {r["call_id"] for r in filter_outliers(df, Fence(1.0, 4.0)).collect()}
    assert kept == {0, 1, 4}


def test_load_raw_csv(spark):
    d = tempfile.mkdtemp(prefix="ringlens-csv-")
    p = os.path.join(d, "calls.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Campaign Id,Name,Target Id,Call URL,Connected,Disconnected Reason,Duration (ms),Transcript,"
                "Post Call Analysis,Executed At\n")
        f.write('007,Promo,11,https://x/1,true,user_hangup,1500,"[""User: hola"", ""Agent: ok""]",'
                '"{""sentimiento"": ""positivo""}",2024-03-01 10:00:00.123456\n')
        f.write("8,Aviso,12,NULL,false,NaN,nan,,,2024-03-02 11:00:00\n")
    df = load_raw(spark, p)
    rows = sorted(df.collect(), key=lambda r: r["target_id"])
    assert rows[0]["campaign_id"] == "7" and rows[0]["call_completed"] is True and rows[0]["connected"] is True
    assert rows[1]["call_url"] is None and rows[1]["disconnected_reason"] is None and rows[1]["duration_ms"] is None
    assert rows[1]["call_completed"] is False
    clean = prepare_calls(df).orderBy("target_id").collect()
    assert clean[0]["transcript_text"] == "User: hola\nAgent: ok" and clean[0]["pca_sentimiento"] == "positivo"
    assert clean[0]["hour"] == 10 and clean[0]["duration_sec"] == 1.5


def test_load_raw_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="ringlens-csv-")
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as f:
        f.write("Name,Connected\nx,true\n")
    with pytest.raises(ValueError, match="missing columns"):
        load_raw(spark, p)


def test_reuse_or_build_and_attach(spark):
    base = tempfile.mkdtemp(prefix="ringlens-stage-")
    calls = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "call_url string, v int")
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", "positivo"), ("a", "positivo")], "call_url string, sentiment_own string")

    ck = reuse_or_build(spark, base, "k1", build, expected_cols=["sentiment_own"])
    ck2 = reuse_or_build(spark, base, "k1", build, expected_cols=["sentiment_own"])
    assert len(built) == 1 and ck2.count() == 2
    out = {r["v"]: r["sentiment_own"] for r in attach_checkpoint(calls, ck, fill={"sentiment_own": "neutral"}).collect()}
    assert out == {1: "positivo", 2: "neutral", 3: "neutral"}


def test_normalize_raw_fills_missing_derived_columns(spark):
    from ringlens.sources.calls import normalize_raw

    raw = spark.createDataFrame(
        [("Promo x", "u1", "1500", "2024-03-01 10:00:00", '["User: muchas gracias, todo bien"]'),
         ("prueba", None, None, "2024-03-01 00:10:00", None)],
        "`Name` string, `Call URL` string, `Duration (ms)` string, `Executed At` string, `Transcript` string")
    out = {r["name"]: r for r in normalize_raw(raw).collect()}
    assert out["Promo x"]["duration_sec"] == 1.5 and out["Promo x"]["hour"] == 10
    assert out["Promo x"]["campaign_type"] == "promo" and out["Promo x"]["sentiment_own"] == "positivo"
    assert out["prueba"]["call_completed"] is False and out["prueba"]["campaign_type"] == "prueba"
    assert out["prueba"]["sentiment_own"] == "neutral" and out["prueba"]["hour"] == 0
    kept = normalize_raw(spark.createDataFrame([("x", "url", 7)], "name string, call_url string, hour int"))
    assert kept.first()["hour"] == 7


def test_content_key_does_not_depend_on_the_split(spark):
    from ringlens.sources.calls import content_key

    rows = spark.range(600).select((F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 == 0, "x").alias("b"))
    keys = [sorted(r["call_id"] for r in content_key(rows.repartition(n)).collect()) for n in (1, 5, 13)]
    assert keys[0] == keys[1] == keys[2] and len(set(keys[0])) == 600


def test_profile_counts_maps(spark):
    from ringlens.operators.profile import column_profile

    df = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), (None,), ({"a": 3},)], "m map<string,int>")
    for method in ("hash", "exact", "approx"):
        r = column_profile(df, method=method).first()
        assert (r["nulls"], r["n_distinct"]) == (1, 3)


def test_a_table_has_partitions_for_its_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(call_sources, "ROWS_PER_TASK", 20)
    many = read_table(spark, str(tmp_path), "t")
    assert many.rdd.getNumPartitions() == 50 and many.count() == 1000
    assert max(r[0] for r in many.groupBy(F.spark_partition_id()).count().select("count").collect()) <= 30
