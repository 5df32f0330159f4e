
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlens.functions.quantiles import group_quantiles
from ringlens.operators import clusters as CL
from ringlens.operators.features import assemble, fit_scaler, hash_sample, hash_sample_per_group, portable_key, share_sample
from ringlens.operators.kprototypes import fit_kprototypes


def _points(spark, parts=4):
    rng = np.random.RandomState(0)
    pts = []
    for cid, (cx, cy) in enumerate([(0, 0), (5, 5), (0, 6)]):
        for _ in range(40):
            pts.append((len(pts), float(cx + rng.randn()), float(cy + rng.randn()), cid))
    return spark.createDataFrame(pts, "call_id long, x double, y double, cluster_id int").repartition(parts), pts


def test_quality_metrics_against_numpy(spark):
    df, pts = _points(spark)
    q = CL.quality_metrics(df, ["x", "y"]).first()
    X = np.array([[p[1], p[2]] for p in pts])
    lab = np.array([p[3] for p in pts])
    k = 3
    cents = np.array([X[lab == i].mean(axis=0) for i in range(k)])
    s = np.array([np.linalg.norm(X[lab == i] - cents[i], axis=1).mean() for i in range(k)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(k) if j != i)
                  for i in range(k)])
    g = X.mean(axis=0)
    b = sum((lab == i).sum() * ((cents[i] - g) ** 2).sum() for i in range(k))
    w = sum(((X[lab == i] - cents[i]) ** 2).sum() for i in range(k))
    ch = (b / (k - 1)) / (w / (len(X) - k))
    assert abs(q["davies_bouldin"] - db) < 1e-9 and abs(q["calinski_harabasz"] - ch) < 1e-6


def test_assign_and_kmeans(spark):
    df, _ = _points(spark)
    a = CL.assign_to_centroids(df, ["x", "y"], [[0, 0], [5, 5], [0, 6]], out="p")
    agree = a.filter(F.col("p") == F.col("cluster_id")).count()
    assert agree >= 110
    sc = fit_scaler(df, ["x", "y"])
    vec = assemble(sc.transform(df), ["x_z", "y_z"])
    m = CL.fit_kmeans(vec, 3, n_init=2, max_iter=50)
    ids = {r[0] for r in m.transform(vec).select("prediction").distinct().collect()}
    assert ids <= {0, 1, 2}
    sil = CL.silhouette_sq(m.transform(vec))
    assert 0.5 < sil <= 1.0


def test_population_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    sc = fit_scaler(df, ["a", "b"])
    rows = sc.transform(df).orderBy("a").collect()
    assert [r["a_z"] for r in rows] == [-1.0, 1.0] and [r["b_z"] for r in rows] == [0.0, 0.0]


def test_hash_sample_reproducible(spark):
    base = spark.range(0, 1000).withColumnRenamed("id", "call_id").withColumn("g", F.col("call_id") % 3)
    s1 = sorted(r[0] for r in hash_sample(base.repartition(1), 25).select("call_id").collect())
    s2 = sorted(r[0] for r in hash_sample(base.repartition(9), 25).select("call_id").collect())
    assert s1 == s2 and len(s1) == 25
    g1 = hash_sample_per_group(base.repartition(5), "g", 4).collect()
    assert sorted(r["g"] for r in g1) == [0] * 4 + [1] * 4 + [2] * 4
    hot = base.withColumn("g", F.when(F.col("call_id") < 700, 0).otherwise(F.col("call_id")))
    g2 = hash_sample_per_group(hot, "g", 3, buckets=8)
    assert g2.filter("g = 0").count() == 3 and g2.count() == 3 + 300


def test_group_nearest_quantiles(spark):
    rows = [("a", float(v)) for v in range(1, 5)] + [("b", float(v)) for v in [5, 1, 3]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(r["g"], q): r[name] for r in group_quantiles(df, ["g"], "v", {"p25": ("nearest", 0.25), "p75": ("nearest", 0.75)}).collect()
           for name, q in (("p25", 0.25), ("p75", 0.75))}
    assert got == {("a", 0.25): 2.0, ("a", 0.75): 3.0, ("b", 0.25): 3.0, ("b", 0.75): 5.0}


def test_kprototypes(spark):
    rows = []
    for i in range(60):
        grp = i % 2
        rows.append((i, float(grp * 5 + (i % 5) * 0.1), "x" if grp else "y", "p" if i % 3 else "q"))
    df = spark.createDataFrame(rows, "call_id long, n double, c1 string, c2 string")
    out, protos, iters, cost, converged = fit_kprototypes(df, ["n"], ["c1", "c2"], 2, max_iter=10)
    labs = {r["call_id"]: r["cluster_id"] for r in out.collect()}
    assert set(labs.values()) <= {0, 1} and len(protos) == 2 and cost >= 0
    assert all(labs[i] == labs[i % 2] for i in range(60))


def test_cluster_ids_for_all_null_url(spark):
    df = spark.createDataFrame([(1, "u1", True, 2), (2, None, True, 1), (3, "u3", False, 0)],
                               "call_id int, call_url string, connected boolean, pred int")
    strict = {r["call_id"]: r["cluster_id"] for r in
              CL.cluster_ids_for_all(df, F.col("connected"), F.col("pred")).collect()}
    loose = {r["call_id"]: r["cluster_id"] for r in
             CL.cluster_ids_for_all(df, F.col("connected"), F.col("pred"), strict=False).collect()}
    assert strict == {1: 2, 2: -1, 3: -1} and loose == {1: 2, 2: 1, 3: -1}


def test_label_map_is_strict(spark):
    rows = spark.createDataFrame([(0, 1.0, 9), (7, 2.0, 10)], "cluster_id int, duration_sec double, hour int")
    assert {r["label"] for r in CL.cluster_profile(rows, labels={0: "a", 7: "b"}).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="no label for cluster 7"):
        CL.cluster_profile(rows, labels={0: "a"}).collect()


def test_share_sample_is_the_first_by_key(spark):
    rows = spark.range(1, 2001).withColumnRenamed("id", "call_id")
    want = [r[0] for r in rows.orderBy(portable_key("call_id")).limit(600).collect()]
    assert sorted(r[0] for r in share_sample(rows, 0.3, 500).collect()) == sorted(want)
    assert share_sample(rows, 0.01, 500).count() == 500
    assert share_sample(rows, 0.01, 5000).count() == 2000
    assert share_sample(rows.limit(0)).count() == 0


def test_lloyd_step_lowers_the_cost(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10, 11, 15)], "x double")
    first = {r["cluster_id"]: r for r in CL.lloyd_step(rows, ["x"], [[0.0], [9.0]]).collect()}
    assert [(r["n"], r["cost"], r["c_x"]) for _, r in sorted(first.items())] == [(3, 5.0, 1.0), (3, 41.0, 12.0)]
    assert sum(r["cost"] for r in CL.lloyd_step(rows, ["x"], [[1.0], [12.0]]).collect()) == 2.0 + 14.0
