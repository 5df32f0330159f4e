import math
from itertools import combinations

from pyspark.sql import functions as F

from ringlens.operators import stats as ST
from ringlens.operators.ranks import midranks


def _z(spark, n1, c1, n2, c2):
    df = spark.createDataFrame([(float(n1), float(c1), float(n2), float(c2))], "n1 double, c1 double, n2 double, c2 double")
    cols = ST.ztest_columns(F.col("n1"), F.col("c1"), F.col("n2"), F.col("c2"))
    r = df.select(cols["z"].alias("z"), cols["p_value"].alias("p")).first()
    return r["z"], r["p"]


def test_ztest_golden(spark):
    z, p = _z(spark, 153, 35, 73330, 13714)
    assert abs(z - 1.3225) < 1e-4 and abs(p - 0.18601) < 1e-5
    z, p = _z(spark, 4, 2, 73330, 13714)
    assert abs(z - 1.6052) < 1e-4 and abs(p - 0.10844) < 1e-5
    assert _z(spark, 10, 0, 20, 0) == (0.0, 1.0)


def test_normal_tail_matches_erfc(spark):
    zs = [i / 10 for i in range(-80, 81)]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(ST.two_sided_p(F.col("z"))).collect()]
    for z, p in zip(zs, got):
        assert abs(p - min(1.0, math.erfc(abs(z) / math.sqrt(2)))) < 1e-12


def _mw_brute(a, b):
    allv = sorted(a + b)
    rank = {}
    for v in set(allv):
        idx = [i + 1 for i, x in enumerate(allv) if x == v]
        rank[v] = sum(idx) / len(idx)
    return sum(rank[x] for x in a) - len(a) * (len(a) + 1) / 2


def _mw(spark, a, b, parts=3):
    rows = [("t", "a", float(x)) for x in a] + [("t", "b", float(x)) for x in b]
    df = spark.createDataFrame(rows, "test string, side string, v double").repartition(parts)
    return ST.mann_whitney(df, "v", "side", "test").first()


def test_mann_whitney_u_and_properties(spark):
    a = [1, 2, 2, 5, 7, 7, 7, 9, 12, 3.5]
    b = [2, 3, 4, 7, 8, 8, 10, 11, 13, 14, 1, 0]
    r = _mw(spark, a, b)
    assert r["u"] == _mw_brute(a, b)
    r2 = _mw(spark, b, a, parts=7)
    assert r["u"] + r2["u"] == len(a) * len(b)
    assert r["method"] == "asymptotic" and 0 < r["p_value"] <= 1


def test_mann_whitney_small_sides(spark):
    r = _mw(spark, [1.0], [2.0, 3.0, 4.0])
    assert math.isnan(r["u"]) and math.isnan(r["p_value"])
    r = _mw(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0])
    # exact: U=0, two-sided p = 2 / C(7,3)
    assert r["method"] == "exact" and r["u"] == 0.0 and abs(r["p_value"] - 2 / 35) < 1e-12


def test_midranks_partition_invariant(spark):
    vals = [(float(v % 17), 1) for v in range(500)]
    for parts in (1, 7, 64):
        agg = spark.createDataFrame(vals, "v double, one int").repartition(parts).groupBy("v").agg(F.count("*").alias("cnt"))
        r = midranks(agg, "v", "cnt")
        tot = r.agg(F.sum(F.col("cnt") * F.col("midrank"))).first()[0]
        assert tot == 500 * 501 / 2


def test_spearman_against_brute(spark):
    xs = [float((i * 7) % 13) for i in range(40)]
    ys = [float((i * 3) % 11) + (0.5 if i % 4 == 0 else 0) for i in range(40)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    rho = ST.spearman(df.withColumnRenamed("x", "a").withColumnRenamed("y", "b"), ["a", "b"]).first()["rho"]

    def ranks(v):
        s = sorted(v)
        return [(s.index(x) + 1 + s.index(x) + s.count(x)) / 2 for x in v]
    rx, ry = ranks(xs), ranks(ys)
    mx, my = sum(rx) / 40, sum(ry) / 40
    num = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    den = math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert abs(rho - num / den) < 1e-12


def test_eta_squared_small_and_value(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 5 else "b") for i in range(9)], "x double, c string")
    assert math.isnan(ST.eta_squared(df, ["x"], ["c"]).first()["eta_squared"])
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (7.0, "b"), (8.0, "b"), (9.0, "b")] * 2,
                               "x double, c string")
    e = ST.eta_squared(df, ["x"], ["c"]).first()["eta_squared"]
    xs = [1, 2, 3, 7, 8, 9] * 2
    g = sum(xs) / 12
    sst = sum((x - g) ** 2 for x in xs)
    ssb = 6 * (2 - g) ** 2 + 6 * (8 - g) ** 2
    assert abs(e - ssb / sst) < 1e-12


def test_cramers_v_golden_and_constant(spark):
    cells = [(True, True, 13751), (True, False, 0), (False, True, 16700), (False, False, 43036)]
    small = spark.createDataFrame(cells, "a boolean, b boolean, n int")
    df = small.select("a", "b", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_"))
    v = ST.cramers_v(df, ["a", "b"]).first()["cramers_v"]
    assert abs(v - 0.5703) < 1e-4
    const = spark.createDataFrame([("x", str(i % 3)) for i in range(30)], "a string, b string")
    assert math.isnan(ST.cramers_v(const, ["a", "b"]).first()["cramers_v"])


def test_pair_counts_are_those_of_the_rows(spark):
    rows = [(None if i % 5 == 0 else f"a{i % 3}", i % 4 == 0, None if i % 7 == 0 else i % 11, None) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b boolean, c int, d string").repartition(3)
    names, text = "abcd", lambda v: str(v).lower()
    want = {}
    for r in rows:
        for i, j in combinations(range(4), 2):
            if r[i] is not None and r[j] is not None:
                cell = names[i], names[j], text(r[i]), text(r[j])
                want[cell] = want.get(cell, 0) + 1
    for most in (1, 1000):
        cells = ST.pair_counts(df, list(names), most)
        assert "explode" not in cells._jdf.queryExecution().toString()
        assert {tuple(r)[:4]: r["o"] for r in cells.collect()} == want


def test_cramers_v_counts_its_rows_once(spark, tmp_path):
    spark.createDataFrame([(str(i % 2), str(i % 3), str(i % 5)) for i in range(60)], "a string, b string, c string").write.parquet(f"{tmp_path}/rows")
    out = ST.cramers_v(spark.read.parquet(f"{tmp_path}/rows"), ["a", "b", "c"])
    assert out.count() == 3
    assert all("contingency-cells" in f for f in out.inputFiles())  # the rows themselves are read by no later step


def test_cramers_v_general_grid(spark):
    rows = [("r1", "c1")] * 10 + [("r1", "c2")] * 5 + [("r2", "c2")] * 7 + [("r3", "c3")] * 4 + [("r2", "c1")] * 2
    df = spark.createDataFrame(rows, "a string, b string")
    v = ST.cramers_v(df, ["a", "b"]).first()["cramers_v"]
    ra = {"r1": 15, "r2": 9, "r3": 4}
    cb = {"c1": 12, "c2": 12, "c3": 4}
    obs = {}
    for r in rows:
        obs[r] = obs.get(r, 0) + 1
    n = len(rows)
    chi = sum((obs.get((a, b), 0) - ra[a] * cb[b] / n) ** 2 / (ra[a] * cb[b] / n) for a in ra for b in cb)
    assert abs(v - math.sqrt(chi / (n * 2))) < 1e-12


def test_exact_tail_against_all_rankings():
    for m, n in ((2, 2), (2, 5), (4, 6), (7, 8)):
        seen = {}
        for ranks in combinations(range(1, m + n + 1), m):
            u = sum(ranks) - m * (m + 1) // 2
            seen[u] = seen.get(u, 0) + 1
        for u in range(m * n + 1):
            assert abs(ST.exact_upper_tail(u, m, n) - sum(c for x, c in seen.items() if x >= u) / math.comb(m + n, m)) < 1e-14


def test_exact_tail_does_not_depend_on_a_size_limit():
    tails = [ST.exact_upper_tail(4 * n + n, 8, n) for n in (624_000, 626_000, 10**9)]
    assert max(tails) - min(tails) < 1e-5


def test_mann_whitney_all_ties(spark):
    r = _mw(spark, [1.0] * 9, [1.0] * 10)
    assert r["p_value"] == 1.0 and r["u"] == 45.0
    r = _mw(spark, [1.0, 1.0], [1.0, 1.0])
    assert r["p_value"] == 1.0


def test_spearman_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, b double")
    assert math.isnan(ST.spearman(df, ["a", "b"]).first()["rho"])


def test_recommendation_takes_the_first_of_two_twins(spark):
    rho = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.95), ("a", "d", float("nan"))], "col_a string, col_b string, rho double")
    eta = spark.createDataFrame([("a", "k", 0.5), ("b", "k", 0.5), ("c", "k", 0.01)], "num string, cat string, eta_squared double")
    v = spark.createDataFrame([("k", "f", 0.1)], "col_a string, col_b string, cramers_v double")
    out = {r["feature"]: r for r in ST.recommend_features(rho, eta, v, ["a", "b", "c", "d"], ["k"], ["f"]).collect()}
    assert out["b"]["redundant_with"] == "a" and not out["b"]["recommended"]
    assert out["a"]["recommended"] and out["c"]["redundant_with"] is None and not out["c"]["recommended"]
    assert out["d"]["strength"] == 0.0 and {r["algorithm"] for r in out.values()} == {"K-Means"}
