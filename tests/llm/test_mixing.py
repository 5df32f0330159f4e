"""Mixing: rates against a direct solver, totals, held-out accuracy of the posteriors, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from ringlens.llm import catalog, mixing


def test_query_reaches_its_targets(spark):
    rows = catalog.op9_mixing(spark, SF_MID).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    p = rows[["p_good", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows.rate >= 0).all()
    totals = (rows.n_tokens * rows.rate).to_numpy() @ p
    want = np.array(list(mixing.TARGETS.values()))
    assert np.abs(totals / totals.sum() - want).max() < 0.002
    assert abs(totals[0] / (rows.n_tokens.to_numpy() @ p[:, 0]) - 1) < 0.002  # the kept domain stays whole
    assert (np.abs(rows.copies - rows.rate) < 1).all()


def test_rates_equal_a_direct_solver():
    """Long plain projected gradient gives the same domain totals as the accelerated steps."""
    rng = np.random.default_rng(1)
    n, p = rng.integers(1, 900, 400).astype(float), rng.dirichlet([0.3, 0.2, 0.2], 400)
    targets = np.array([0.5, 0.3, 0.2]) * n.sum()
    gram = (p * n[:, None]).T @ p / n.sum()
    step = 1 / np.linalg.eigvalsh(gram).max()
    plain = np.ones(400)
    for _ in range(20_000):
        plain = np.maximum(plain - step * (p @ ((n * plain) @ p - targets)) / n.sum(), 0)
    residuals: list = []
    for _ in range(60):
        residuals.append(((n * mixing._ahead_of(p, residuals, step, None)) @ p - targets) / n.sum())
    fast = mixing.rates_of(p, residuals, step, None)
    assert np.abs((n * plain) @ p - targets).max() < 1e-6 * n.sum()
    assert np.abs((n * fast) @ p - targets).max() < 2e-4 * n.sum()
    assert (mixing.rates_of(p, residuals, step, 1.0) <= 1).all()


def test_rare_domain_reaches_its_target(spark):
    """A domain of 0.02 % of the documents: the optimum meets all targets, and so must the fit."""
    rng = np.random.default_rng(3)
    z, n = rng.permutation(np.repeat([0, 1, 2], [13_996, 6_000, 4])), rng.integers(50, 900, 20_000)
    p = np.full((20_000, 3), 0.0005)
    p[np.arange(20_000), z] = 0.999
    table = spark.createDataFrame(list(zip(n.tolist(), p.tolist())), "n_tokens long, p array<double>")
    targets, totals = mixing.solve(table, np.array([0.85, 0.1, 0.05]))[2:4]
    assert np.abs(totals / targets - 1).max() < 1e-3
    assert mixing.solve(table, np.array([0.85, 0.1, 0.05]))[4]
    assert not mixing.solve(table, np.array([0.85, 0.1, 0.05]), steps=0)[4]


def test_posteriors_hold_on_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    model = mixing.fit_classifier(docs, labels.where("doc_id % 4 <> 0"))
    seen = mixing.posteriors(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    low = [r.p[1] > 0.5 for r in seen if r.quality == 0 and r.toxic == 0]
    good = [r.p[0] > 0.5 for r in seen if r.quality == 1 and r.toxic == 0]
    assert sum(low) / len(low) > 0.7 and sum(good) / len(good) > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words stand here %d" % i if i % 2 else "### $$$ %d" % i, 0.5, 7) for i in range(200)]
                                 + [(500, None, 0.5, 7), (501, "", 0.5, 7), (None, "good words", 0.5, 7), (502, "w " * 100_000, 0.5, 7), (3, "good words stand here 3", 0.5, 7)],
                                 "doc_id long, text string, rate double, copies int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix_documents(docs, labels).collect()
    assert len(out) == 205 and all(r.rate >= 0 for r in out)
    kept = mixing.apply_mix(docs, labels, most=1.0)
    assert kept.columns == docs.columns
    odd = [r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 2]
    assert len(odd) >= 100  # the kept domain
    assert {r.rate for r in mixing.mix_documents(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix_documents(docs.limit(0), labels).count() == 0


def test_prior_of_empty_texts_and_rows_of_one_id(spark):
    docs = [(i, ("good words here " if i % 4 else "BUY now !! ") * 20) for i in range(100)] + [(200, ""), (201, None), (0, "good words here " * 20)]
    labels = [(i, int(bool(i % 4)), 0) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS _copies", "3 AS th", "4 AS row", "5 AS times", "6 AS copies")
    two = {n: mixing.DOMAINS[n] for n in ("good", "low")}
    out = mixing.mix_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"good": 0.9, "low": 0.1}, two).collect()
    assert all(abs(r.p_good - 75 / 101) < 1e-9 for r in out if r.doc_id in (200, 201))  # shares of the training rows
    kept = mixing.apply_mix(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), targets={"good": 0.95, "low": 0.05}, domains=two, most=1.0)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == d.columns and (0, "good words here " * 20) in rows and len(rows) == len(set(rows))


def test_draws_hold_their_share_at_any_size(spark):
    from ringlens.llm.common import drawn
    rows = spark.range(200_000)
    share = rows.where(drawn(F.xxhash64("id"), 2_000, 200_000)).count()
    assert 1_700 < share < 2_300
    for n in (10 ** 11, 10 ** 15):  # the bound is a whole number of 40-bit steps, never none
        assert rows.select(drawn(F.lit(0).cast("long"), 2_000, n).alias("in")).first()["in"]
