"""K-Means passes over all starts and all K, and the silhouettes, against numpy."""

import numpy as np
import pytest

from ringlens.operators import kprototypes as KP
from ringlens.operators import lloyd as L


def _blobs(n=240, seed=1):
    rng = np.random.RandomState(seed)
    centres = np.array([[0, 0], [6, 0], [0, 7]])
    x = np.round(centres[np.arange(n) % 3] + rng.randn(n, 2), 4)
    return x, [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]


def _frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "call_id long, x double, y double").repartition(parts)


def plain_lloyd(x, centres, steps):
    for _ in range(steps):
        near = np.array([[((p - c) ** 2).sum() for c in centres] for p in x]).argmin(axis=1)
        centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, near


def plain_silhouette(d, labels):
    out = []
    for i, own in enumerate(labels):
        groups = {c: [d[i, j] for j in range(len(labels)) if labels[j] == c and j != i] for c in set(labels)}
        if not groups[own]:
            out.append(0.0)
            continue
        a = np.mean(groups[own])
        b = min(np.mean(v) for c, v in groups.items() if c != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_steps_of_all_models_in_one_pass(spark):
    x, rows = _blobs()
    df = _frame(spark, rows)
    models = {(2, 0): x[:2].copy(), (3, 0): x[[0, 1, 2]].copy(), (3, 1): np.array([[0.0, 0.0], [0.0, 0.0], [50.0, 50.0]])}
    fits = L.run_lloyd(df, ["x", "y"], models, max_iter=3, tol=0.0)
    for m, start in models.items():
        want, _ = plain_lloyd(x, start, 3)
        assert np.allclose(fits[m].centres, want, atol=1e-9), m
        near = ((x[:, None] - want[None]) ** 2).sum(axis=2).min(axis=1)
        assert abs(fits[m].cost - near.sum()) < 1e-6


def test_shares_of_stacked_models():
    rng = np.random.RandomState(3)
    x = np.round(rng.randn(700, 3), 1)  # many rows as far from one centre as from another
    models = [np.round(rng.randn(k, 3), 1) for k in (1, 2, 5)]
    models[2][4] = models[2][1]  # a centre that is twice there: the lower number has the rows
    edges = np.cumsum([0, 1, 2, 5])
    got = L._shares(x, np.vstack(models), edges)
    for centres, a in zip(models, edges):
        d = np.maximum(np.round(((x[:, None] - centres[None]) ** 2).sum(axis=2), L.DECIMALS), 0)
        near = d.argmin(axis=1)
        for c in range(len(centres)):
            own = x[near == c]
            want = [len(own), *own.sum(axis=0), (own * own).sum(), d[near == c, c].sum()]
            assert np.allclose(got[a + c], want, atol=1e-6), (a, c)


def test_a_pass_over_several_blocks(spark):
    x, rows = _blobs(3 * L.BLOCK + 1)
    models = {(3, 0): np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])}
    n, _, total, _ = L.lloyd_pass(_frame(spark, rows, 1), ["x", "y"], models)[3, 0]
    want, near = plain_lloyd(x, models[3, 0], 1)
    assert n.tolist() == np.bincount(near).tolist() and np.allclose(total / n[:, None], want, atol=1e-9)


def test_fit_finds_the_groups_and_does_not_depend_on_partitions(spark):
    x, rows = _blobs()
    fits = [L.fit_all(_frame(spark, rows, p), ["x", "y"], [2, 3, 4], starts=4, seed=7) for p in (1, 9)]
    best = plain_lloyd(x, np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]]), 30)[0]
    for f in fits:
        assert np.allclose(np.array(sorted(f[3].centres.tolist())), np.array(sorted(best.tolist())), atol=1e-3)
        assert f[4].cost < f[3].cost < f[2].cost and all(m.converged for m in f.values())
    assert all(np.allclose(fits[0][k].centres, fits[1][k].centres, atol=1e-9) for k in (2, 3, 4))


def test_draws_equal_the_portable_key(spark):
    from ringlens.operators.features import SAMPLE_PRIME, portable_key
    keys = [0, 1, 5, 2 ** 31 - 1, 2 ** 40 + 3]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(portable_key("k", 9)).collect()]
    assert np.allclose(L._draw(np.array(keys), 9) * SAMPLE_PRIME, want)


def test_squared_silhouettes(spark):
    x, rows = _blobs(60)
    rows.append((60, 100.0, 100.0))  # alone in its cluster
    x = np.vstack([x, [[100.0, 100.0]]])
    fits = {k: L.KMeansFit(("x", "y"), c, 0.0, 0, True) for k, c in
            ((2, np.array([[1.0, 1.0], [100.0, 100.0]])), (4, np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0], [100.0, 100.0]])), (1, np.array([[0.0, 0.0]])))}
    got = L.squared_silhouettes(_frame(spark, rows), ["x", "y"], fits)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for k in (2, 4):
        assert abs(got[k] - plain_silhouette(d, plain_lloyd(x, fits[k].centres, 1)[1].tolist())) < 1e-9
    assert got[1] == -1.0


def test_sampled_silhouette(spark):
    x, rows = _blobs(45)
    labels = [i % 4 if i < 44 else 9 for i in range(45)]
    df = spark.createDataFrame([(*r, c) for r, c in zip(rows, labels)], "call_id long, x double, y double, cluster_id int").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert abs(L.sampled_silhouette(df, ["x", "y"]) - plain_silhouette(d, labels)) < 1e-9
    assert np.isnan(L.sampled_silhouette(df.where("cluster_id = 1"), ["x", "y"]))


@pytest.mark.parametrize("bound", [100, 0])
def test_mixed_silhouette(spark, monkeypatch, bound):
    monkeypatch.setattr(KP, "BROADCAST_VALUES", bound)
    x, rows = _blobs(40)
    cats = [("a" if i % 3 else None, "pqr"[i % 5 % 3]) for i in range(40)]
    labels = [0 if i < 20 else 2 if i < 39 else 7 for i in range(40)]
    df = spark.createDataFrame([(*r, *c, g) for r, c, g in zip(rows, cats, labels)],
                               "call_id long, x double, y double, u string, v string, cluster_id int").repartition(3)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) + 0.7 * np.array([[sum(p != q for p, q in zip(a, b)) for b in cats] for a in cats])
    assert abs(KP.mixed_silhouette(df, ["x", "y"], ["u", "v"], 0.7) - plain_silhouette(d, labels)) < 1e-9


def test_all_k_of_k_prototypes_equal_single_fits(spark):
    rows = [(i, float(i % 3 * 4 + i % 5 * 0.1), "xyz"[i % 3], "pq"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "call_id long, n double, u string, v string")
    every, gamma = KP.fit_all_kprototypes(df, ["n"], ["u", "v"], [2, 3, 4])
    def rounded(fit):  # sums differ in their last digits by the order of addition
        return [([round(v, 9) for v in a], b) for a, b in fit.prototypes], fit.iterations, fit.converged

    for k in (2, 3, 4):
        assert rounded(KP.fit_kprototypes(df, ["n"], ["u", "v"], k, gamma)) == rounded(every[k])
    table = KP.select_k_mixed(df, ["n"], ["u", "v"], [2, 3]).collect()
    assert [r.k for r in table] == [2, 3] and table[1].silhouette > table[0].silhouette and table[1].cost < table[0].cost
