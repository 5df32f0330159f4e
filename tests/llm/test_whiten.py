"""Whitening: exact sums against plain integers, the query against numpy, ill-conditioned and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ringlens.llm import catalog, whiten

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, components=4):
    """Brute force on (vec_id, x) of one length: n, S, deviations, V as double, eigenvalues."""
    fit = sorted({tuple(x) for _, x in rows})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    d = len(s)
    v = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n ** 3 for j in range(d)] for i in range(d)])
    return n, s, {x: sum((n * a - b) ** 2 for a, b in zip(x, s)) for x in fit}, v


@pytest.mark.parametrize("spread,offset", [(300, 0), (5, -10 ** 6), (2 ** 61, 0), (1, 7)])
def test_bit_sliced_sums_are_exact(spread, offset):
    rng = random.Random(spread)
    x = [[rng.randrange(-spread, spread + 1) + offset for _ in range(5)] for _ in range(131)]
    sums, cross = whiten.bit_sliced_scatter(np.array(x, np.int64))
    assert list(sums) == [sum(r[i] for r in x) for i in range(5)]
    assert [list(r) for r in cross] == [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]


def test_query_against_numpy(spark):
    got = catalog.op13_whitening(spark, SF_SMALL).collect()
    src = [(r.vec_id, [math.floor(float(c) * 256) for c in r.embedding])
           for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    n, s, deviations, v = plain(src)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:4], axes[:, ::-1][:, :4]
    xs = {i: x for i, x in src}
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k) for i in xs for k in (1, 2, 3, 4))
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        k = r.component - 1
        want = (np.array(xs[r.vec_id]) - np.array(s) / n) @ axes[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * r.whitened))
        assert abs(r.whitened - signs.get(k, 1) * want) < 1e-9
        assert r.n == n and r.deviation == deviations[tuple(xs[r.vec_id])] == int(r.deviation_wide)
        assert abs(r.explained - e[k] / np.trace(v)) < 1e-12 and 0 <= r.identity_error < 1e-9


def test_repeated_vectors_count_once_in_the_fit(spark):
    rng = random.Random(3)
    base = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(40)]
    copies = [(100 + i, base[0][1]) for i in range(500)]
    once = {(r.vec_id, r.component): r for r in whiten.whiten(spark.createDataFrame(base, SCHEMA)).collect()}
    more = {(r.vec_id, r.component): r for r in whiten.whiten(spark.createDataFrame(base + copies, SCHEMA).repartition(7)).collect()}
    assert len(more) == 540 * 4 and all(r.n == 40 for r in more.values())
    assert all(abs(abs(more[k].whitened) - abs(once[k].whitened)) < 1e-12 for k in once)
    assert all(more[100, k] [1:] == more[300, k][1:] == more[0, k][1:] for k in (1, 2, 3, 4))


def test_large_offsets_and_unequal_scales(spark):
    """A common offset of 10^9 costs nothing, and variances 10^13 apart keep the small ones' digits."""
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-10 ** 6, 10 ** 6) * 4.0 + 1e9, *(rng.randrange(-9, 10) / 8 for _ in range(3))]) for i in range(300)]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    n, s, _, v = plain([(i, [math.floor(c * 256) for c in x]) for i, x in rows])
    small = np.linalg.eigvalsh((v - np.outer(v[:, 0], v[0]) / v[0, 0])[1:, 1:])[::-1]  # Schur complement: what the large one leaves
    by = {r.component: r for r in got}
    assert all(r.identity_error < 1e-6 for r in got)
    for k in (2, 3, 4):
        assert abs(by[k].explained * np.trace(v) / small[k - 2] - 1) < 1e-4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1e300, 0.0]), (6, []),
            (None, [0.5, -0.0]), (None, [0.5, 0.0]), (7, [1.0, 0.25]), (8, [-1.0, 2.0]), (9, [3.0]), (10, [1.0, 2.0, 3.0, 4.0, 9.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS component", "2 AS _x", "3 AS n")
    got = whiten.whiten(df).collect()
    ids = [(r.vec_id, r.component) for r in got]
    assert sorted(ids, key=str) == sorted([(None, 1), (None, 1), (None, 2), (None, 2), (7, 1), (7, 2), (8, 1), (8, 2), (9, 1),
                                           *((10, k) for k in (1, 2, 3, 4))], key=str)
    assert {r.n for r in got if r.vec_id in (None, 7, 8)} == {3}
    alone = [r for r in got if r.vec_id in (9, 10)]
    assert all((r.n, r.whitened, r.explained, r.identity_error, r.deviation) == (1, 0.0, 0.0, 0.0, 0) for r in alone)
    assert all(r.identity_error < 1e-9 for r in got)
    assert whiten.whiten(df.limit(0)).count() == 0
    wide = whiten.whiten(spark.createDataFrame([(1, [2.0 ** 53]), (2, [-(2.0 ** 53)])], SCHEMA)).collect()
    assert [r.deviation for r in wide] == [None, None] and {int(r.deviation_wide) for r in wide} == {2 ** 124}


def test_text_ids_and_float_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0]), ("c", [0.0, 0.5])], "vec_id string, embedding array<float>")
    assert {r.vec_id for r in whiten.whiten(df).where(F.col("component") == 2).collect()} == {"a", "b", "c"}
