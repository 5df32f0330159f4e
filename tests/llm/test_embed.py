"""Multi-index near-dedup against brute force over all pairs."""

import numpy as np

from conftest import SF_MID, SF_SMALL
from ringlens.llm import catalog, embed


def brute(rows, least=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent = {i: i for i in range(len(rows))}
    links = [0] * len(rows)
    at = {id(r): i for i, r in enumerate(rows)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                    i, j = at[id(x)], at[id(y)]
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], low[find(i)], low[find(i)] == r[0]) for i, r in enumerate(rows))


def _compare(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.99


def test_query_equals_brute_force(spark):
    rows = [[r.vec_id, r.embedding, r.label] for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    _compare(sorted(tuple(r) for r in catalog.op4_multi_index(spark, SF_MID).collect()), brute(rows))


def test_near_copies_planted_in_the_table(spark):
    rng = np.random.default_rng(8)
    rows = [[r.vec_id, r.embedding, r.label] for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    for i in range(240):  # copies at cosines on both sides of the limit
        v = np.array(rows[i % 60][1])
        rows.append([10_000 + i, [float(np.float32(x)) for x in v + rng.normal(size=len(v)) * rng.choice([0, 0.01, 0.03, 0.05]) * np.linalg.norm(v)], rows[i % 60][2]])
    want = brute(rows)
    assert sum(w[1] for w in want) > 200
    df = spark.createDataFrame([tuple(r) for r in rows], "vec_id long, embedding array<float>, label int")
    _compare(sorted(tuple(r) for r in embed.near_duplicates(df).collect()), want)


def test_odd_rows_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 6))
    rows = [[i, [float(np.float32(x)) for x in base[i % 3] + rng.normal(scale=0.02, size=6)], i % 2] for i in range(90)]
    rows += [[100, None, 1], [101, [0.0] * 6, 1], [102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1], [103, [float("nan")] + [1.0] * 5, 1], [104, [], 0],
             [105, rows[0][1], None], [106, rows[0][1], 0], [107, rows[0][1], 0], [108, rows[0][1][:4], 0], [109, [float("inf")] * 6, 0], [106, rows[0][1], 0]]
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, cell string, n int")
    for block in (2_048, 7):
        monkeypatch.setattr(embed, "BLOCK", block)
        assert sorted(tuple(r) for r in embed.near_duplicates(df).collect()) == brute(rows)
    assert embed.near_duplicates(df.limit(0)).count() == 0
    assert embed.near_duplicates(df.where("vec_id between 100 and 104")).count() == 5


def test_multi_sequence_is_in_ascending_order():
    rng = np.random.default_rng(4)
    a, b = rng.random(7), rng.random(9)
    order = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")
    assert embed.multi_sequence(a, b, 63) == order.tolist()


def test_a_large_group_does_not_set_the_visits_of_small_ones(spark):
    """1,000 near copies in one place and pairs all over: the pairs' own recall must meet the target."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(1, 16)) + rng.normal(scale=0.02, size=(1_000, 16))
    one = rng.normal(size=(1_500, 16))
    two = one + rng.normal(scale=0.3, size=one.shape) * 0.95
    x = np.concatenate([hot, one, two]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.component_id for r in embed.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = [(1_000 + i, 2_500 + i) for i in range(1_500) if u[1_000 + i] @ u[2_500 + i] >= embed.MIN_COSINE]
    assert len(near) > 300
    together = np.mean([got[a] == got[b] for a, b in near])
    assert together >= 0.995


def test_a_pair_found_from_one_side_counts_for_both(spark, monkeypatch):
    """With few cells a walk many pairs are lost, but those that are joined have links at both ends."""
    monkeypatch.setattr(embed, "LEAST_VISITS", 2)
    rng = np.random.default_rng(6)
    one = rng.normal(size=(1_500, 8))
    x = np.concatenate([one, one + rng.normal(scale=0.2, size=one.shape)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows = embed.near_duplicates(df, target_recall=0.5).collect()
    size: dict = {}
    for r in rows:
        size[r.component_id] = size.get(r.component_id, 0) + 1
    pairs = [r for r in rows if size[r.component_id] == 2]
    assert len(pairs) > 200 and all(r.n_links == 1 for r in pairs)
    assert all((r.n_links == 0) == (size[r.component_id] == 1) for r in rows)


def test_null_large_and_text_ids(spark):
    """A null id in the table changes nothing for the others, whatever their size; norms neither overflow nor vanish."""
    big = 2 ** 60
    near = [[1.0, 0.01 * k, 0.0, 0.0] for k in range(4)]
    rows = [(big + 1 + 2 * k, v, 1) for k, v in enumerate(near)] + [(None, [1.0, 0.005, 0.0, 0.0], 1), (None, [0.0, 0.0, 1.0, 0.0], 2), (None, None, 1)]
    rows += [(50, [1e200, 0.0, 0.0, 1e200], 3), (51, [1e200, 1e190, 0.0, 1e200], 3), (52, [1e-200, 0.0, 0.0, 0.0], 4), (53, [0.0, 1e-200, 0.0, 0.0], 4)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert all(by[big + 1 + 2 * k] == (4, big + 1, k == 0) for k in range(4))
    assert by[50] == (1, 50, True) and by[51] == (1, 50, False) and by[52] == (0, 52, True) and by[53] == (0, 53, True)
    assert sorted((r.n_links, r.component_id or 0, r.kept) for r in got if r.vec_id is None) == [(0, 0, True), (0, 0, True), (4, big + 1, False)]
    text = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [1.0, 0.1], 1)], "vec_id string, embedding array<double>, label int")
    assert {(r.vec_id, r.component_id, r.kept) for r in embed.near_duplicates(text).collect()} == {("a", "a", True), ("b", "a", False)}
