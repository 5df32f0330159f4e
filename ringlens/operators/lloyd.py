"""K-Means with every start and every K in the same passes, and silhouettes (M5, M6, M9).

A fit is a set of models, one for each (K, start). Each pass over the rows serves all models
that still move: a task computes, for its Arrow batches, the distances to all centres of all
models as one matrix product and keeps only sums by (model, cluster); Spark adds them up and
the driver receives K rows for each model. So choosing among five K with ten starts costs as many
passes as the slowest of the fifty fits, not their sum.

The starts are k-means|| draws from ``portable_key``: the same rows give the same draws in
any partitioning. The candidates of a start (2 K_max a round, in expectation) serve all its K.

Distances are compared to nine decimals, so that rows equally far from two centres go to the
lower number whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.operators.features import SAMPLE_BASE, SAMPLE_PRIME, portable_key

#: Model of a fit: (K, start).
Model = tuple[int, int]
#: Rounds of draws after the first centre.
DRAWS = 2
#: Decimals to which distances are compared.
DECIMALS = 9
#: Rows whose distances to all centres a task holds at once.
BLOCK = 2500


@dataclass(frozen=True)
class KMeansFit:
    """The best start for one K: ``centres`` (K, dims), training ``cost``, passes taken, whether it settled."""

    columns: tuple[str, ...]
    centres: np.ndarray
    cost: float
    iterations: int
    converged: bool


def _points(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(dims)])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centres)."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(np.round(d, DECIMALS), 0.0)


def _by_model(rows: DataFrame, cols: list[str], sums: Callable[[np.ndarray, np.ndarray | None], Iterator[tuple[int, int, np.ndarray]]],
              width: int, key: str | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Sums of ``width`` numbers by (model number, cluster) over one pass: ``sums(points, keys)`` gives a batch's share."""
    dims = len(cols)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(dims).to_numpy(zero_copy_only=False) if key else None
                for m, c, v in sums(_points(batch, dims), keys):
                    total[m, c] = total[m, c] + v if (m, c) in total else v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                 *(pa.array([v[i] for v in total.values()], pa.float64()) for i in range(width))], ["model", "cluster", *(f"v{i}" for i in range(width))])

    schema = "model int, cluster int, " + ", ".join(f"v{i} double" for i in range(width))
    out = rows.select(*cols, *([key] if key else [])).mapInArrow(task, schema).groupBy("model", "cluster").agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect()  # one row for each cluster of each model
    return {(r["model"], r["cluster"]): np.array(r[2:], float) for r in out}


def _shares(x: np.ndarray, stacked: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(n, sums of the columns, sum of squared norms, cost) of some rows for every centre of every model.

    Centre ``i`` of the stack is of the model whose ``edges`` enclose it. Distances stand centre by centre,
    as whole numbers of the last decimal, so that the nearest is found by comparing whole rows of them.
    """
    square, unit = (x * x).sum(axis=1), 10.0 ** DECIMALS
    d = -2 * stacked @ x.T
    d += square
    d += (stacked * stacked).sum(axis=1)[:, None]
    d *= unit
    np.maximum(np.rint(d, out=d), 0.0, out=d)
    member, cost = np.zeros(d.shape), np.zeros(len(stacked))
    for a, b in zip(edges[:-1], edges[1:]):
        near, least = np.zeros(len(x), np.intp), d[a].copy()
        for c in range(1, b - a):
            np.putmask(near, d[a + c] < least, c)
            np.minimum(d[a + c], least, out=least)
        np.equal(near, np.arange(b - a)[:, None], out=member[a:b])
        cost[a:b] = np.bincount(near, least / unit, minlength=b - a)
    return np.column_stack([member @ np.column_stack([np.ones(len(x)), x, square]), cost])


def lloyd_pass(rows: DataFrame, cols: list[str], models: dict[Model, np.ndarray]) -> dict[Model, tuple[np.ndarray, ...]]:
    """One update of all models: (n, cost, sums of the columns, sum of squared norms) by cluster, for the given centres."""
    names, dims = list(models), len(cols)
    stacked = np.vstack([models[m] for m in names])
    edges = np.cumsum([0, *(len(models[m]) for m in names)])

    def sums(x, _):
        every = sum(_shares(x[at:at + BLOCK], stacked, edges) for at in range(0, len(x), BLOCK))
        for i in range(len(names)):
            share = every[edges[i]:edges[i + 1]]
            for c in np.flatnonzero(share[:, 0]):
                yield i, int(c), share[c]

    got = _by_model(rows, cols, sums, dims + 3)
    out = {}
    for i, m in enumerate(names):
        by = np.array([got.get((i, c), np.zeros(dims + 3)) for c in range(len(models[m]))])
        out[m] = (by[:, 0], by[:, dims + 2], by[:, 1:dims + 1], by[:, dims + 1])
    return out


def _draw(keys: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for integer row keys: ``portable_key`` over its modulus."""
    factor = np.int64(pow(SAMPLE_BASE, 1000 + seed, SAMPLE_PRIME))
    return (keys.astype(np.int64) % SAMPLE_PRIME * factor % SAMPLE_PRIME) / SAMPLE_PRIME


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over a start's few candidates, then Lloyd steps among them."""
    rng = np.random.RandomState(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        far = weights * _distances(points, points[chosen]).min(axis=1)
        chosen.append(int(rng.choice(len(points), p=far / far.sum())) if far.sum() > 0 else chosen[0])
    centres = points[chosen].copy()
    for _ in range(30):
        near = _distances(points, centres).argmin(axis=1)
        moved = np.array([np.average(points[near == c], axis=0, weights=weights[near == c]) if weights[near == c].sum() else centres[c] for c in range(k)])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def parallel_starts(rows: DataFrame, cols: list[str], ks: list[int], starts: int, seed: int, key: str) -> dict[Model, np.ndarray]:
    """k-means|| centres of every (K, start); the draws of all starts share their passes."""
    point = F.struct(*cols)
    first = rows.agg(*[F.min_by(point, F.struct(portable_key(key, seed + s), F.col(key))).alias(f"p{s}") for s in range(starts)]).first()
    if first is None or first[0] is None:
        return {}
    sets = [np.array([list(first[s])], float) for s in range(starts)]
    want, dims = 2 * max(ks), len(cols)

    def costs(x, _):
        for s, c in enumerate(sets):
            yield s, 0, np.array([_distances(x, c).min(axis=1).sum()])

    for r in range(DRAWS):
        total = _by_model(rows, cols, costs, 1)

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, keys = _points(batch, dims), batch.column(dims).to_numpy(zero_copy_only=False)
                for s, c in enumerate(sets):
                    cost = total[s, 0][0]
                    p = want * _distances(x, c).min(axis=1) / cost if cost > 0 else np.zeros(len(x))
                    hit = np.flatnonzero(_draw(keys, seed + starts * (r + 1) + s) < p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), s, np.int32)), *(pa.array(v) for v in x[hit].T)],
                                                     ["start", *(f"v{i}" for i in range(dims))])

        schema = "start int, " + ", ".join(f"v{i} double" for i in range(dims))
        new = rows.select(*cols, key).mapInArrow(drawn, schema).distinct().collect()  # about `want` rows a start
        sets = [np.unique(np.vstack([c, *([list(row[1:])] for row in new if row[0] == s)]), axis=0) for s, c in enumerate(sets)]

    weights = lloyd_pass(rows, cols, {(0, s): c for s, c in enumerate(sets)})
    return {(k, s): _reduced(c, weights[0, s][0], k, seed + s) for s, c in enumerate(sets) for k in ks}


def drawn_starts(rows: DataFrame, cols: list[str], ks: list[int], starts: int, seed: int, key: str) -> dict[Model, np.ndarray]:
    """Plain starts: for start s the K rows that come first by ``portable_key(key, seed + s)``."""
    out = {}
    for s in range(starts):
        first = rows.orderBy(portable_key(key, seed + s), key).limit(max(ks)).select(*cols).collect()
        out |= {(k, s): np.array([list(r) for r in first[:k]], float) for k in ks if len(first) >= k}
    return out


def run_lloyd(rows: DataFrame, cols: list[str], models: dict[Model, np.ndarray], max_iter: int, tol: float) -> dict[Model, KMeansFit]:
    """Lloyd steps for all models at once; a model leaves the passes when no centre moves by more than ``tol``."""
    centres, settled, steps = dict(models), {}, dict.fromkeys(models, 0)
    for _ in range(max_iter):
        moving = {m: c for m, c in centres.items() if m not in settled}
        if not moving:
            break
        for m, (n, _, total, _) in lloyd_pass(rows, cols, moving).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[m])  # a centre without rows stays
            steps[m] += 1
            if ((new - centres[m]) ** 2).sum(axis=1).max() <= tol * tol:
                settled[m] = True
            centres[m] = new
    final = lloyd_pass(rows, cols, centres) if centres else {}
    return {m: KMeansFit(tuple(cols), centres[m], float(final[m][1].sum()), steps[m], m in settled) for m in centres}


def fit_all(rows: DataFrame, cols: list[str], ks, starts: int = 10, max_iter: int = 150, seed: int = 42, tol: float = 1e-4,
            key: str = "call_id") -> dict[int, KMeansFit]:
    """The best of ``starts`` fits for every K of ``ks``; the earliest of those that cost the same but for rounding.

    ``rows`` is a stored table.
    """
    numeric = isinstance(rows.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType))
    keyed = rows.select(*cols, (F.abs(F.col(key)) if numeric else F.pmod(F.xxhash64(key), F.lit(SAMPLE_PRIME))).cast("long").alias("_key")).na.fill(0, ["_key"])
    fits = run_lloyd(rows, cols, parallel_starts(keyed, cols, list(ks), starts, seed, "_key"), max_iter, tol)
    out = {}
    for k in ks:
        own = [f for (of, _), f in sorted(fits.items()) if of == k]
        least = min((f.cost for f in own), default=0.0)
        out |= {k: next(f for f in own if f.cost <= least * (1 + 1e-9))} if own else {}
    return out


# --- silhouettes ---

def squared_silhouettes(rows: DataFrame, cols: list[str], fits: dict[int, KMeansFit]) -> dict[int, float]:
    """Mean silhouette over squared distances for every fit, in two passes: cluster sums, then the rows' values.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.S / n + Q / n; in its own cluster a row is left
    out (times n / (n - 1)). A row alone in its cluster counts 0. -1 where only one cluster has rows.
    """
    models = {(k, 0): f.centres for k, f in fits.items()}
    stats, names = lloyd_pass(rows, cols, models), list(models)

    def sums(x, _):
        square = (x * x).sum(axis=1)
        for i, m in enumerate(names):
            near = _distances(x, models[m]).argmin(axis=1)
            n, _, total, norm = stats[m]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = square[:, None] - 2 * (x @ total.T) / n + norm / n
            mean[:, n == 0] = np.inf
            at = np.arange(len(x))
            own_n = n[near]
            own = mean[at, near] * own_n / np.maximum(own_n - 1, 1)
            mean[at, near] = np.inf
            other = mean.min(axis=1)
            most = np.maximum(own, other)
            s = np.where((own_n > 1) & (most > 0), (other - own) / np.where(most > 0, most, 1), 0.0)
            yield i, 0, np.array([s.sum(), len(x)])

    several = [m for m in names if (stats[m][0] > 0).sum() > 1]
    got = _by_model(rows, cols, sums, 2) if several else {}
    return {m[0]: float(got[i, 0][0] / got[i, 0][1]) if m in several else -1.0 for i, m in enumerate(names)}


def sampled_silhouette(sample: DataFrame, cols: list[str], cluster: str = "cluster_id") -> float:
    """M9: mean silhouette over Euclidean distances inside a bounded sample.

    The sample (its size is the caller's parameter) is held as one array for each cluster; every row
    adds up its distances to each array where it stands, so no pair of rows leaves a task. A row alone
    in its cluster counts 0; NaN where fewer than two clusters have rows.
    """
    held = sample.select(F.col(cluster).cast("int"), *cols).collect()
    labels = sorted({r[0] for r in held})
    if len(labels) < 2:
        return float("nan")
    arrays = [np.array([r[1:] for r in held if r[0] == c], float) for c in labels]
    dims = len(cols)

    def sums(x, own_label):
        means = np.empty((len(x), len(labels)))
        own = np.searchsorted(labels, own_label)
        at = np.arange(len(x))
        for c, points in enumerate(arrays):
            means[:, c] = sum(np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points)
        sizes = np.array([len(p) for p in arrays])
        inside = means[at, own] / np.maximum(sizes[own] - 1, 1)
        means = means / sizes
        means[at, own] = np.inf
        other = means.min(axis=1)
        most = np.maximum(inside, other)
        yield 0, 0, np.array([np.where((sizes[own] > 1) & (most > 0), (other - inside) / np.where(most > 0, most, 1), 0.0).sum()])

    rows = sample.select(*cols, F.col(cluster).cast("int").alias("_label"))
    assert len(rows.columns) == dims + 1
    return float(_by_model(rows, cols, sums, 1, key="_label")[0, 0][0] / len(held))
