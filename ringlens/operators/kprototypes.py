"""K-Prototypes (M12): clustering of mixed numeric + categorical rows.

Not in MLlib, so it is written as an iterative DataFrame job:

* the input is written once to the shared checkpoint folder, so every
  iteration's plan is "table + literal expressions" and lineage never
  grows (executor loss recomputes nothing upstream); all K of a K selection
  share their passes;
* assignment: cost = squared Euclidean distance on the numeric part +
  gamma x number of categorical mismatches, against k prototypes that are
  literals of the plan (k is a parameter);
* update: one pass of Arrow batches that keeps sums and value counts by cluster,
  added up by Spark (modes: ties -> smallest value); only k rows of means
  and k x attributes modes reach the driver;
* initialisation: Cao's density method on the categorical part, computed on
  the table of distinct category tuples (bounded by the product of the
  attribute cardinalities); numeric part drawn around the mean with the
  column std (seeded).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlens.sources.sinks import materialise


class KPrototypes(NamedTuple):
    """A fit; ``converged`` is False where the iteration limit ended it."""
    rows: DataFrame
    prototypes: list
    iterations: int
    cost: float
    converged: bool


def _cost_expr(num_cols, cat_cols, proto_num, proto_cat, gamma):
    acc = None
    for c, v in zip(num_cols, proto_num):
        t = (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        acc = t if acc is None else acc + t
    for c, v in zip(cat_cols, proto_cat):
        t = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(0.0)).otherwise(F.lit(float(gamma)))
        acc = t if acc is None else acc + t
    return acc


def _nearest(protos, num_cols, cat_cols, gamma):
    """(nearest prototype, ties -> lowest index; its cost); the prototypes are literals of the plan."""
    costs = F.array(*[_cost_expr(num_cols, cat_cols, pn, pc, gamma) for pn, pc in protos])
    least = F.array_min(costs)
    return (F.array_position(costs, least) - 1).cast("int"), least


def assign_to_prototypes(df, num_cols, cat_cols, protos, gamma, out="cluster_id"):
    """Nearest prototype and its ``_cost`` for every row."""
    best, cost = _nearest(protos, num_cols, cat_cols, gamma)
    return df.withColumn(out, best).withColumn("_cost", cost)


def cao_init(df: DataFrame, cat_cols: list[str], k: int) -> list[list[str]]:
    """Cao's initial modes, computed on the table of distinct category tuples.

    density(x) = sum_j freq_j(x_j) / (n m); the first mode has the highest
    density, each next one maximises min over chosen modes of
    density x mismatches. Every argmax is an ``orderBy(...).limit(1)`` (ties
    -> smallest tuple), so only the k chosen tuples reach the driver.
    """
    m = len(cat_cols)
    tuples = df.groupBy(*cat_cols).agg(F.count(F.lit(1)).alias("w"))
    t, dens = tuples, None
    for j, c in enumerate(cat_cols):
        fj = tuples.groupBy(c).agg(F.sum("w").alias(f"_f{j}")).withColumnRenamed(c, f"_k{j}")
        t = t.join(fj, t[c].eqNullSafe(fj[f"_k{j}"]), "left").drop(f"_k{j}")
        term = F.col(f"_f{j}")
        dens = term if dens is None else dens + term
    t = materialise(t.withColumn("_dens", dens / F.lit(df.count()) / F.lit(m)).select(*cat_cols, "_dens"), "category-tuples")
    order = [F.asc_nulls_first(c) for c in cat_cols]
    chosen = [list(t.orderBy(F.desc("_dens"), *order).limit(1).first()[:m])]
    while len(chosen) < k:
        score = None
        for mode in chosen:
            mis = None
            for c, v in zip(cat_cols, mode):
                d = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(0)).otherwise(F.lit(1))
                mis = d if mis is None else mis + d
            s = F.col("_dens") * mis
            score = s if score is None else F.least(score, s)
        row = t.orderBy(F.desc(score), *order).limit(1).first()
        chosen.append(list(row[:m]))
    return chosen


#: Distinct (model, cluster, attribute, value) a task holds before it hands its sums on.
HELD = 100_000


def _modes_and_means(base: DataFrame, num_cols, cat_cols, protos: dict[int, list], gamma: float) -> dict[int, list]:
    """One update of the prototypes of every K, in one pass.

    Tasks add up numbers by (K, cluster) and value counts by (K, cluster, attribute); Spark adds
    those up and picks each mode (most rows, then smallest value), so that the driver receives one
    row for each cluster and column. Numeric columns have attribute -1, -2, ..., the rows 0.
    """
    dims, width = len(num_cols), len(cat_cols)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, float] = {}

        def out() -> pa.RecordBatch:
            columns = [*zip(*total), list(total.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()))],
                                              ["k", "c", "attr", "val", "v"])

        for batch in batches:
            x = np.column_stack([np.zeros(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(dims))])[:, 1:]
            coded = [batch.column(dims + j).dictionary_encode(null_encoding="encode") for j in range(width)]
            codes, names = [c.indices.to_numpy() for c in coded], [c.dictionary.to_pylist() for c in coded]
            for k, own in protos.items():
                d = np.empty((len(x), k))
                for c, (numbers, values) in enumerate(own):
                    d[:, c] = ((x - np.array(numbers, float)) ** 2).sum(axis=1)
                    for j, v in enumerate(values):
                        d[:, c] += gamma * (codes[j] != (names[j].index(v) if v in names[j] else -1))
                near = d.argmin(axis=1)
                sums = [(0, np.ones(len(x))), *((-1 - i, x[:, i]) for i in range(dims))]
                for attr, column in sums:
                    for c, v in enumerate(np.bincount(near, column, minlength=k)):
                        total[k, c, attr, None] = total.get((k, c, attr, None), 0.0) + float(v)
                for j in range(width):
                    cells = np.bincount(near * len(names[j]) + codes[j], minlength=k * len(names[j]))
                    for cell in np.flatnonzero(cells):
                        key = (k, int(cell // len(names[j])), j + 1, names[j][cell % len(names[j])])
                        total[key] = total.get(key, 0.0) + float(cells[cell])
            if len(total) > HELD:
                yield out()
                total.clear()
        if total:
            yield out()

    cells = base.select(*num_cols, *cat_cols).mapInArrow(task, "k int, c int, attr int, val string, v double") \
        .groupBy("k", "c", "attr", "val").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("k", "c", "attr").orderBy(F.desc("v"), F.asc_nulls_last("val"))
    got = {(r["k"], r["c"], r["attr"]): r for r in cells.withColumn("_r", F.row_number().over(w)).filter("_r = 1").collect()}
    new = {k: [(list(a), list(b)) for a, b in p] for k, p in protos.items()}
    for (k, c, _), r in got.items():
        n = got[k, c, 0]["v"]
        if n:  # a prototype without rows stays
            if r["attr"] < 0:
                new[k][c][0][-1 - r["attr"]] = r["v"] / n
            elif r["attr"] > 0:
                new[k][c][1][r["attr"] - 1] = r["val"]
    return new


def fit_all_kprototypes(df: DataFrame, num_cols: list[str], cat_cols: list[str], ks, gamma: float | None = None, max_iter: int = 20,
                        seed: int = 42) -> tuple[dict[int, KPrototypes], float]:
    """K-Prototypes for every K of ``ks`` at once, and the gamma used; a K leaves the passes when its prototypes stay.

    ``gamma`` defaults to half the mean std of the numeric columns.
    """
    base = materialise(df, "kprototypes-rows")
    stats = base.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(num_cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(len(num_cols))])
    stds = np.array([stats[f"s{i}"] or 0.0 for i in range(len(num_cols))])
    if gamma is None:
        gamma = 0.5 * float(stds.mean()) if len(stds) else 1.0
    most = max(ks)
    init_num = means + np.random.RandomState(seed).randn(most, len(num_cols)) * stds
    init_cat = cao_init(base, cat_cols, most)
    protos = {k: [(list(map(float, a)), list(b)) for a, b in zip(init_num[:k], init_cat)] for k in ks}
    steps, settled = dict.fromkeys(ks, 0), set()
    for _ in range(max_iter):
        moving = {k: p for k, p in protos.items() if k not in settled}
        if not moving:
            break
        for k, new in _modes_and_means(base, num_cols, cat_cols, moving, gamma).items():
            steps[k] += 1
            if all(b == d and np.allclose(a, c, rtol=0, atol=1e-9) for (a, b), (c, d) in zip(new, protos[k])):  # sums differ by rounding
                settled.add(k)
            protos[k] = new
    fits = {}
    for k in ks:
        final = assign_to_prototypes(base, num_cols, cat_cols, protos[k], gamma)
        fits[k] = KPrototypes(final, protos[k], steps[k], float(final.agg(F.sum("_cost")).first()[0] or 0.0), k in settled)
    return fits, gamma


def fit_kprototypes(df: DataFrame, num_cols: list[str], cat_cols: list[str], k: int, gamma: float | None = None,
                    max_iter: int = 20, seed: int = 42) -> KPrototypes:
    """Fit K-Prototypes for one K; the rows have ``cluster_id`` and ``_cost``."""
    return fit_all_kprototypes(df, num_cols, cat_cols, [k], gamma, max_iter, seed)[0][k]


#: Most distinct values of a category whose counts are broadcast; beyond, rows meet them by a shuffle.
BROADCAST_VALUES = 100_000


def mixed_silhouette(df: DataFrame, num_cols: list[str], cat_cols: list[str], gamma: float, cluster: str = "cluster_id") -> float:
    """Mean silhouette over squared numeric distance plus gamma x mismatches, without pairs.

    A row's mean dissimilarity to a cluster is |x|^2 - 2 x.S / n + Q / n + gamma x sum over
    categories of (1 - share of the row's value in the cluster): per-cluster sums, and
    per-cluster counts of each value, are all it needs. In its own cluster a row is left out.
    A row alone in its cluster counts 0; NaN where fewer than two clusters have rows.
    """
    square = sum((F.col(c) * F.col(c) for c in num_cols), F.lit(0.0))
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"),
                                    *[F.sum(c).alias(f"s{i}") for i, c in enumerate(num_cols)]).orderBy(cluster).collect()  # k rows
    if len(stats) < 2:
        return float("nan")
    rows = df
    for i, c in enumerate(cat_cols):
        counts = materialise(df.groupBy(F.col(c).alias(f"_v{i}")).agg(F.array(*[
            F.count_if(F.col(cluster) == F.lit(r[cluster])) for r in stats]).alias(f"_n{i}")), "category-counts")
        small = counts.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        rows = rows.join(F.broadcast(counts) if small else counts, F.col(c).eqNullSafe(F.col(f"_v{i}")))
    means = []
    for j, r in enumerate(stats):
        dot = sum((F.col(c) * F.lit(float(r[f"s{i}"])) for i, c in enumerate(num_cols)), F.lit(0.0))
        apart = sum((1 - F.col(f"_n{i}")[j] / F.lit(r["n"]) for i in range(len(cat_cols))), F.lit(0.0))
        means.append(square - 2 * dot / F.lit(r["n"]) + F.lit(float(r["q"])) / F.lit(r["n"]) + F.lit(float(gamma)) * apart)
    mine = [F.col(cluster) == F.lit(r[cluster]) for r in stats]
    own = F.coalesce(*[F.when(m & F.lit(r["n"] > 1), d * F.lit(r["n"] / max(r["n"] - 1, 1))) for m, r, d in zip(mine, stats, means)])
    other = F.least(*[F.when(~m, d) for m, d in zip(mine, means)])
    rows = rows.select(own.alias("own"), other.alias("other"))  # own is null for a row alone
    value = F.when(F.greatest("own", "other") > 0, (F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return float(rows.agg(F.avg(F.when(F.col("own").isNull(), 0.0).otherwise(F.coalesce(value, F.lit(0.0))))).first()[0])


def select_k_mixed(df: DataFrame, num_cols: list[str], cat_cols: list[str], ks=range(2, 8), gamma: float | None = None,
                   max_iter: int = 20, seed: int = 42) -> DataFrame:
    """M6 for mixed data: cost, mixed silhouette, passes and whether it settled, one row for each K."""
    fits, gamma = fit_all_kprototypes(df, num_cols, cat_cols, list(ks), gamma, max_iter, seed)
    rows = [(int(k), f.cost, mixed_silhouette(f.rows, num_cols, cat_cols, gamma), f.iterations, f.converged) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double, iterations int, converged boolean")
