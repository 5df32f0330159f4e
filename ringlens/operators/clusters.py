"""K-Means clustering of connected calls and cluster quality/profiles.

Training is ``operators.lloyd``: k-means|| starts and Lloyd updates of all
starts and all K in the same passes; the lowest training cost wins. All
quality metrics are linear in the number of rows: centroids (k rows) are
broadcast and each point contributes to one aggregation - no point x point
pairs are formed. The silhouette is the closed form over *squared* Euclidean
distances; ``lloyd.sampled_silhouette`` is the Euclidean one on a bounded sample.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.operators import lloyd
from ringlens.operators.features import fit_scaler
from ringlens.functions.quantiles import MEDIAN, attach_quantiles, median_scalar
from ringlens.sources.sinks import materialise


# ---------------------------------------------------------------------------
# fitting
# ---------------------------------------------------------------------------

def _vector_columns(df: DataFrame, features: str) -> tuple[DataFrame, list[str]]:
    """``df`` with one column for each entry of a vector column, and their names."""
    first = df.select(features).first()
    names = [f"{features}_{i}" for i in range(len(first[0]) if first else 0)]
    entries = vector_to_array(features)
    return df.withColumns({c: entries[i] for i, c in enumerate(names)}), names


class VectorKMeans(NamedTuple):
    """A fit over a vector column."""
    fit: lloyd.KMeansFit
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        spread, names = _vector_columns(df, self.features)
        return assign_to_centroids(spread, list(self.fit.columns), self.fit.centres.tolist()).drop(*names)


def fit_kmeans(df: DataFrame, k: int, features: str = "features", n_init: int = 10, max_iter: int = 150,
               seed: int = 42, tol: float = 1e-4, key: str = "call_id") -> VectorKMeans:
    """M5: best of ``n_init`` seeded starts by training cost; all starts share their passes."""
    spread, names = _vector_columns(df, features)
    return VectorKMeans(lloyd.fit_all(spread, names, [k], n_init, max_iter, seed, tol, key)[k], features)


def silhouette_sq(pred: DataFrame, features: str = "features", prediction: str = "prediction") -> float:
    """M9: silhouette with squared Euclidean distance (closed form, linear in rows)."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=prediction, distanceMeasure="squaredEuclidean")
    return ev.evaluate(pred)


def select_k(sample: DataFrame, cols: list[str], ks=range(2, 7), n_init: int = 10, max_iter: int = 150, seed: int = 42) -> DataFrame:
    """M6: inertia and silhouette for each K (one row per K); every pass over the rows serves all K and all starts."""
    fits = lloyd.fit_all(sample, cols, list(ks), n_init, max_iter, seed)
    silhouettes = lloyd.squared_silhouettes(sample, cols, fits)
    rows = [(int(k), f.cost, silhouettes[k], f.iterations, f.converged) for k, f in fits.items()]
    return sample.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, iterations int, converged boolean")


# ---------------------------------------------------------------------------
# assignment and canonical numbering
# ---------------------------------------------------------------------------

def sq_distance(cols: list[str], center: list[float]):
    acc = None
    for c, v in zip(cols, center):
        d = (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        acc = d if acc is None else acc + d
    return acc


def assign_to_centroids(df: DataFrame, cols: list[str], centroids: list[list[float]], out: str = "prediction") -> DataFrame:
    """Nearest centroid by squared Euclidean distance (ties -> lowest index).

    The k centroids are literals of the plan (k is a parameter, not data).
    """
    dists = [sq_distance(cols, c) for c in centroids]
    best = F.lit(0)
    best_d = dists[0]
    for i, d in enumerate(dists[1:], start=1):
        best = F.when(d < best_d, F.lit(i)).otherwise(best)
        best_d = F.least(best_d, d)
    return df.withColumn(out, best.cast("int"))


def lloyd_step(df: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """M5, one update: (cluster_id, n, cost, c_<column>) - rows, squared distance to the old centroid, and the new centroid.

    Centroids without rows have no row in the result.
    """
    near = None
    for c in centroids:
        near = sq_distance(cols, c) if near is None else F.least(near, sq_distance(cols, c))
    return assign_to_centroids(df, cols, centroids, out="cluster_id").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(near).alias("cost"), *[F.avg(c).alias(f"c_{c}") for c in cols])


def canonical_mapping(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Raw id -> canonical id, ordered by (engagement mean, duration median, raw id); k rows."""
    stats = attach_quantiles(pred.groupBy(prediction).agg(F.avg("f_engagement").alias("_e")), pred, [prediction], "duration_sec", {"_d": MEDIAN})
    w = Window.orderBy("_e", F.asc_nulls_first("_d"), prediction)
    return stats.withColumn("cluster_id", (F.row_number().over(w) - 1).cast("int")).select(prediction, "cluster_id")


def canonical_ids(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Renumber clusters so ids carry a stable meaning (the k-row mapping is broadcast)."""
    return pred.join(F.broadcast(canonical_mapping(pred, prediction)), prediction).drop(prediction)


def attach_clusters(calls: DataFrame, clustered: DataFrame, key: str = "call_url", strict: bool = True) -> DataFrame:
    """Cluster id on every call, -1 for calls without one.

    ``strict`` reproduces the equi-join on ``call_url`` (a connected call with a
    null url gets -1); otherwise the cluster is looked up by the row key.
    """
    k = key if strict else "call_id"
    right = clustered.select(k, "cluster_id").filter(F.col(k).isNotNull())
    out = calls.join(right, k, "left")
    return out.withColumn("cluster_id", F.coalesce(F.col("cluster_id"), F.lit(-1)).cast("int"))


def cluster_ids_for_all(df: DataFrame, clustered_rows, prediction, strict: bool = True) -> DataFrame:
    """M8/J1 without a join: cluster id on every call in the same pass, -1 otherwise.

    ``clustered_rows`` is the row-level condition that selected the rows the
    model was fit on (clean and connected); ``prediction`` the assignment
    expression. With ``strict`` a row with a null ``call_url`` gets -1, as an
    equi-join on that key would give.
    """
    cond = F.coalesce(clustered_rows, F.lit(False))
    if strict:
        cond = cond & F.col("call_url").isNotNull()
    return df.withColumn("cluster_id", F.when(cond, prediction).otherwise(F.lit(-1)).cast("int"))


# ---------------------------------------------------------------------------
# end to end
# ---------------------------------------------------------------------------

def _scaled(clean_df: DataFrame, feature_cols=None) -> tuple[DataFrame, list[str]]:
    """Connected calls with their scaled features, and the names of those."""
    from ringlens.operators.features import FEATURES_7, encode_features

    cols = list(feature_cols or FEATURES_7)
    conn = encode_features(clean_df.filter(F.col("connected")))
    scaler = fit_scaler(conn, cols)
    # read by every pass: written once, no cache to release
    return materialise(scaler.transform(conn), "scaled-calls"), [c + "_z" for c in cols]


def k_selection(clean_df: DataFrame, ks=range(2, 7), n_init: int = 10, max_iter: int = 150, seed: int = 42, feature_cols=None) -> DataFrame:
    """M6 on its own: inertia and silhouette of every K over all connected calls."""
    rows, cols = _scaled(clean_df, feature_cols)
    return select_k(rows, cols, ks, n_init=n_init, max_iter=max_iter, seed=seed)


def cluster_calls(clean_df: DataFrame, k: int | None = 4, ks=range(2, 7), sample_n: int | None = None, n_init: int = 10,
                  max_iter: int = 150, seed: int = 42, feature_cols=None):
    """M1-M8: features over connected calls, scaling, K (forced or by silhouette), final fit.

    K is selected on all rows; ``sample_n`` asks for a seeded sample instead.

    Returns (connected rows with ``cluster_id``, K-selection table or None, fit).
    """
    from ringlens.operators.features import hash_sample

    rows, cols = _scaled(clean_df, feature_cols)
    ksel = None
    if k is None or ks:
        ksel = select_k(rows if sample_n is None else hash_sample(rows, sample_n, seed=seed), cols, ks, n_init=n_init, max_iter=max_iter, seed=seed)
        if k is None:
            k = ksel.orderBy(F.desc("silhouette"), "k").first()["k"]
    fit = lloyd.fit_all(rows, cols, [k], n_init, max_iter, seed)[k]
    return canonical_ids(assign_to_centroids(rows, cols, fit.centres.tolist())), ksel, fit


def kmeans_all_calls(calls: DataFrame, clustered_rows, k: int = 4, n_init: int = 10, max_iter: int = 150,
                     seed: int = 42, feature_cols=None) -> DataFrame:
    """M1-M8 over a whole call table in one assignment pass (no join back).

    The scaler, median fill and model are fit on the rows selected by
    ``clustered_rows`` (clean, connected); every call then gets its canonical
    cluster id, or -1 when it was not part of the fit.
    """
    from ringlens.operators.features import FEATURES_7, encode_features

    cols = list(feature_cols or FEATURES_7)
    cond = F.coalesce(clustered_rows, F.lit(False))
    fit_rows = calls.filter(cond)
    fill = median_scalar(fit_rows, "duration_sec")
    enc = encode_features(calls, duration_fill=fill)
    scaler = fit_scaler(enc.filter(cond), cols)
    zc = [c + "_z" for c in cols]
    scaled = scaler.transform(enc)
    train = materialise(scaled.filter(cond), "scaled-training-calls")
    centres = lloyd.fit_all(train, zc, [k], n_init, max_iter, seed)[k].centres.tolist()
    # k rows: raw id -> canonical id
    pairs = canonical_mapping(assign_to_centroids(train, zc, centres)).collect()
    mapping = calls.sparkSession.createDataFrame([(int(r["prediction"]), int(r["cluster_id"])) for r in pairs],
                                                 "prediction int, _canon int")
    pred = assign_to_centroids(scaled, zc, centres).join(F.broadcast(mapping), "prediction", "left")
    return cluster_ids_for_all(pred, cond, F.col("_canon")).drop("_canon")


def ordinal_features(df: DataFrame, numeric=("duration_sec", "hour"), binary=("duration_outlier_i", "inconsistency_flag_i"),
                     categorical=("disconnected_reason", "razon_grupo", "day_of_week")) -> tuple[DataFrame, list[str]]:
    """M13 inputs: (rows with scaled columns, their names); categories by their place in the alphabet, null after the last."""
    base = df
    for c in numeric:
        med = median_scalar(base, c)
        base = base.withColumn(f"{c}_f", F.coalesce(F.col(c).cast("double"), F.lit(float(med))))
    for c in binary:
        base = base.withColumn(f"{c}_f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    idx = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_f" for c in categorical],
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(base)
    base = idx.transform(base)
    cols = [f"{c}_f" for c in (*numeric, *binary, *categorical)]
    return fit_scaler(base, cols).transform(base), [c + "_z" for c in cols]


def ordinal_kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, **columns):
    """K-Means on numerics + binaries + alphabetically indexed categories, all scaled."""
    scaled, cols = ordinal_features(df, **columns)
    rows = materialise(scaled, "ordinal-calls")
    fit = lloyd.fit_all(rows, cols, [k], n_init, seed=seed)[k]
    return assign_to_centroids(rows, cols, fit.centres.tolist(), out="cluster_id")


# ---------------------------------------------------------------------------
# quality (M9, M10)
# ---------------------------------------------------------------------------

def centroids_of(pred: DataFrame, cols: list[str], cluster: str = "cluster_id") -> DataFrame:
    return pred.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c_{c}") for c in cols])


def quality_metrics(pred: DataFrame, cols: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz in two linear passes.

    Pass 1: per-cluster size and centroid (k rows, broadcast). Pass 2: each
    point's distance to its centroid, aggregated per cluster. Only the k-row
    table reaches the driver, where the k x k centroid separations are taken.
    """
    cents = centroids_of(pred, cols, cluster)
    joined = pred.select(cluster, *cols).join(F.broadcast(cents), cluster)
    d2 = None
    for c in cols:
        t = (F.col(c) - F.col(f"c_{c}")) * (F.col(c) - F.col(f"c_{c}"))
        d2 = t if d2 is None else d2 + t
    per = joined.groupBy(cluster).agg(F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w"))
    rows = cents.join(per, cluster).orderBy(cluster).collect()
    k, n = len(rows), sum(r["n"] for r in rows)
    c = [[float(r[f"c_{x}"]) for x in cols] for r in rows]
    g = [sum(r["n"] * c[i][j] for i, r in enumerate(rows)) / n for j in range(len(cols))] if n else []
    between = sum(r["n"] * sum((c[i][j] - g[j]) ** 2 for j in range(len(cols))) for i, r in enumerate(rows))
    within = sum(r["w"] for r in rows)
    db = float("nan")
    if k > 1:
        worst = []
        for i in range(k):
            ratios = []
            for j in range(k):
                if i != j:
                    m = math.sqrt(sum((c[i][x] - c[j][x]) ** 2 for x in range(len(cols))))
                    ratios.append((rows[i]["s"] + rows[j]["s"]) / m if m > 0 else float("inf"))
            worst.append(max(ratios))
        db = sum(worst) / k
    ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within > 0 else float("nan")
    return pred.sparkSession.createDataFrame(
        [(k, n, float(db), float(ch), float(between), float(within))],
        "k int, n long, davies_bouldin double, calinski_harabasz double, between double, within double")


# ---------------------------------------------------------------------------
# profiles (A21-A25, M14)
# ---------------------------------------------------------------------------

_P25, _P75 = ("nearest", 0.25), ("nearest", 0.75)


def cluster_profile(df: DataFrame, labels: dict | None = None) -> DataFrame:
    """Per cluster n, duration median (midpoint) and nearest p25/p75, mean hour, label.

    The label map is strict (P24): a cluster id without a label is an error.
    """
    base = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("hour").alias("hour_mean"))
    out = attach_quantiles(base, df, ["cluster_id"], "duration_sec", {"dur_median_s": MEDIAN, "dur_p25_s": _P25, "dur_p75_s": _P75})
    labels = K.CLUSTER_LABELS if labels is None else labels
    lab = F.raise_error(F.concat(F.lit("no label for cluster "), F.col("cluster_id").cast("string"))).cast("string")
    for cid, name in sorted(labels.items()):
        lab = F.when(F.col("cluster_id") == cid, F.lit(name)).otherwise(lab)
    return out.withColumn("label", lab)


def cluster_summary(df: DataFrame, no_reason=K.PROFILE_NO_REASON_VALUES) -> DataFrame:
    """Dominant disconnect reason (ties -> smallest), median, nearest IQR, documented-reason share."""
    counts = df.groupBy("cluster_id", "disconnected_reason").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "disconnected_reason")
    dom = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "cluster_id", F.col("disconnected_reason").alias("dominant_reason"))
    documented = F.col("pca_razon_churn").isNotNull() & ~F.col("pca_razon_churn").isin(list(no_reason))
    base = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(documented).alias("n_documented"))
    out = attach_quantiles(base.join(dom, "cluster_id", "left"), df, ["cluster_id"], "duration_sec",
                           {"dur_median": MEDIAN, "p25": _P25, "p75": _P75})
    return out.withColumns({"iqr": F.col("p75") - F.col("p25"),
                            "documented_share": F.col("n_documented") / F.col("n")})


def reason_matrix(df: DataFrame, top: int = 10, col: str = "pca_razon_churn", no_reason=K.NO_REASON_VALUES) -> DataFrame:
    """Percent of each cluster having each of the ``top`` most frequent documented reasons.

    The top list (<= ``top`` rows) is broadcast for a semi join; one
    aggregation then counts (reason, cluster).
    """
    documented = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(no_reason)))
    freq = documented.groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    top_list = freq.orderBy(F.desc("c"), col).limit(top).select(col)
    sizes = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_n"))
    cells = documented.join(F.broadcast(top_list), col, "left_semi").groupBy(col, "cluster_id").agg(
        F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(sizes), "cluster_id").withColumn("pct", F.col("n") / F.col("cluster_n") * 100)
