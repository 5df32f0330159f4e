"""Registered queries: clustering (features, assignment, quality, profiles, model fits).

Cluster reports are checked against the SQL oracle on a *fixed-centroid*
assignment (centroids are parameters), which both engines can reproduce
exactly; the K-Means / K-Prototypes fits themselves are checked on rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.categorical import reason_label
from ringlens.operators import clusters as CL
from ringlens.operators.clean import fence_condition, pre_fence_condition
from ringlens.operators.failures import failure_rates_by
from ringlens.functions.quantiles import median_scalar
from ringlens.operators.features import FEATURES_6, FEATURES_7, encode_features, fit_scaler, prepare_variables, share_sample
from ringlens.operators.kprototypes import fit_kprototypes, select_k_mixed
from ringlens.operators.lloyd import fit_all, sampled_silhouette, squared_silhouettes
from ringlens.operators.reports import share_within, top_n_per_group, value_counts
from ringlens.operators.sentiment import sentiment_agreement
from ringlens.plans import oracle_sql as O
from ringlens.sources.sinks import materialise
from ringlens.plans.registry import register
from ringlens.plans import stages
from ringlens.plans.stages import r9, table

# parameters: four fixed centroids in the scaled feature space (order of FEATURES_7)
FIXED_CENTROIDS = [
    [-0.3, 0.0, -1.2, 0.0, 0.0, 0.0, -0.2],
    [-0.7, -0.5, 0.6, 0.0, 0.0, 0.0, -0.2],
    [1.0, 0.4, 0.6, 0.0, 0.0, 0.0, -0.2],
    [0.0, 0.0, 0.8, 0.0, 0.0, -1.5, 3.0],
]
Z7 = [c + "_z" for c in FEATURES_7]
# parameter: rows of the sample for the Euclidean silhouette
SILHOUETTE_ROWS = 2000

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def clean_calls(spark, sf, with_failures: bool = False):
    """Clean table (p99 flag over all rows, F1-F3) with own sentiment (and failure flags)."""
    return stages.clean(spark, sf, with_failures)


def scaled_features(spark, sf, with_failures: bool = False):
    conn = encode_features(clean_calls(spark, sf, with_failures).filter(F.col("connected")))
    scaler = fit_scaler(conn, FEATURES_7)
    z = scaler.transform(conn)
    return z.withColumns({c: r9(c) for c in Z7})


def fixed_clusters(spark, sf, with_failures: bool = False):
    """Clean connected calls assigned to the fixed centroids.

    Every cluster report reads this assignment several times (sizes,
    quantiles, modes); it is checkpointed once per session into the shared
    checkpoint folder, so the reports scan a small table and their plans
    do not repeat the feature and scaling steps.
    """
    def build():
        z = scaled_features(spark, sf)
        keep = ["call_id", "call_url", "connected", "duration_sec", "hour", "disconnected_reason", "pca_sentimiento",
                "pca_razon_churn", "sentiment_own", "campaign_type", "f_engagement", *K.FAIL_COLUMNS, *Z7]
        return CL.assign_to_centroids(z, Z7, FIXED_CENTROIDS, out="cluster_id").select(*keep, "cluster_id") \
                 .checkpoint(eager=True)
    return stages._memo(spark, sf, "fixed_clusters", build)


# ---------------------------------------------------------------------------
# SQL side
# ---------------------------------------------------------------------------

_PRE = f"hour <> 0 AND campaign_type <> '{K.TEST_CAMPAIGN}'"
_CLEAN = f"""fence AS (
SELECT q1 - {K.IQR_MULTIPLIER} * (q3 - q1) AS lo, q3 + {K.IQR_MULTIPLIER} * (q3 - q1) AS hi FROM (
  SELECT {O.nearest_q('scored', 'duration_sec', 0.25, _PRE)} AS q1,
         {O.nearest_q('scored', 'duration_sec', 0.75, _PRE)} AS q3)),
p99 AS (SELECT {O.nearest_q('scored', 'duration_ms', K.P99_QUANTILE)} AS v),
clean AS (
SELECT s.*, coalesce(s.duration_ms > p99.v, false) AS duration_outlier FROM SRC s, fence, p99
WHERE {_PRE} AND s.duration_sec BETWEEN fence.lo AND fence.hi),
conn AS (SELECT * FROM clean WHERE connected)"""
_ENG = O.case_map("disconnected_reason", K.ENGAGEMENT_MAP, "0")
_SENT = O.case_map("pca_sentimiento", K.SENTIMENT_ORDINAL, "1")
_NR = ", ".join(O.q(v) for v in K.NO_REASON_VALUES)
_FEAT = f"""feat AS (
SELECT *, coalesce(duration_sec, (SELECT median(duration_sec) FROM conn)) AS f_duration,
  CAST(hour AS DOUBLE) AS f_hour, CAST({_ENG} AS DOUBLE) AS f_engagement,
  coalesce(CAST(duration_outlier AS DOUBLE), 0.0) AS f_outlier,
  coalesce(CAST(inconsistency_flag AS DOUBLE), 0.0) AS f_inconsistency, CAST({_SENT} AS DOUBLE) AS f_sentiment,
  CASE WHEN pca_razon_churn IS NULL OR pca_razon_churn IN ({_NR}) THEN 0.0 ELSE 1.0 END AS f_has_reason
FROM conn),
fstats AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES_7)} FROM feat),
z AS (
SELECT feat.*, {', '.join(f"round(CASE WHEN coalesce(s_{c}, 0) = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END, 9) AS {c}_z" for c in FEATURES_7)}
FROM feat, fstats)"""


def _dist_sql(center) -> str:
    return " + ".join(f"({c} - {float(v)!r}) * ({c} - {float(v)!r})" for c, v in zip(Z7, center))


def _assign_sql() -> str:
    d = [_dist_sql(c) for c in FIXED_CENTROIDS]
    # same left fold as the Spark expression: keep the running best, replace on a strictly smaller distance
    best, best_d = "0", f"({d[0]})"
    for i, di in enumerate(d[1:], start=1):
        best = f"CASE WHEN ({di}) < {best_d} THEN {i} ELSE {best} END"
        best_d = f"least({best_d}, ({di}))"
    return f"assigned AS (SELECT *, CAST({best} AS INTEGER) AS cluster_id FROM z)"


def cluster_sql(select: str, stage: str = "scored", extra: list[str] | None = None) -> str:
    return O.with_stage(stage, [_CLEAN.replace("SRC", stage), _FEAT, _assign_sql(), *(extra or [])], select)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

@register("cluster_features", cluster_sql(f"SELECT call_id, {', '.join(Z7)} FROM z"), "M1 M3 P19 P20 P21")
def cluster_features(spark, sf):
    return scaled_features(spark, sf).select("call_id", *Z7)


@register("churn_groups", O.with_stage("prepared", [], f"""
SELECT call_id, pca_razon_churn,
  CASE WHEN pca_razon_churn IS NULL THEN 'sin_motivo'
       ELSE {O.case_map('lower(trim(pca_razon_churn))', K.CHURN_GROUPS, "'otro'")} END AS razon_grupo,
  CASE WHEN pca_razon_churn IS NULL OR pca_razon_churn IN ({_NR}) THEN 'sin_motivo' ELSE 'con_motivo' END AS motivo
FROM prepared"""), "P21 P22 P23")
def churn_groups(spark, sf):
    df = prepare_variables(table(spark, sf))
    return df.select("call_id", "pca_razon_churn", "razon_grupo", reason_label("pca_razon_churn").alias("motivo"))


@register("cluster_assign_fixed", cluster_sql("""
SELECT p.call_id, CAST(coalesce(a.cluster_id, -1) AS INTEGER) AS cluster_id
FROM prepared p LEFT JOIN (SELECT call_url, cluster_id FROM assigned WHERE call_url IS NOT NULL) a USING (call_url)"""),
          "M8 J1")
def cluster_assign_fixed(spark, sf):
    # the scaler is fit on clean connected calls; every call is then assigned in one pass, no join
    conn = clean_calls(spark, sf).filter(F.col("connected"))
    fill = median_scalar(conn, "duration_sec")
    scaler = fit_scaler(encode_features(conn, duration_fill=fill), FEATURES_7)
    allz = scaler.transform(encode_features(stages.with_outliers(table(spark, sf), spark, sf), duration_fill=fill))
    allz = allz.withColumns({c: r9(c) for c in Z7})
    pred = CL.assign_to_centroids(allz, Z7, FIXED_CENTROIDS, out="_pred")
    p99, fence = stages.limits(spark, sf)
    clustered = pre_fence_condition() & fence_condition(fence) & F.col("connected")
    return CL.cluster_ids_for_all(pred, clustered, F.col("_pred")).select("call_id", "cluster_id")


@register("cluster_quality_fixed", cluster_sql(f"""
SELECT CAST(k AS INTEGER) AS k, n, {O.r9('db')} AS davies_bouldin, {O.r9('ch')} AS calinski_harabasz FROM (
  SELECT (SELECT count(*) FROM cents) AS k, (SELECT sum(n) FROM cents) AS n,
    (SELECT avg(r_max) FROM (SELECT i.cluster_id, max((i.s + j.s) / sqrt({' + '.join(f'(i.c_{c} - j.c_{c}) ^ 2' for c in Z7)})) AS r_max
       FROM cents i JOIN cents j ON i.cluster_id <> j.cluster_id GROUP BY i.cluster_id)) AS db,
    ((SELECT sum(n * ({' + '.join(f'(c_{c} - g_{c}) ^ 2' for c in Z7)})) FROM cents, g) / ((SELECT count(*) FROM cents) - 1))
      / ((SELECT sum(w) FROM cents) / ((SELECT sum(n) FROM cents) - (SELECT count(*) FROM cents))) AS ch)""",
          extra=[f"""c0 AS (SELECT cluster_id, count(*) AS n, {', '.join(f'avg({c}) AS c_{c}' for c in Z7)} FROM assigned GROUP BY cluster_id)""",
                 f"""cents AS (
SELECT c0.cluster_id, any_value(c0.n) AS n, {', '.join(f'any_value(c0.c_{c}) AS c_{c}' for c in Z7)},
  avg(sqrt({' + '.join(f'(a.{c} - c0.c_{c}) * (a.{c} - c0.c_{c})' for c in Z7)})) AS s,
  sum({' + '.join(f'(a.{c} - c0.c_{c}) * (a.{c} - c0.c_{c})' for c in Z7)}) AS w
FROM assigned a JOIN c0 USING (cluster_id) GROUP BY c0.cluster_id)""",
                 f"""g AS (SELECT {', '.join(f'sum(n * c_{c}) / sum(n) AS g_{c}' for c in Z7)} FROM cents)"""]), "M10")
def cluster_quality_fixed(spark, sf):
    out = CL.quality_metrics(fixed_clusters(spark, sf), Z7)
    return out.select("k", "n", r9("davies_bouldin").alias("davies_bouldin"),
                      r9("calinski_harabasz").alias("calinski_harabasz"))


@register("cluster_sizes_fixed", cluster_sql("""
SELECT cluster_id, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM assigned GROUP BY cluster_id"""), "A22")
def cluster_sizes_fixed(spark, sf):
    return value_counts(fixed_clusters(spark, sf), "cluster_id")


def _nearest_group_sql(q: float) -> str:
    return f"""(SELECT cluster_id, duration_sec AS v FROM (
  SELECT cluster_id, duration_sec, row_number() OVER (PARTITION BY cluster_id ORDER BY duration_sec) - 1 AS rk,
    count(*) OVER (PARTITION BY cluster_id) AS ng FROM assigned WHERE duration_sec IS NOT NULL)
  WHERE rk = CAST(floor((ng - 1) * {q!r} + 0.5) AS BIGINT))"""


_LABELS = "CASE cluster_id " + " ".join(f"WHEN {k} THEN {O.q(v)}" for k, v in K.CLUSTER_LABELS.items()) + " END"


@register("cluster_profile_fixed", cluster_sql(f"""
SELECT b.cluster_id, b.n, {O.r9('b.dur_median_s')} AS dur_median_s, {O.r9('b.hour_mean')} AS hour_mean,
  p25.v AS dur_p25_s, p75.v AS dur_p75_s, {_LABELS.replace('cluster_id', 'b.cluster_id')} AS label
FROM (SELECT cluster_id, count(*) AS n, median(duration_sec) AS dur_median_s, avg(hour) AS hour_mean FROM assigned
      GROUP BY cluster_id) b
LEFT JOIN {_nearest_group_sql(0.25)} p25 USING (cluster_id) LEFT JOIN {_nearest_group_sql(0.75)} p75 USING (cluster_id)"""),
          "A21 P24 A20")
def cluster_profile_fixed(spark, sf):
    out = CL.cluster_profile(fixed_clusters(spark, sf))
    return out.withColumns({"dur_median_s": r9("dur_median_s"), "hour_mean": r9("hour_mean")})


@register("cluster_reason_share_fixed", cluster_sql("""
SELECT cluster_id, disconnected_reason, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS pct_of_group,
  count(*) / sum(count(*)) OVER (PARTITION BY disconnected_reason) AS pct_of_category
FROM assigned GROUP BY cluster_id, disconnected_reason"""), "A23")
def cluster_reason_share_fixed(spark, sf):
    return share_within(fixed_clusters(spark, sf), "cluster_id", "disconnected_reason")


@register("cluster_top_churn_fixed", cluster_sql(f"""
SELECT * FROM (
  SELECT cluster_id, pca_razon_churn, count(*) AS n,
    CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, pca_razon_churn) AS INTEGER) AS rank
  FROM assigned WHERE pca_razon_churn IS NOT NULL AND pca_razon_churn NOT IN ({', '.join(O.q(v) for v in K.PROFILE_NO_REASON_VALUES)})
  GROUP BY cluster_id, pca_razon_churn) WHERE rank <= 5"""), "A23 F8 O2")
def cluster_top_churn_fixed(spark, sf):
    return top_n_per_group(fixed_clusters(spark, sf), "cluster_id", "pca_razon_churn", 5, K.PROFILE_NO_REASON_VALUES) \
        .withColumn("rank", F.col("rank").cast("int"))


@register("cluster_reason_matrix_fixed", cluster_sql(f"""
SELECT pca_razon_churn, cluster_id, count(*) AS n, any_value(cluster_n) AS cluster_n,
  count(*) / any_value(cluster_n) * 100 AS pct
FROM assigned JOIN (SELECT cluster_id, count(*) AS cluster_n FROM assigned GROUP BY cluster_id) USING (cluster_id)
WHERE pca_razon_churn IN (
  SELECT pca_razon_churn FROM assigned WHERE pca_razon_churn IS NOT NULL AND pca_razon_churn NOT IN ({_NR})
  GROUP BY pca_razon_churn ORDER BY count(*) DESC, pca_razon_churn LIMIT 10)
GROUP BY pca_razon_churn, cluster_id"""), "A24 M14")
def cluster_reason_matrix_fixed(spark, sf):
    return CL.reason_matrix(fixed_clusters(spark, sf))


@register("cluster_summary_fixed", cluster_sql(f"""
SELECT b.cluster_id, b.n, {O.r9('b.dur_median')} AS dur_median, b.n_documented, d.dominant_reason, p25.v AS p25, p75.v AS p75,
  p75.v - p25.v AS iqr, b.n_documented / b.n AS documented_share
FROM (SELECT cluster_id, count(*) AS n, median(duration_sec) AS dur_median,
        count(*) FILTER (WHERE pca_razon_churn IS NOT NULL AND pca_razon_churn NOT IN ({', '.join(O.q(v) for v in K.PROFILE_NO_REASON_VALUES)})) AS n_documented
      FROM assigned GROUP BY cluster_id) b
LEFT JOIN (SELECT cluster_id, disconnected_reason AS dominant_reason FROM (
    SELECT cluster_id, disconnected_reason, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC,
      disconnected_reason) AS r FROM assigned GROUP BY cluster_id, disconnected_reason) WHERE r = 1) d USING (cluster_id)
LEFT JOIN {_nearest_group_sql(0.25)} p25 USING (cluster_id) LEFT JOIN {_nearest_group_sql(0.75)} p75 USING (cluster_id)"""),
          "A25")
def cluster_summary_fixed(spark, sf):
    return CL.cluster_summary(fixed_clusters(spark, sf)).withColumn("dur_median", r9("dur_median"))


@register("sentiment_cluster_share_fixed", cluster_sql("""
SELECT cluster_id, sentiment_own, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS pct_of_group,
  count(*) / sum(count(*)) OVER (PARTITION BY sentiment_own) AS pct_of_category
FROM assigned GROUP BY cluster_id, sentiment_own"""), "A19")
def sentiment_cluster_share_fixed(spark, sf):
    return share_within(fixed_clusters(spark, sf), "cluster_id", "sentiment_own")


@register("sentiment_agreement_by_cluster_fixed", cluster_sql("""
SELECT cluster_id, count(*) AS n_overlap,
  CAST(sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) AS BIGINT) AS n_match,
  sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) / count(*) AS match_rate
FROM assigned WHERE pca_sentimiento IS NOT NULL GROUP BY cluster_id"""), "A15")
def sentiment_agreement_by_cluster_fixed(spark, sf):
    return sentiment_agreement(fixed_clusters(spark, sf), ["cluster_id"])


_RATES = ", ".join(
    f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS n_{c[5:]}, sum(CAST({c} AS INTEGER)) / count(*) AS rate_{c[5:]}"
    for c in K.FAIL_COLUMNS)


@register("failure_rates_by_cluster_fixed", cluster_sql(f"""
SELECT cluster_id, count(*) AS n, {_RATES} FROM assigned WHERE connected GROUP BY cluster_id""", stage="flagged"), "A27")
def failure_rates_by_cluster_fixed(spark, sf):
    return failure_rates_by(fixed_clusters(spark, sf, with_failures=True), "cluster_id")


# ---------------------------------------------------------------------------
# model fits (rows-only checks: K-Means initialisation differs between engines by design)
# ---------------------------------------------------------------------------

@register("kmeans_clusters", None, "M4 M5 M7 M8 J1 S7")
def kmeans_clusters(spark, sf):
    calls = stages.with_outliers(stages.table(spark, sf), spark, sf)
    fence = stages.limits(spark, sf)[1]
    clustered = pre_fence_condition() & fence_condition(fence) & F.col("connected")
    return CL.kmeans_all_calls(calls, clustered, k=4).select("call_id", "cluster_id")


@register("kmeans_k_selection", None, "M6 M4 M9")
def kmeans_k_selection(spark, sf):
    clean = clean_calls(spark, sf)
    return CL.k_selection(clean, ks=range(2, 7))


@register("kmeans_quality", None, "M9 M10 M14")
def kmeans_quality(spark, sf):
    clean = clean_calls(spark, sf)
    pred, _, fit = CL.cluster_calls(clean, k=4, ks=None)
    q = CL.quality_metrics(pred, Z7)
    sil = squared_silhouettes(pred, Z7, {4: fit})[4]
    euclidean = sampled_silhouette(share_sample(pred, 0.0, SILHOUETTE_ROWS), Z7)
    return q.withColumns({"silhouette_sq": F.lit(sil), "silhouette_sample": F.lit(euclidean), "iterations": F.lit(fit.iterations), "converged": F.lit(fit.converged)})


def complete_features(spark, sf):
    """Six features of (the complete connected calls, all of them); fill and scaler come from the complete ones."""
    conn = clean_calls(spark, sf).filter(F.col("connected"))
    train = conn.dropna(subset=["duration_sec", "hour", "disconnected_reason", "pca_sentimiento"])
    kw = {"duration_fill": median_scalar(train, "duration_sec"), "no_reason": K.PROFILE_NO_REASON_VALUES}
    tr = encode_features(train, **kw)
    scaler = fit_scaler(tr, FEATURES_6)
    return scaler.transform(tr), scaler.transform(encode_features(conn, **kw))


@register("kmeans_trained_on_complete", None, "M2 M11 F6")
def kmeans_trained_on_complete(spark, sf):
    train, allc = complete_features(spark, sf)
    zc = [c + "_z" for c in FEATURES_6]
    fit = fit_all(materialise(train.select("call_id", *zc), "complete-calls"), zc, [4])[4]
    return CL.assign_to_centroids(allc, zc, fit.centres.tolist(), out="cluster_id").select("call_id", "cluster_id")


@register("kmeans_ordinal_baseline", None, "M13")
def kmeans_ordinal_baseline(spark, sf):
    conn = prepare_variables(clean_calls(spark, sf).filter(F.col("connected")))
    return CL.ordinal_kmeans(conn, 4).select("call_id", "cluster_id")


KP_CATEGORIES = ["disconnected_reason", "razon_grupo", "day_of_week"]
KP_NUMBERS = ["duration_sec", "hour", "duration_outlier_i", "inconsistency_flag_i"]


def kprototypes_input(spark, sf):
    """Connected clean calls with the scaled numbers and the categories of K-Prototypes."""
    conn = prepare_variables(clean_calls(spark, sf).filter(F.col("connected")))
    base = conn.select("call_id", *KP_NUMBERS, *KP_CATEGORIES)
    med = median_scalar(base, "duration_sec")
    base = base.withColumn("duration_sec", F.coalesce("duration_sec", F.lit(float(med))))
    return fit_scaler(base, KP_NUMBERS).transform(base)


@register("kprototypes_clusters", None, "M12")
def kprototypes_clusters(spark, sf):
    fit = fit_kprototypes(kprototypes_input(spark, sf), [c + "_z" for c in KP_NUMBERS], KP_CATEGORIES, 4)
    return fit.rows.select("call_id", "cluster_id")


@register("kprototypes_k_selection", None, "M6 M12")
def kprototypes_k_selection(spark, sf):
    return select_k_mixed(kprototypes_input(spark, sf), [c + "_z" for c in KP_NUMBERS], KP_CATEGORIES, range(2, 8))
