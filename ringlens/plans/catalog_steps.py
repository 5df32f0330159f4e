"""Registered queries: the deterministic steps of the model fits, each with SQL of its own.

The fits themselves start from random centres, which two engines do not share. What
they are made of does not: feature tables, samples, one Lloyd update from fixed
centroids, the silhouette of a fixed assignment, the assignment to fixed prototypes and
the initial modes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.operators import clusters as CL
from ringlens.operators.features import FEATURES_6, SAMPLE_BASE, SAMPLE_PRIME, assemble, prepare_variables, share_sample
from ringlens.operators.kprototypes import assign_to_prototypes, cao_init, mixed_silhouette
from ringlens.operators.lloyd import drawn_starts, lloyd_pass, sampled_silhouette
from ringlens.plans import oracle_sql as O
from ringlens.plans.catalog_clusters import (_CLEAN, _ENG, _SENT, _dist_sql, FIXED_CENTROIDS, KP_CATEGORIES, KP_NUMBERS, Z7, clean_calls, cluster_sql, complete_features,
                                             fixed_clusters, kprototypes_input)
from ringlens.plans.registry import register
from ringlens.plans.stages import r9

_BASE = [_CLEAN.replace("SRC", "scored")]


def _z_sql(col: str, stats: str = "st") -> str:
    return f"round(CASE WHEN coalesce({stats}.s_{col}, 0) = 0 THEN 0.0 ELSE ({col} - {stats}.m_{col}) / {stats}.s_{col} END, 9)"


def _stats_sql(cols) -> str:
    return ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)


# --- feature tables ---

_COMPLETE = "duration_sec IS NOT NULL AND hour IS NOT NULL AND disconnected_reason IS NOT NULL AND pca_sentimiento IS NOT NULL"
_DOCUMENTED = ", ".join(O.q(v) for v in K.PROFILE_NO_REASON_VALUES)


@register("cluster_features_complete", O.with_stage("scored", [*_BASE, f"""f6 AS (
SELECT call_id, {_COMPLETE} AS whole, CAST(coalesce(duration_sec, (SELECT median(duration_sec) FROM conn WHERE {_COMPLETE})) AS DOUBLE) AS f_duration,
  CAST(hour AS DOUBLE) AS f_hour, CAST({_ENG} AS DOUBLE) AS f_engagement, CAST({_SENT} AS DOUBLE) AS f_sentiment,
  CASE WHEN pca_razon_churn IS NULL OR pca_razon_churn IN ({_DOCUMENTED}) THEN 0.0 ELSE 1.0 END AS f_has_reason,
  coalesce(CAST(inconsistency_flag AS DOUBLE), 0.0) AS f_inconsistency
FROM conn)""", f"st AS (SELECT {_stats_sql(FEATURES_6)} FROM f6 WHERE whole)"],
    f"SELECT call_id, whole AS trained_on, {', '.join(f'{_z_sql(c)} AS {c}_z' for c in FEATURES_6)} FROM f6, st"), "M2 M11 F6")
def cluster_features_complete(spark, sf):
    rows = complete_features(spark, sf)[1]
    whole = F.expr(_COMPLETE)
    return rows.select("call_id", whole.alias("trained_on"), *[r9(f"{c}_z").alias(f"{c}_z") for c in FEATURES_6])


_GROUP = f"""CASE WHEN pca_razon_churn IS NULL THEN 'sin_motivo' ELSE {O.case_map('lower(trim(pca_razon_churn))', K.CHURN_GROUPS, "'otro'")} END"""
_VARIABLES = f"""pv AS (
SELECT call_id, duration_sec, hour, CAST(duration_outlier AS INTEGER) AS duration_outlier_i, coalesce(CAST(inconsistency_flag AS INTEGER), 0) AS inconsistency_flag_i,
  coalesce(disconnected_reason, 'unknown') AS disconnected_reason, {_GROUP} AS razon_grupo, day_of_week FROM conn)"""


def _place_sql(col: str) -> str:
    names = f"(SELECT list_sort(list(DISTINCT {col})) FROM pv WHERE {col} IS NOT NULL)"
    return f"CAST(CASE WHEN {col} IS NULL THEN len({names}) ELSE list_position({names}, {col}) - 1 END AS DOUBLE) AS {col}_f"


_ORDINAL = [f"{c}_f" for c in (*KP_NUMBERS, *KP_CATEGORIES)]


@register("ordinal_features", O.with_stage("scored", [*_BASE, _VARIABLES, f"""o AS (
SELECT call_id, duration_outlier_i, inconsistency_flag_i, {', '.join(f'CAST(coalesce({c}, (SELECT median({c}) FROM pv)) AS DOUBLE) AS {c}_f' for c in KP_NUMBERS)},
  {', '.join(_place_sql(c) for c in KP_CATEGORIES)} FROM pv)""", f"st AS (SELECT {_stats_sql(_ORDINAL)} FROM o)"],
    f"SELECT call_id, duration_outlier_i, inconsistency_flag_i, {', '.join(f'{_z_sql(c)} AS {c}_z' for c in _ORDINAL)} FROM o, st"), "M13 P22 P23")
def ordinal_features(spark, sf):
    scaled, cols = CL.ordinal_features(prepare_variables(clean_calls(spark, sf).filter(F.col("connected"))))
    return scaled.select("call_id", "duration_outlier_i", "inconsistency_flag_i", *[r9(c).alias(c) for c in cols])


_KEY = f"(call_id % {SAMPLE_PRIME}) * {pow(SAMPLE_BASE, 1042, SAMPLE_PRIME)} % {SAMPLE_PRIME}"


@register("cluster_sample", O.with_stage("scored", _BASE, f"""
SELECT call_id FROM (SELECT call_id, row_number() OVER (ORDER BY {_KEY}) AS r, count(*) OVER () AS n FROM conn)
WHERE r <= greatest(500, CAST(floor(n * 0.15) AS BIGINT))"""), "M4")
def cluster_sample(spark, sf):
    return share_sample(clean_calls(spark, sf).filter(F.col("connected"))).select("call_id")


# --- K-Means ---

@register("kmeans_update_fixed", cluster_sql(f"""
SELECT cluster_id, count(*) AS n, round(sum(least({', '.join(_dist_sql(c) for c in FIXED_CENTROIDS)})), 6) AS cost,
  {', '.join(f'{O.r9(f"avg({c})")} AS c_{c}' for c in Z7)} FROM assigned GROUP BY cluster_id"""), "M5")
def kmeans_update_fixed(spark, sf):
    out = CL.lloyd_step(fixed_clusters(spark, sf), Z7, FIXED_CENTROIDS)
    return out.withColumns({"cost": F.round("cost", 6), **{f"c_{c}": r9(f"c_{c}") for c in Z7}})


_DOT = " + ".join(f"a.{c} * s.s_{c}" for c in Z7)
_NORM = " + ".join(f"{c} * {c}" for c in Z7)


@register("silhouette_fixed", cluster_sql("""
SELECT CAST((SELECT count(*) FROM s) AS INTEGER) AS k, round(avg(CASE WHEN own < other THEN 1 - own / other WHEN own > other THEN other / own - 1 ELSE 0 END), 9) AS silhouette_sq
FROM near""", extra=[f"s AS (SELECT cluster_id, count(*) AS n, sum({_NORM}) AS sq, {', '.join(f'sum({c}) AS s_{c}' for c in Z7)} FROM assigned GROUP BY cluster_id)",
                     f"""near AS (
SELECT a.call_id, max(CASE WHEN a.cluster_id = s.cluster_id THEN d * s.n / (s.n - 1) END) AS own, min(CASE WHEN a.cluster_id <> s.cluster_id THEN d END) AS other
FROM assigned a, s, LATERAL (SELECT {_NORM.replace('f_', 'a.f_')} + s.sq / s.n - 2 * ({_DOT}) / s.n AS d) GROUP BY a.call_id)"""]), "M9")
def silhouette_fixed(spark, sf):
    rows = assemble(fixed_clusters(spark, sf), Z7)
    k = rows.select("cluster_id").distinct().count()
    return spark.createDataFrame([(k, round(CL.silhouette_sq(rows, prediction="cluster_id"), 9))], "k int, silhouette_sq double")


# parameters: K and starts of the two rounds from drawn centres
ROUND_KS, ROUND_STARTS = (2, 3, 4), 2
_ZS = ", ".join(Z7)
_APART = " + ".join(f"(a.{c} - m.{c}) * (a.{c} - m.{c})" for c in Z7)
_STARTS = " UNION ALL ".join(f"""SELECT {s} AS s, {_ZS}, row_number() OVER (ORDER BY (call_id % {SAMPLE_PRIME}) * {pow(SAMPLE_BASE, 1042 + s, SAMPLE_PRIME)} % {SAMPLE_PRIME}, call_id) - 1 AS c
FROM assigned""" for s in range(ROUND_STARTS))


def _round_sql(name: str, centres: str) -> list[str]:
    """Rows at their nearest centre, and the centres that follow."""
    return [f"""{name} AS (SELECT * FROM (SELECT m.k, m.s, m.c, a.*, round({_APART}, 9) AS d FROM assigned a, {centres} m)
QUALIFY row_number() OVER (PARTITION BY k, s, call_id ORDER BY d, c) = 1)""",
            f"""{name}_next AS (SELECT m.k, m.s, m.c, {', '.join(f'coalesce(avg(n.{c}), any_value(m.{c})) AS {c}' for c in Z7)}
FROM {centres} m LEFT JOIN {name} n USING (k, s, c) GROUP BY m.k, m.s, m.c)"""]


@register("kmeans_two_rounds", cluster_sql(f"""
SELECT k, s AS start, CAST(c AS INTEGER) AS cluster_id, count(*) AS n, round(sum(d), 6) AS cost, {', '.join(f'{O.r9(f"avg({c})")} AS c_{c}' for c in Z7)}
FROM near1 GROUP BY k, s, c""", extra=[f"starts AS ({_STARTS})", f"m0 AS (SELECT k, s, c, {_ZS} FROM starts, (VALUES {', '.join(f'({k})' for k in ROUND_KS)}) t(k) WHERE c < k)",
                                      *_round_sql("near0", "m0"), *_round_sql("near1", "near0_next")]), "M5 M6")
def kmeans_two_rounds(spark, sf):
    """Two Lloyd rounds of every (K, start) in the same passes, from centres drawn by the portable key."""
    rows = fixed_clusters(spark, sf).select("call_id", *Z7)
    centres = drawn_starts(rows, Z7, list(ROUND_KS), ROUND_STARTS, 42, "call_id")
    out = []
    for last in (False, True):
        for (k, s), (n, cost, total, _) in lloyd_pass(rows, Z7, dict(centres)).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[k, s])
            if last:
                out += [(k, s, c, int(n[c]), round(float(cost[c]), 6), *map(float, new[c])) for c in range(k) if n[c]]
            centres[k, s] = new
    table = spark.createDataFrame(out, "k int, start int, cluster_id int, n long, cost double, " + ", ".join(f"c_{c} double" for c in Z7))
    return table.withColumns({f"c_{c}": r9(f"c_{c}") for c in Z7})


# parameter: rows of the Euclidean silhouette's sample
SAMPLED = 500


@register("silhouette_sampled_fixed", cluster_sql(f"""
SELECT count(*) AS n, round(avg(CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END), 9) AS silhouette FROM (
  SELECT call_id, max(CASE WHEN mine AND size > 1 THEN far / (size - 1) END) AS own, min(CASE WHEN NOT mine THEN far / size END) AS other FROM (
    SELECT a.call_id, a.cluster_id = m.cluster_id AS mine, sum(sqrt({_APART})) AS far, count(*) AS size
    FROM sampled a, sampled m GROUP BY a.call_id, a.cluster_id, m.cluster_id) GROUP BY call_id)""",
    extra=[f"sampled AS (SELECT * FROM assigned QUALIFY row_number() OVER (ORDER BY {_KEY}) <= {SAMPLED})"]), "M9")
def silhouette_sampled_fixed(spark, sf):
    sample = share_sample(fixed_clusters(spark, sf), 0.0, SAMPLED)
    return spark.createDataFrame([(sample.count(), round(sampled_silhouette(sample, Z7), 9))], "n long, silhouette double")


# --- K-Prototypes ---

# parameters: three fixed prototypes (scaled numbers, categories) and the weight of a mismatch
FIXED_PROTOTYPES = [([-0.8, -0.9, 0.0, 0.0], ["user_hangup", "sin_motivo", "lu"]), ([0.9, 0.1, 0.0, 0.0], ["agent_hangup", "sin_motivo", "ju"]),
                    ([0.0, 1.0, 0.0, 0.0], ["inactivity", "otro", "do"])]
GAMMA = 0.5
_KPZ = [f"{c}_z" for c in KP_NUMBERS]
_KP = [*_BASE, _VARIABLES, f"""kp AS (SELECT * REPLACE (coalesce(duration_sec, (SELECT median(duration_sec) FROM pv)) AS duration_sec) FROM pv)""",
       f"st AS (SELECT {_stats_sql(KP_NUMBERS)} FROM kp)",
       f"kz AS (SELECT call_id, {', '.join(KP_CATEGORIES)}, {', '.join(f'{_z_sql(c)} AS {c}_z' for c in KP_NUMBERS)} FROM kp, st)"]


def _proto_cost(numbers, categories) -> str:
    far = " + ".join(f"({c} - {v!r}) * ({c} - {v!r})" for c, v in zip(_KPZ, numbers))
    return far + "".join(f" + CASE WHEN {c} IS NOT DISTINCT FROM {O.q(v)} THEN 0.0::DOUBLE ELSE {GAMMA}::DOUBLE END" for c, v in zip(KP_CATEGORIES, categories))


@register("kprototypes_assign_fixed", O.with_stage("scored", [*_KP, f"kc AS (SELECT call_id, {', '.join(f'{_proto_cost(*p)} AS d{i}' for i, p in enumerate(FIXED_PROTOTYPES))} FROM kz)"], """
SELECT call_id, CASE WHEN d2 < least(d0, d1) THEN 2 WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster_id, round(least(d0, d1, d2), 9) AS cost FROM kc"""), "M12")
def kprototypes_assign_fixed(spark, sf):
    rows = kprototypes_input(spark, sf).withColumns({c: r9(c) for c in _KPZ})
    out = assign_to_prototypes(rows, _KPZ, KP_CATEGORIES, FIXED_PROTOTYPES, GAMMA)
    return out.select("call_id", "cluster_id", r9("_cost").alias("cost"))


_FAR = " + ".join(f"(a.{c} - m.{c}) * (a.{c} - m.{c})" for c in _KPZ) + "".join(
    f" + CASE WHEN a.{c} IS NOT DISTINCT FROM m.{c} THEN 0.0::DOUBLE ELSE {GAMMA}::DOUBLE END" for c in KP_CATEGORIES)


@register("mixed_silhouette_fixed", O.with_stage("scored", [*_KP, f"""kc AS (SELECT call_id, {', '.join(f'{_proto_cost(*p)} AS d{i}' for i, p in enumerate(FIXED_PROTOTYPES))} FROM kz)""",
    "kl AS (SELECT kz.*, CASE WHEN d2 < least(d0, d1) THEN 2 WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster_id FROM kz JOIN kc USING (call_id))"], f"""
SELECT CAST(count(DISTINCT cluster_id) AS INTEGER) AS k, count(*) AS n,
  round(avg(CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END), 9) AS silhouette FROM (
  SELECT call_id, cluster_id, max(CASE WHEN mine AND size > 1 THEN far / (size - 1) END) AS own, min(CASE WHEN NOT mine THEN far / size END) AS other FROM (
    SELECT a.call_id, a.cluster_id, a.cluster_id = m.cluster_id AS mine, sum({_FAR}) AS far, count(*) AS size
    FROM kl a, kl m GROUP BY a.call_id, a.cluster_id, m.cluster_id) GROUP BY call_id, cluster_id)"""), "M6 M12")
def mixed_silhouette_fixed(spark, sf):
    rows = kprototypes_input(spark, sf).withColumns({c: r9(c) for c in _KPZ})
    out = assign_to_prototypes(rows, _KPZ, KP_CATEGORIES, FIXED_PROTOTYPES, GAMMA)
    return spark.createDataFrame([(out.select("cluster_id").distinct().count(), out.count(), round(mixed_silhouette(out, _KPZ, KP_CATEGORIES, GAMMA), 9))],
                                 "k int, n long, silhouette double")


def _mode_sql(i: int) -> str:
    """CTE of the i-th initial mode: the densest tuple that is furthest from those before it."""
    far = [" + ".join(f"CASE WHEN d.{c} IS NOT DISTINCT FROM m{j}.{c} THEN 0 ELSE 1 END" for c in KP_CATEGORIES) for j in range(i)]
    score = "d.dens" if i == 0 else f"least({', '.join(f'd.dens * ({x})' for x in far)})" if i > 1 else f"d.dens * ({far[0]})"
    return (f"m{i} AS (SELECT {', '.join(f'd.{c}' for c in KP_CATEGORIES)} FROM {', '.join(['d', *[f'm{j}' for j in range(i)]])} "
            f"ORDER BY {score} DESC, {', '.join(f'd.{c} NULLS FIRST' for c in KP_CATEGORIES)} LIMIT 1)")


@register("kprototypes_initial_modes", O.with_stage("scored", [*_KP, f"t AS (SELECT {', '.join(KP_CATEGORIES)}, count(*) AS w FROM kz GROUP BY ALL)",
    f"d AS (SELECT t.*, ({' + '.join(f'sum(w) OVER (PARTITION BY {c})' for c in KP_CATEGORIES)}) / (SELECT sum(w) FROM t) / 3 AS dens FROM t)",
    *[_mode_sql(i) for i in range(4)]], " UNION ALL ".join(f"SELECT {i} AS mode, * FROM m{i}" for i in range(4))), "M12")
def kprototypes_initial_modes(spark, sf):
    modes = cao_init(kprototypes_input(spark, sf), KP_CATEGORIES, 4)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(modes)], "mode int, " + ", ".join(f"{c} string" for c in KP_CATEGORIES))
