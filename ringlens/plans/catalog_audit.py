"""Registered queries: profiles, statistics, elimination accounting."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.operators import elimination as EL
from ringlens.operators import profile as PR
from ringlens.operators import stats as ST
from ringlens.operators.clean import filter_outliers
from ringlens.functions.categorical import significance
from ringlens.operators.reports import describe, distinct_sorted
from ringlens.plans import oracle_sql as O
from ringlens.plans.registry import register
from ringlens.plans.stages import limits, prepared, r9, table, with_outliers

# explicit schema of the prepared call table (the profile reports it)
PREPARED_TYPES = {
    "call_id": "bigint", "campaign_id": "string", "name": "string", "target_id": "bigint", "call_url": "string",
    "connected": "boolean", "disconnected_reason": "string", "duration_ms": "double", "transcript": "string",
    "post_call_analysis": "string", "executed_at": "timestamp_ntz", "call_completed": "boolean", "hour": "int",
    "day_of_month": "int", "date": "string", "day_of_week": "string", "duration_sec": "double",
    "pca_resumen": "string", "pca_sentimiento": "string", "pca_razon_churn": "string",
    "pca_posible_recuperacion": "string", "pca_no_recarga": "string", "pca_dificultad_tecnica": "string",
    "transcript_text": "string", "transcript_length": "int", "inconsistency_flag": "boolean", "campaign_type": "string",
}

NUMERICS = ["duration_sec", "hour", "transcript_length"]
CATEGORICALS = ["disconnected_reason", "day_of_week", "campaign_type", "sentiment_own", "pca_sentimiento"]
V_COLUMNS = ["disconnected_reason", "day_of_week", "campaign_type", "sentiment_own", "connected", "call_completed",
             "inconsistency_flag"]
_PRE = f"hour <> 0 AND campaign_type <> '{K.TEST_CAMPAIGN}'"
_FENCE = f"""fence AS (
SELECT q1 - {K.IQR_MULTIPLIER} * (q3 - q1) AS lo, q3 + {K.IQR_MULTIPLIER} * (q3 - q1) AS hi FROM (
  SELECT {O.nearest_q('prepared', 'duration_sec', 0.25, _PRE)} AS q1,
         {O.nearest_q('prepared', 'duration_sec', 0.75, _PRE)} AS q3))"""
_STATUS = f"""st AS (
SELECT s.*, coalesce({_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi, false) AS kept,
  CASE WHEN coalesce(hour = 0, false) THEN 'hour_0'
       WHEN coalesce(campaign_type = '{K.TEST_CAMPAIGN}', false) THEN 'campaign_prueba'
       WHEN duration_sec IS NOT NULL AND (duration_sec < fence.lo OR duration_sec > fence.hi) THEN 'outlier_duration'
       ELSE 'disconnected_or_incomplete' END AS cause0
FROM scored s, fence),
status AS (SELECT * EXCLUDE (cause0), CASE WHEN kept THEN NULL ELSE cause0 END AS cause FROM st)"""
_SEG = f"""seg AS (
SELECT *, unnest(list_filter([CASE WHEN coalesce(hour = 0, false) THEN 'hora_0' END,
  CASE WHEN coalesce(campaign_type = '{K.TEST_CAMPAIGN}', false) THEN 'prueba' END,
  CASE WHEN coalesce(hour <> 0 AND campaign_type <> '{K.TEST_CAMPAIGN}', false) THEN 'resto' END],
  lambda s: s IS NOT NULL)) AS segment FROM scored)"""


def _status_df(spark, sf):
    return table(spark, sf), limits(spark, sf)[1]


def _normal_tail_sql(z: str) -> str:
    a = f"abs({z})"

    def horner(coefs):
        acc = f"({coefs[0]!r} * {a} + {coefs[1]!r})"
        for c in coefs[2:]:
            acc = f"({acc} * {a} + {c!r})"
        return acc

    e = f"exp(-{a} * {a} / 2.0)"
    b = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        b = f"({a} + {k!r} / {b})"
    return (f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {ST._HART_SPLIT!r} THEN {e} * {horner(ST._HART_NUM)} / "
            f"{horner(ST._HART_DEN)} ELSE {e} / {b} / {ST._SQRT_2PI!r} END")


# ---------------------------------------------------------------------------
# profile and validation
# ---------------------------------------------------------------------------

def _profile_sql() -> str:
    parts = []
    for c, t in PREPARED_TYPES.items():
        parts.append(f"""SELECT '{c}' AS column, '{t}' AS dtype, count(*) - count({c}) AS nulls, count({c}) AS valid,
  (count(*) - count({c})) / count(*) AS pct_null, count({c}) / count(*) AS pct_valid,
  CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM prepared""")
    return O.with_stage("prepared", [], "\nUNION ALL\n".join(parts))


@register("column_profile", _profile_sql(), "A28")
def column_profile(spark, sf):
    # 24 columns come from the narrow stage table; only the three raw text columns need the
    # lazy cleaning plan (pruned to them)
    raw = [c for c in PREPARED_TYPES if c in ("transcript", "post_call_analysis", "transcript_text")]
    rest = [c for c in PREPARED_TYPES if c not in raw]
    return PR.column_profile(table(spark, sf).select(*rest)).unionByName(
        PR.column_profile(prepared(spark, sf).select(*raw)))


@register("connected_totals", O.with_stage("prepared", [], """
SELECT count(*) AS total, count(*) FILTER (WHERE connected) AS connected,
  count(*) FILTER (WHERE NOT coalesce(connected, false)) AS not_connected FROM prepared"""), "A29 F5")
def connected_totals(spark, sf):
    return PR.connected_totals(table(spark, sf))


@register("validation_report", O.with_stage("prepared", [_FENCE], f"""
SELECT count(*) AS n_original,
  count(*) FILTER (WHERE coalesce({_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi, false)) AS n_clean,
  count(*) FILTER (WHERE coalesce({_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi, false) AND executed_at IS NULL)
    AS null_executed_at,
  count(*) FILTER (WHERE coalesce({_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi, false) AND inconsistency_flag)
    AS inconsistent,
  count(*) FILTER (WHERE post_call_analysis IS NOT NULL AND NOT json_valid(post_call_analysis)) AS bad_json_pca,
  count(*) FILTER (WHERE transcript IS NOT NULL AND transcript_text IS NULL) AS bad_json_transcript,
  count(*) FILTER (WHERE coalesce({_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi, false)
    AND coalesce(duration_ms > {O.nearest_q('prepared', 'duration_ms', K.P99_QUANTILE)}, false)) AS outliers_p99,
  CAST([] AS VARCHAR[]) AS missing_columns
FROM prepared, fence"""), "A30 N14 P5")
def validation_report(spark, sf):
    return PR.validation_report(with_outliers(prepared(spark, sf), spark, sf), limits(spark, sf)[1])


@register("sentiment_domain_check", O.with_stage("prepared", [], f"""
SELECT pca_sentimiento, count(*) AS n FROM prepared
WHERE pca_sentimiento IS NOT NULL AND pca_sentimiento NOT IN ({', '.join(O.q(s) for s in K.SENTIMENTS)})
GROUP BY pca_sentimiento"""), "A31")
def sentiment_domain_check(spark, sf):
    return PR.unexpected_values(table(spark, sf))


@register("connected_completed_crosstab", O.with_stage("prepared", ["""ct AS (
SELECT connected, call_completed, count(*) AS n FROM prepared GROUP BY connected, call_completed)"""], """
SELECT connected, call_completed, n,
  CAST(sum(CASE WHEN connected IS DISTINCT FROM call_completed THEN n ELSE 0 END) OVER () AS BIGINT) AS n_differing,
  sum(CASE WHEN connected IS DISTINCT FROM call_completed THEN n ELSE 0 END) OVER () = 0 AS columns_equal
FROM ct"""), "A32 F10")
def connected_completed_crosstab(spark, sf):
    return PR.connected_completed_crosstab(table(spark, sf))


@register("hour_distribution", O.with_stage("prepared", [], """
SELECT hour, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct, coalesce(hour = 0, false) AS candidate
FROM prepared GROUP BY hour"""), "A33")
def hour_distribution(spark, sf):
    return PR.hour_distribution(table(spark, sf))


@register("segment_summary", O.with_stage("scored", [_SEG], """
SELECT segment, count(*) AS n, CAST(coalesce(sum(CAST(connected AS INTEGER)), 0) AS BIGINT) AS n_connected,
  count(*) FILTER (WHERE transcript_text IS NOT NULL AND transcript_length > 0) AS n_transcript,
  coalesce(sum(CAST(connected AS INTEGER)), 0) / count(*) AS connection_rate,
  count(*) FILTER (WHERE transcript_text IS NOT NULL AND transcript_length > 0) / count(*) AS transcript_rate
FROM seg GROUP BY segment"""), "A34 A35 F11")
def segment_summary(spark, sf):
    return PR.segment_summary(table(spark, sf))


@register("segment_reason_distribution", O.with_stage("scored", [_SEG], """
SELECT segment, disconnected_reason, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY segment) AS pct
FROM seg WHERE connected GROUP BY segment, disconnected_reason"""), "A34")
def segment_reason_distribution(spark, sf):
    return PR.segment_distribution(table(spark, sf), "disconnected_reason")


@register("segment_duration_describe", O.with_stage("scored", [_SEG], f"""
SELECT segment, count(*) AS n, {O.r9('avg(duration_sec)')} AS mean, {O.r9('median(duration_sec)')} AS median,
  {O.r9('stddev_pop(duration_sec)')} AS std, {O.r9('quantile_cont(duration_sec, 0.25)')} AS q25,
  {O.r9('quantile_cont(duration_sec, 0.75)')} AS q75, min(duration_sec) AS min, max(duration_sec) AS max
FROM seg WHERE connected AND duration_sec IS NOT NULL GROUP BY segment"""), "A36")
def segment_duration_describe(spark, sf):
    seg = ST.segments(table(spark, sf).filter(F.col("connected")))
    out = describe(seg, "duration_sec", ["segment"])
    return out.withColumns({c: r9(c) for c in ["mean", "median", "std", "q25", "q75"]})


# ---------------------------------------------------------------------------
# tests and association statistics
# ---------------------------------------------------------------------------

_ZT = f"""c AS (
SELECT segment, count(*) AS n, coalesce(sum(CAST(connected AS INTEGER)), 0) AS c FROM seg GROUP BY segment),
zt0 AS (
SELECT a.segment, a.n AS n_a, a.c AS c_a, b.n AS n_b, b.c AS c_b,
  CASE WHEN a.n > 0 THEN a.c / a.n ELSE 0.0 END AS rate_a, CASE WHEN b.n > 0 THEN b.c / b.n ELSE 0.0 END AS rate_b,
  sqrt(((a.c + b.c) / (a.n + b.n)) * (1.0 - (a.c + b.c) / (a.n + b.n)) * (1.0 / a.n + 1.0 / b.n)) AS se
FROM c a, c b WHERE a.segment <> 'resto' AND b.segment = 'resto'),
zt AS (
SELECT *, CASE WHEN coalesce(se, 0.0) = 0 THEN 0.0 ELSE (rate_a - rate_b) / se END AS z FROM zt0)"""


@register("segment_ztest", O.with_stage("scored", [_SEG, _ZT], f"""
SELECT segment, CAST(n_a AS BIGINT) AS n_a, CAST(c_a AS BIGINT) AS c_a, CAST(n_b AS BIGINT) AS n_b,
  CAST(c_b AS BIGINT) AS c_b, rate_a, rate_b, {O.r9('z')} AS z,
  {O.r9(f"CASE WHEN coalesce(se, 0.0) = 0 THEN 1.0 ELSE least(1.0, 2.0 * ({_normal_tail_sql('z')})) END")} AS p_value
FROM zt"""), "T1")
def segment_ztest(spark, sf):
    out = ST.segment_ztests(table(spark, sf))
    return out.withColumns({"z": r9("z"), "p_value": r9("p_value")})


@register("segment_ztest_labels", O.with_stage("scored", [_SEG, _ZT, f"""zp AS (
SELECT segment, CASE WHEN coalesce(se, 0.0) = 0 THEN 1.0 ELSE least(1.0, 2.0 * ({_normal_tail_sql('z')})) END AS p FROM zt)"""],
                                                   """
SELECT segment, CASE WHEN p IS NULL OR isnan(p) THEN 'N/A' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**'
  WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance FROM zp"""), "P26 T1")
def segment_ztest_labels(spark, sf):
    out = ST.segment_ztests(table(spark, sf))
    return out.select("segment", significance("p_value").alias("significance"))


_MW = f"""mw0 AS (
SELECT segment AS test, 'a' AS side, duration_sec AS v FROM seg WHERE connected AND segment <> 'resto'
UNION ALL SELECT unnest(['hora_0', 'prueba']) AS test, 'b' AS side, duration_sec AS v FROM seg
  WHERE connected AND segment = 'resto'),
mw1 AS (
SELECT test, v, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS nb,
  count(*) AS cnt FROM mw0 WHERE v IS NOT NULL GROUP BY test, v),
mw2 AS (
SELECT *, coalesce(sum(cnt) OVER (PARTITION BY test ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + (cnt + 1) / 2.0 AS midrank FROM mw1),
mw3 AS (
SELECT test, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, sum(na * midrank) AS rank_sum_a,
  sum(CAST(cnt AS DOUBLE) ^ 3 - cnt) AS tie_term FROM mw2 GROUP BY test),
mw4 AS (
SELECT *, rank_sum_a - n_a * (n_a + 1) / 2.0 AS u1,
  sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - tie_term / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS sd FROM mw3),
mw AS (
SELECT *, (greatest(u1, n_a * n_b - u1) - n_a * n_b / 2.0 - 0.5) / sd AS zz FROM mw4)"""


@register("segment_mannwhitney", O.with_stage("scored", [_SEG, _MW], f"""
SELECT test, n_a, n_b, rank_sum_a, tie_term,
  CASE WHEN n_a < 2 OR n_b < 2 THEN 'NaN'::DOUBLE ELSE u1 END AS u,
  CASE WHEN n_a < 2 OR n_b < 2 THEN 'none' ELSE 'asymptotic' END AS method,
  {O.r9(f"CASE WHEN n_a < 2 OR n_b < 2 THEN 'NaN'::DOUBLE WHEN zz < 0 THEN 1.0 ELSE least(1.0, 2.0 * ({_normal_tail_sql('zz')})) END")}
    AS p_value
FROM mw"""), "T2")
def segment_mannwhitney(spark, sf):
    return ST.segment_duration_tests(table(spark, sf)).withColumn("p_value", r9("p_value"))


def _spearman_sql() -> str:
    parts = []
    for a, b in combinations(NUMERICS, 2):
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n,
  {O.r9(f"CASE WHEN count(*) < {K.MIN_PAIRS} THEN 'NaN'::DOUBLE ELSE corr(rx, ry) END")} AS rho FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM prepared
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""")
    return O.with_stage("prepared", [], "\nUNION ALL\n".join(parts))


@register("spearman_matrix", _spearman_sql(), "T3")
def spearman_matrix(spark, sf):
    return ST.spearman(table(spark, sf), NUMERICS).withColumn("rho", r9("rho"))


def _eta_sql() -> str:
    parts = []
    for n in NUMERICS:
        for c in CATEGORICALS:
            parts.append(f"""SELECT '{n}' AS num, '{c}' AS cat, CAST({c} AS VARCHAR) AS level, CAST({n} AS DOUBLE) AS x
FROM scored WHERE {n} IS NOT NULL AND {c} IS NOT NULL""")
    stacked = "\nUNION ALL\n".join(parts)
    return O.with_stage("scored", [f"stk AS ({stacked})", """g AS (
SELECT num, cat, level, count(*) AS n_g, avg(x) AS mean_g, var_pop(x) * count(*) AS ss_w FROM stk GROUP BY num, cat, level)""",
                                   """g2 AS (
SELECT *, sum(n_g) OVER (PARTITION BY num, cat) AS n,
  sum(n_g * mean_g) OVER (PARTITION BY num, cat) / sum(n_g) OVER (PARTITION BY num, cat) AS grand FROM g)""",
                                   """e AS (
SELECT num, cat, CAST(max(n) AS BIGINT) AS n, sum(n_g * (mean_g - grand) ^ 2) AS ss_between, sum(ss_w) AS ss_within
FROM g2 GROUP BY num, cat)"""], f"""
SELECT num, cat, n, {O.r9(f"CASE WHEN n < {K.MIN_PAIRS} OR ss_between + ss_within = 0 THEN 'NaN'::DOUBLE ELSE least(1.0, ss_between / (ss_between + ss_within)) END")}
    AS eta_squared
FROM e""")


@register("eta_squared_matrix", _eta_sql(), "T4")
def eta_squared_matrix(spark, sf):
    out = ST.eta_squared(table(spark, sf), NUMERICS, CATEGORICALS)
    return out.select("num", "cat", "n", r9("eta_squared").alias("eta_squared"))


def _v_sql() -> str:
    parts = []
    for a, b in combinations(V_COLUMNS, 2):
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb
FROM scored WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")
    stacked = "\nUNION ALL\n".join(parts)
    return O.with_stage("scored", [
        f"stk AS ({stacked})",
        "cells AS (SELECT col_a, col_b, va, vb, count(*) AS o FROM stk GROUP BY ALL)",
        "ra AS (SELECT col_a, col_b, va, sum(o) AS ra FROM cells GROUP BY ALL)",
        "cb AS (SELECT col_a, col_b, vb, sum(o) AS cb FROM cells GROUP BY ALL)",
        """dims AS (SELECT col_a, col_b, sum(o) AS n, count(DISTINCT va) AS r, count(DISTINCT vb) AS c
FROM cells GROUP BY ALL)""",
        """grid AS (
SELECT ra.col_a, ra.col_b, ra.va, cb.vb, ra.ra, cb.cb, d.n, d.r, d.c, CAST(coalesce(cells.o, 0) AS DOUBLE) AS o,
  ra.ra * cb.cb / d.n AS e
FROM ra JOIN cb USING (col_a, col_b) JOIN dims d USING (col_a, col_b)
LEFT JOIN cells USING (col_a, col_b, va, vb))""",
        """chi AS (
SELECT col_a, col_b, CAST(max(n) AS BIGINT) AS n, CAST(max(r) AS BIGINT) AS r, CAST(max(c) AS BIGINT) AS c,
  sum(((CASE WHEN r = 2 AND c = 2 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END) - e) ^ 2 / e) AS chi2
FROM grid GROUP BY col_a, col_b)"""], f"""
SELECT col_a, col_b, n, r, c, {O.r9('chi2')} AS chi2,
  {O.r9(f"CASE WHEN n < {K.MIN_PAIRS} OR least(r, c) - 1 = 0 THEN 'NaN'::DOUBLE ELSE least(1.0, sqrt(chi2 / (n * (least(r, c) - 1)))) END")}
    AS cramers_v
FROM chi""")


@register("cramers_v_matrix", _v_sql(), "T5")
def cramers_v_matrix(spark, sf):
    out = ST.cramers_v(table(spark, sf), V_COLUMNS)
    return out.withColumns({"chi2": r9("chi2"), "cramers_v": r9("cramers_v")})


# columns of the stage table that can take part in the association audit (the others are keys, dates or long text)
_AUDIT_NUMBERS = {"hour": "int", "day_of_month": "int", "duration_sec": "double", "transcript_length": "int"}
_AUDIT_STRINGS = ["disconnected_reason", "day_of_week", "pca_sentimiento", "pca_razon_churn", "pca_posible_recuperacion",
                  "pca_no_recarga", "pca_dificultad_tecnica", "campaign_type", "sentiment_own"]
_AUDIT_FLAGS = ["connected", "call_completed", "inconsistency_flag", *K.FAIL_COLUMNS]


def _recommendation_sql() -> str:
    """T6 and T7 in SQL: kinds from distinct counts, then eta^2, rho and V of the columns of each kind."""
    every = [*_AUDIT_NUMBERS, *_AUDIT_STRINGS, *_AUDIT_FLAGS]
    distinct = "\nUNION ALL\n".join(
        f"SELECT {i} AS pos, '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM flagged"
        for i, c in enumerate(every))
    whole = ", ".join(O.q(c) for c, t in _AUDIT_NUMBERS.items() if t == "int")
    numbers = ", ".join(O.q(c) for c in _AUDIT_NUMBERS)
    flags = ", ".join(O.q(c) for c in _AUDIT_FLAGS)
    long = "\nUNION ALL\n".join(
        f"SELECT call_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS level, "
        f"{f'CAST({c} AS DOUBLE)' if c in _AUDIT_NUMBERS else 'NULL::DOUBLE'} AS x FROM flagged WHERE {c} IS NOT NULL" for c in every)
    return O.with_stage("flagged", [
        f"counted AS ({distinct})",
        f"""kinds AS (
SELECT pos, feature, CASE WHEN feature IN ({flags}) OR (feature IN ({whole}) AND n <= 2) THEN 'binary'
  WHEN feature = 'day_of_month' THEN NULL WHEN feature IN ({numbers}) THEN 'numeric'
  WHEN n <= {K.CATEGORY_MAX_DISTINCT} THEN 'categorical' END AS kind FROM counted)""",
        f"long AS (SELECT l.*, k.kind, k.pos FROM ({long}) l JOIN kinds k USING (feature) WHERE k.kind IS NOT NULL)",
        """eg AS (
SELECT a.feature AS num, b.feature AS cat, b.level, count(*) AS n_g, avg(a.x) AS m, var_pop(a.x) * count(*) AS ss
FROM long a JOIN long b USING (call_id) WHERE a.kind = 'numeric' AND b.kind = 'categorical' GROUP BY ALL)""",
        f"""eta AS (
SELECT num AS feature, max(between_ss / (between_ss + within_ss)) AS strength FROM (
  SELECT num, cat, sum(n_g) AS n, sum(n_g * (m - grand) ^ 2) AS between_ss, sum(ss) AS within_ss FROM (
    SELECT *, sum(n_g * m) OVER (PARTITION BY num, cat) / sum(n_g) OVER (PARTITION BY num, cat) AS grand FROM eg) GROUP BY num, cat)
WHERE n >= {K.MIN_PAIRS} AND between_ss + within_ss > 0 GROUP BY num)""",
        """vcell AS (
SELECT a.feature AS fa, b.feature AS fb, a.level AS la, b.level AS lb, count(*) AS o
FROM long a JOIN long b USING (call_id) WHERE a.kind <> 'numeric' AND b.kind <> 'numeric' AND a.pos < b.pos GROUP BY ALL)""",
        "vr AS (SELECT fa, fb, la, sum(o) AS ra FROM vcell GROUP BY ALL)",
        "vc AS (SELECT fa, fb, lb, sum(o) AS cb FROM vcell GROUP BY ALL)",
        """vd AS (SELECT fa, fb, sum(o) AS n, count(DISTINCT la) AS r, count(DISTINCT lb) AS c FROM vcell GROUP BY ALL)""",
        """vg AS (
SELECT fa, fb, n, r, c, coalesce(o, 0) AS o, ra * cb / n AS e FROM vr JOIN vc USING (fa, fb) JOIN vd USING (fa, fb)
LEFT JOIN vcell USING (fa, fb, la, lb))""",
        f"""v AS (
SELECT fa, fb, least(1.0, sqrt(sum((CASE WHEN r = 2 AND c = 2 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END - e) ^ 2 / e)
    / (max(n) * (least(max(r), max(c)) - 1)))) AS v
FROM vg WHERE n >= {K.MIN_PAIRS} AND least(r, c) > 1 GROUP BY fa, fb)""",
        "vmax AS (SELECT feature, max(v) AS strength FROM (SELECT fa AS feature, v FROM v UNION ALL SELECT fb, v FROM v) GROUP BY feature)",
        """xy AS (
SELECT a.feature AS fa, b.feature AS fb, a.x AS x, b.x AS y FROM long a JOIN long b USING (call_id)
WHERE a.kind = 'numeric' AND b.kind = 'numeric' AND a.feature <> b.feature)""",
        f"""twins AS (
SELECT fa, fb FROM (
  SELECT fa, fb, rank() OVER (PARTITION BY fa, fb ORDER BY x) + (count(*) OVER (PARTITION BY fa, fb, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY fa, fb ORDER BY y) + (count(*) OVER (PARTITION BY fa, fb, y) - 1) / 2.0 AS ry FROM xy)
GROUP BY fa, fb HAVING count(*) >= {K.MIN_PAIRS} AND var_pop(rx) > 0 AND var_pop(ry) > 0 AND abs(corr(rx, ry)) >= {K.REDUNDANCY_THRESHOLD})""",
        # numerics one after the other, in column order: taken unless an earlier taken one is a twin
        "nums AS (SELECT feature, row_number() OVER (ORDER BY pos) AS i FROM kinds WHERE kind = 'numeric')",
        """walk(i, taken) AS (
SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
SELECT nums.i, CASE WHEN EXISTS (SELECT 1 FROM twins WHERE fa = nums.feature AND list_contains(taken, fb)) THEN taken
  ELSE list_append(taken, nums.feature) END FROM walk JOIN nums ON nums.i = walk.i + 1)""",
        "final AS (SELECT taken FROM walk ORDER BY i DESC LIMIT 1)",
        f"""rated AS (
SELECT k.feature, k.kind, CASE WHEN k.kind = 'numeric' AND NOT list_contains((SELECT taken FROM final), k.feature)
    THEN (SELECT first(n.feature ORDER BY n.i) FROM nums n JOIN twins t ON t.fa = k.feature AND t.fb = n.feature
          WHERE list_contains((SELECT taken FROM final), n.feature)) END AS redundant_with,
  coalesce(CASE WHEN k.kind = 'numeric' THEN eta.strength ELSE vmax.strength END, 0.0) AS strength
FROM kinds k LEFT JOIN eta USING (feature) LEFT JOIN vmax USING (feature) WHERE k.kind IS NOT NULL)""",
        f"""judged AS (
SELECT *, redundant_with IS NULL AND ((kind = 'numeric' AND strength >= {K.ETA2_THRESHOLD})
  OR (kind = 'categorical' AND strength >= {K.CRAMERS_V_THRESHOLD})) AS recommended FROM rated)"""], f"""
SELECT feature, kind, recommended, redundant_with, {O.r9('strength')} AS strength,
  CASE WHEN (SELECT bool_or(recommended AND kind = 'categorical') FROM judged) THEN 'K-Prototypes' ELSE 'K-Means' END AS algorithm
FROM judged""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("feature_recommendation", _recommendation_sql(), "T6 T7")
def feature_recommendation(spark, sf):
    df = table(spark, sf)
    prof = PR.column_profile(df)
    kinds = ST.classify_columns(df, prof)
    cats, bins = kinds["categorical"], kinds["binary"]
    rho = ST.spearman(df, kinds["numeric"])
    eta = ST.eta_squared(df, kinds["numeric"], cats)
    v = ST.cramers_v(df, cats + bins)
    out = ST.recommend_features(rho, eta, v, kinds["numeric"], cats, bins)
    return out.withColumn("strength", r9("strength"))


_MWP = f"""CASE WHEN n_a < 2 OR n_b < 2 THEN 'NaN'::DOUBLE WHEN zz < 0 THEN 1.0
  ELSE least(1.0, 2.0 * ({_normal_tail_sql('zz')})) END"""
_ZP = f"CASE WHEN coalesce(se, 0.0) = 0 THEN 1.0 ELSE least(1.0, 2.0 * ({_normal_tail_sql('z')})) END"


@register("exclusion_verdict", O.with_stage("scored", [_SEG, _ZT, _MW, f"""v AS (
SELECT zt.segment, CAST(zt.n_a AS BIGINT) AS n_a, {_ZP} AS p_rate, {_MWP.replace('n_a', 'mw.n_a').replace('n_b', 'mw.n_b')}
  AS p_duration
FROM zt LEFT JOIN mw ON mw.test = zt.segment)"""], f"""
SELECT segment, n_a, {O.r9('p_rate')} AS p_rate, {O.r9('p_duration')} AS p_duration,
  coalesce(NOT isnan(p_rate) AND p_rate < 0.05, false) AS rate_differs,
  coalesce(NOT isnan(p_duration) AND p_duration < 0.05, false) AS duration_differs,
  n_a < {K.LOW_VOLUME} AS low_volume,
  coalesce(NOT isnan(p_rate) AND p_rate < 0.05, false) OR coalesce(NOT isnan(p_duration) AND p_duration < 0.05, false)
    OR n_a < {K.LOW_VOLUME} AS exclude
FROM v"""), "T8 T1 T2")
def exclusion_verdict(spark, sf):
    df = table(spark, sf)
    out = ST.exclusion_verdict(ST.segment_ztests(df), ST.segment_duration_tests(df))
    return out.withColumns({"p_rate": r9("p_rate"), "p_duration": r9("p_duration")})


# ---------------------------------------------------------------------------
# elimination accounting
# ---------------------------------------------------------------------------

@register("eliminated_rows", O.with_stage("scored", [_FENCE, _STATUS], """
SELECT call_id, cause FROM status WHERE NOT kept"""), "J7 O6 O9")
def eliminated_rows(spark, sf):
    df, fence = _status_df(spark, sf)
    clean = filter_outliers(df, fence)
    gone = EL.eliminated_rows(df, clean, "call_id")
    return gone.select("call_id", EL.elimination_cause(fence).alias("cause"))


@register("elimination_causes", O.with_stage("scored", [_FENCE, _STATUS], f"""
SELECT cause, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct,
  CAST(list_position([{', '.join(O.q(c) for c in EL.CAUSE_ORDER)}], cause) AS INTEGER) AS cause_rank
FROM status WHERE NOT kept GROUP BY cause"""), "A37")
def elimination_causes(spark, sf):
    df, fence = _status_df(spark, sf)
    return EL.elimination_causes(df, fence)


def _removed_sql(by: str) -> str:
    return O.with_stage("scored", [_FENCE, _STATUS], f"""
SELECT {by}, count(*) AS total, count(*) FILTER (WHERE NOT kept) AS removed,
  count(*) - count(*) FILTER (WHERE NOT kept) AS kept, count(*) FILTER (WHERE NOT kept) / count(*) AS pct_removed
FROM status GROUP BY {by}""")


@register("removed_by_hour", _removed_sql("hour"), "A38")
def removed_by_hour(spark, sf):
    df, fence = _status_df(spark, sf)
    return EL.removed_by(df, fence, "hour")


@register("removed_by_campaign", _removed_sql("campaign_type"), "A38")
def removed_by_campaign(spark, sf):
    df, fence = _status_df(spark, sf)
    return EL.removed_by(df, fence, "campaign_type")


@register("kept_vs_removed", O.with_stage("scored", [_FENCE, _STATUS, """b AS (
SELECT CASE WHEN kept THEN 'kept' ELSE 'removed' END AS status, count(*) AS n,
  CAST(coalesce(sum(CAST(connected AS INTEGER)), 0) AS BIGINT) AS n_connected FROM status GROUP BY 1)""", f"""d AS (
SELECT CASE WHEN kept THEN 'kept' ELSE 'removed' END AS status, count(*) AS n_duration,
  {O.r9('avg(duration_sec)')} AS mean, {O.r9('median(duration_sec)')} AS median, {O.r9('stddev_pop(duration_sec)')} AS std,
  {O.r9('quantile_cont(duration_sec, 0.25)')} AS q25, {O.r9('quantile_cont(duration_sec, 0.75)')} AS q75,
  min(duration_sec) AS min, max(duration_sec) AS max
FROM status WHERE connected AND duration_sec IS NOT NULL GROUP BY 1)"""], """
SELECT b.status, b.n, b.n_connected, b.n_connected / b.n AS connection_rate, d.* EXCLUDE (status)
FROM b LEFT JOIN d USING (status)"""), "A39 A36")
def kept_vs_removed(spark, sf):
    df, fence = _status_df(spark, sf)
    out = EL.kept_vs_removed(df, fence)
    return out.withColumns({c: r9(c) for c in ["mean", "median", "std", "q25", "q75"]})


@register("elimination_cause_detail", O.with_stage("scored", [_FENCE, _STATUS], f"""
SELECT cause, count(*) AS n, count(*) FILTER (WHERE coalesce(connected, false)) AS n_connected,
  {O.r9('avg(CASE WHEN coalesce(connected, false) THEN duration_sec END)')} AS dur_mean,
  {O.r9('median(CASE WHEN coalesce(connected, false) THEN duration_sec END)')} AS dur_median,
  count(*) FILTER (WHERE coalesce(connected, false)) / count(*) AS pct_connected
FROM status WHERE NOT kept GROUP BY cause"""), "A39")
def elimination_cause_detail(spark, sf):
    df, fence = _status_df(spark, sf)
    return EL.cause_detail(df, fence).withColumns({"dur_mean": r9("dur_mean"), "dur_median": r9("dur_median")})


@register("duration_histogram", O.with_stage("scored", [_FENCE, _STATUS, """h0 AS (
SELECT CASE WHEN kept THEN 'kept' ELSE 'removed' END AS status, duration_sec FROM status
WHERE connected AND duration_sec IS NOT NULL)""", """rng AS (SELECT status, min(duration_sec) AS lo, max(duration_sec) AS hi
FROM h0 GROUP BY status)""", """h1 AS (
SELECT status, lo, hi, CAST(CASE WHEN hi > lo THEN least(CAST(floor(50 * (duration_sec - lo) / (hi - lo)) AS BIGINT) + 1, 50)
  ELSE 1 END AS INTEGER) AS bin FROM h0 JOIN rng USING (status))"""], """
SELECT status, bin, lo + (bin - 1) * ((hi - lo) / 50) AS bin_lo, lo + bin * ((hi - lo) / 50) AS bin_hi, count(*) AS n
FROM h1 GROUP BY status, bin, lo, hi"""), "A40")
def duration_histogram(spark, sf):
    df, fence = _status_df(spark, sf)
    return EL.duration_histogram(df, fence)


@register("distinct_campaign_types", O.with_stage("prepared", [], """
SELECT DISTINCT campaign_type FROM prepared ORDER BY campaign_type"""), "A41 O7")
def distinct_campaign_types(spark, sf):
    return distinct_sorted(table(spark, sf), "campaign_type")
