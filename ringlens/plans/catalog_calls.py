"""Registered queries: cleaning, sentiment, failures, contactability, sentiment reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.operators import contact, failures
from ringlens.operators.clean import filter_funnel, filter_outliers
from ringlens.operators.reports import (
    duration_by_sentiment,
    sentiment_pivot,
    top_hours_for,
    value_counts,
)
from ringlens.functions.text import truncate, user_text
from ringlens.operators.features import SAMPLE_BASE, SAMPLE_PRIME, hash_sample_per_group, labelled_samples
from ringlens.operators.sentiment import analyze_sentiment, sentiment_agreement
from ringlens.operators.clean import prepare_calls
from ringlens.session import ensure_checkpoint_dir
from ringlens.sources.calls import raw_text_from_events, read_table, typed_calls
from ringlens.sources.csv_records import read_csv
from ringlens.sources.sinks import write_table
from ringlens.plans import oracle_sql as O
from ringlens.plans.registry import register
from ringlens.plans.stages import flagged, limits, prepared, r9, scored, table, with_outliers

_SUN = ", ".join(O.q(d) for d in K.DOW_ORDER_SUNDAY_FIRST)
_CONN_SUM = "CAST(coalesce(sum(CAST(connected AS INTEGER)), 0) AS BIGINT)"


# ---------------------------------------------------------------------------
# cleaning (P1-P12, S4, P18, F1-F4)
# ---------------------------------------------------------------------------

_CLEAN_COLS = [
    "call_id", "campaign_id", "name", "target_id", "call_url", "connected", "disconnected_reason",
    "duration_ms", "executed_at", "call_completed", "hour", "day_of_month", "date", "day_of_week",
    "duration_sec", "duration_outlier", "pca_resumen", "pca_sentimiento", "pca_razon_churn",
    "pca_posible_recuperacion", "pca_no_recarga", "pca_dificultad_tecnica", "transcript_text",
    "transcript_length", "inconsistency_flag", "campaign_type",
]


@register("clean_rows", O.with_stage("prepared", [], f"""
SELECT {', '.join(c for c in _CLEAN_COLS if c != 'duration_outlier')},
  coalesce(duration_ms > {O.nearest_q('prepared', 'duration_ms', K.P99_QUANTILE)}, false) AS duration_outlier
FROM prepared"""), "S1 S3 S4 P1-P12 P18 A20")
def clean_rows(spark, sf):
    return with_outliers(prepared(spark, sf), spark, sf).select(*_CLEAN_COLS)


_PRE = f"hour <> 0 AND campaign_type <> '{K.TEST_CAMPAIGN}'"
_FENCE = f"""fence AS (
SELECT q1 - {K.IQR_MULTIPLIER} * (q3 - q1) AS lo, q3 + {K.IQR_MULTIPLIER} * (q3 - q1) AS hi FROM (
  SELECT {O.nearest_q('prepared', 'duration_sec', 0.25, _PRE)} AS q1,
         {O.nearest_q('prepared', 'duration_sec', 0.75, _PRE)} AS q3))"""


@register("clean_kept", O.with_stage("prepared", [_FENCE], f"""
SELECT call_id, hour, campaign_type, duration_sec
FROM prepared, fence WHERE {_PRE} AND duration_sec BETWEEN fence.lo AND fence.hi"""), "F1 F2 F3 A20")
def clean_kept(spark, sf):
    return filter_outliers(table(spark, sf), limits(spark, sf)[1]).select("call_id", "hour", "campaign_type",
                                                                            "duration_sec")


@register("filter_funnel", O.with_stage("prepared", [_FENCE], f"""
SELECT step, count(*) AS n FROM (
  SELECT CASE WHEN NOT coalesce(hour <> 0, false) THEN 'hour_0'
              WHEN NOT coalesce(campaign_type <> '{K.TEST_CAMPAIGN}', false) THEN 'campaign_prueba'
              WHEN NOT coalesce(duration_sec BETWEEN fence.lo AND fence.hi, false) THEN 'outlier_duration'
              ELSE 'kept' END AS step
  FROM prepared, fence) GROUP BY step"""), "F4")
def filter_funnel_q(spark, sf):
    return filter_funnel(table(spark, sf), limits(spark, sf)[1])


# ---------------------------------------------------------------------------
# sentiment and failures
# ---------------------------------------------------------------------------

@register("sentiment_rows", O.with_stage("scored", [], """
SELECT call_id, user_text, sentiment_score, sentiment_own FROM scored"""), "P13 P14 P15 X1-X6")
def sentiment_rows(spark, sf):
    return scored(spark, sf, keep_score=True).select("call_id", "user_text", "sentiment_score", "sentiment_own")


@register("document_sentiment", "WITH " + O.score_ctes("documents", "coalesce(text, '')", "ds") + """
SELECT doc_id, lang, sentiment_score, sentiment_own FROM ds""", "X2-X6 P13 P14")
def document_sentiment(spark, sf):
    """The lexicon scorer over whole documents (free text, every word of every document)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    out = analyze_sentiment(docs, text_col="text", keep_score=True, user_lines=False)
    return out.select("doc_id", "lang", "sentiment_score", "sentiment_own")


@register("agent_failures", O.with_stage("flagged", [], f"""
SELECT call_id, {', '.join(K.FAIL_COLUMNS)} FROM flagged"""), "G1-G5")
def agent_failures(spark, sf):
    return table(spark, sf).select("call_id", *K.FAIL_COLUMNS)


_FAIL_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS failure, CAST(coalesce(sum(CAST({c} AS INTEGER)), 0) AS BIGINT) AS n FROM flagged WHERE connected"
    for c in K.FAIL_COLUMNS) + " UNION ALL SELECT 'any_failure', CAST(coalesce(sum(CAST((" + " OR ".join(
    f"coalesce({c}, false)" for c in K.FAIL_COLUMNS) + ") AS INTEGER)), 0) AS BIGINT) FROM flagged WHERE connected"


@register("failure_summary", O.with_stage("flagged", [f"fl AS ({_FAIL_LONG})",
                                                      "nc AS (SELECT count(*) AS n_connected FROM flagged WHERE connected)"],
                                          """
SELECT failure, n, n_connected, n / n_connected AS rate FROM fl, nc"""), "A26 P25")
def failure_summary_q(spark, sf):
    return failures.failure_summary(table(spark, sf))


_RATES = ", ".join(
    f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS n_{c[5:]}, sum(CAST({c} AS INTEGER)) / count(*) AS rate_{c[5:]}"
    for c in K.FAIL_COLUMNS)


@register("failure_rates_by_campaign", O.with_stage("flagged", [], f"""
SELECT campaign_type, count(*) AS n, {_RATES} FROM flagged WHERE connected GROUP BY campaign_type"""), "A27")
def failure_rates_by_campaign(spark, sf):
    return failures.failure_rates_by(table(spark, sf), "campaign_type")


# ---------------------------------------------------------------------------
# contactability
# ---------------------------------------------------------------------------

def _rate_sql(by: str) -> str:
    return O.with_stage("prepared", [], f"""
SELECT {by}, count(*) AS total, {_CONN_SUM} AS connected_count, {_CONN_SUM} / count(*) AS connection_rate
FROM prepared GROUP BY {by}""")


@register("rate_by_hour", _rate_sql("hour"), "A1")
def rate_by_hour(spark, sf):
    return contact.connection_rate(table(spark, sf), "hour")


@register("rate_by_campaign", _rate_sql("campaign_type"), "A1 P18")
def rate_by_campaign(spark, sf):
    return contact.connection_rate(table(spark, sf), "campaign_type")


_SPINE = "spine AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.q(d)}, {i})" for i, d in enumerate(K.DOW_ORDER_SUNDAY_FIRST)) + ") AS t(day_of_week, day_rank))"


@register("rate_by_day", O.with_stage("prepared", [_SPINE, f"""r AS (
SELECT day_of_week, count(*) AS total, {_CONN_SUM} AS connected_count FROM prepared GROUP BY day_of_week)"""], """
SELECT s.day_of_week, CAST(s.day_rank AS INTEGER) AS day_rank, coalesce(r.total, 0) AS total,
  coalesce(r.connected_count, 0) AS connected_count, coalesce(r.connected_count / r.total, 0.0) AS connection_rate
FROM spine s LEFT JOIN r USING (day_of_week)"""), "A2 J6 O10")
def rate_by_day(spark, sf):
    return contact.connection_rate_by_day(table(spark, sf))


def _heat_sql(num: str, where: str = "TRUE", min_total: int = 0, stage: str = "prepared") -> str:
    return O.with_stage(stage, [], f"""
SELECT day_of_week, hour, count(*) AS total, CAST(coalesce(sum({num}), 0) AS BIGINT) AS n,
  coalesce(sum({num}), 0) / count(*) AS val
FROM {stage} WHERE {where} GROUP BY day_of_week, hour HAVING count(*) >= {min_total}""")


@register("heat_connection", _heat_sql("CAST(connected AS INTEGER)"), "A3 A4")
def heat_connection(spark, sf):
    return contact.connection_heat(table(spark, sf))


@register("heat_agent_hangup", _heat_sql("CAST(disconnected_reason = 'agent_hangup' AS INTEGER)", "connected",
                                         K.MIN_HEATMAP_CALLS), "A3 A4 F7")
def heat_agent_hangup(spark, sf):
    return contact.agent_hangup_heat(table(spark, sf))


@register("heat_positive", _heat_sql("CAST(sentiment_own = 'positivo' AS INTEGER)", "connected",
                                     K.MIN_HEATMAP_CALLS, stage="scored"), "A3 A4 F7")
def heat_positive(spark, sf):
    return contact.positive_sentiment_heat(table(spark, sf))


@register("heat_duration", O.with_stage("prepared", [], f"""
SELECT day_of_week, hour, {O.r9('avg(duration_sec)')} AS val FROM prepared WHERE connected GROUP BY day_of_week, hour"""),
          "A5")
def heat_duration(spark, sf):
    return contact.duration_heat(table(spark, sf)).withColumn("val", r9("val"))


@register("heat_grid", O.with_stage("prepared", [f"""cells AS (
SELECT day_of_week, hour, {_CONN_SUM} / count(*) AS val FROM prepared GROUP BY day_of_week, hour)""",
                                                 f"days AS (SELECT unnest([{_SUN}]) AS day_of_week)",
                                                 "hours AS (SELECT DISTINCT hour FROM prepared)"], """
SELECT d.day_of_week, h.hour, coalesce(c.val, 0.0) AS val
FROM days d CROSS JOIN hours h LEFT JOIN cells c ON c.day_of_week = d.day_of_week AND c.hour = h.hour"""), "A6")
def heat_grid(spark, sf):
    df = table(spark, sf)
    return contact.complete_grid(contact.connection_heat(df), df)


def _share_sql(group: str, cat: str, order: list[str]) -> str:
    arr = "[" + ", ".join(O.q(v) for v in order) + "]"
    return O.with_stage("scored", [f"""c AS (
SELECT {group}, {cat}, count(*) AS n FROM scored WHERE connected GROUP BY {group}, {cat})"""], f"""
SELECT {group}, {cat}, n, sum(n) OVER (PARTITION BY {group}) AS total, n / sum(n) OVER (PARTITION BY {group}) AS pct,
  CAST(CASE WHEN list_position({arr}, {cat}) > 0 THEN list_position({arr}, {cat}) ELSE {len(order) + 1} END AS INTEGER)
    AS category_rank
FROM c""")


@register("reason_share_by_day", _share_sql("day_of_week", "disconnected_reason", K.REASON_ORDER), "A7 A8")
def reason_share_by_day(spark, sf):
    return contact.category_share(table(spark, sf), "day_of_week", "disconnected_reason", K.REASON_ORDER)


@register("sentiment_share_by_campaign", _share_sql("campaign_type", "sentiment_own", K.SENTIMENTS), "A7 A8")
def sentiment_share_by_campaign(spark, sf):
    return contact.category_share(table(spark, sf), "campaign_type", "sentiment_own", K.SENTIMENTS)


@register("box_duration_by_day", O.with_stage("prepared", [f"""b AS (
SELECT day_of_week, duration_sec FROM prepared WHERE connected AND duration_sec IS NOT NULL)""", """qs AS (
SELECT day_of_week, count(*) AS n, quantile_cont(duration_sec, 0.25) AS q1, quantile_cont(duration_sec, 0.5) AS median,
  quantile_cont(duration_sec, 0.75) AS q3, min(duration_sec) AS min, max(duration_sec) AS max FROM b GROUP BY day_of_week)""",
                                                          """wh AS (
SELECT b.day_of_week,
  min(CASE WHEN duration_sec BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN duration_sec END) AS whisker_lo,
  max(CASE WHEN duration_sec BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN duration_sec END) AS whisker_hi,
  CAST(sum(CASE WHEN duration_sec BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
    AS n_outliers
FROM b JOIN qs USING (day_of_week) GROUP BY b.day_of_week)"""], f"""
SELECT day_of_week, n, {O.r9('q1')} AS q1, {O.r9('median')} AS median, {O.r9('q3')} AS q3, min, max,
  whisker_lo, whisker_hi, n_outliers
FROM qs JOIN wh USING (day_of_week)"""), "A9")
def box_duration_by_day(spark, sf):
    out = contact.box_stats(table(spark, sf), "day_of_week")
    return out.withColumns({c: r9(c) for c in ["q1", "median", "q3"]})


@register("campaign_order_by_median", O.with_stage("prepared", [f"""m AS (
SELECT campaign_type, coalesce(median(duration_sec), 0.0) AS median FROM prepared WHERE connected GROUP BY campaign_type)"""],
                                                  f"""
SELECT campaign_type, {O.r9('median')} AS median, row_number() OVER (ORDER BY median DESC, campaign_type) AS rank FROM m"""),
          "A10 A20")
def campaign_order_by_median(spark, sf):
    return contact.group_order_by_median(table(spark, sf), "campaign_type").withColumn("median", r9("median"))


_WS = f"""ws0 AS (
SELECT day_of_week, hour, count(*) AS total, {_CONN_SUM} AS n_conn,
  avg(CASE WHEN coalesce(connected, false) THEN duration_sec END) AS dur_mean,
  sum(CAST(coalesce(connected, false) AS INTEGER)) AS n_conn_rows,
  sum(CAST(coalesce(connected, false) AND sentiment_own = 'positivo' AS INTEGER)) AS n_pos
FROM scored GROUP BY day_of_week, hour HAVING count(*) >= {K.MIN_WINDOW_CALLS} AND day_of_week IN ({_SUN})),
ws1 AS (
SELECT day_of_week, hour, total, n_conn, n_conn / total AS conn_rate, coalesce(dur_mean, 0.0) AS dur_mean,
  coalesce(n_pos / CASE WHEN n_conn_rows > 0 THEN n_conn_rows END, 0.0) AS pct_pos FROM ws0),
ws AS (
SELECT *, CASE WHEN max(dur_mean) OVER () > min(dur_mean) OVER ()
  THEN (dur_mean - min(dur_mean) OVER ()) / (max(dur_mean) OVER () - min(dur_mean) OVER ()) ELSE 0.0 END AS dur_norm
FROM ws1)"""


@register("window_score_top10", O.with_stage("scored", [_WS], f"""
SELECT day_of_week, hour, total, n_conn, conn_rate, {O.r9('dur_mean')} AS dur_mean, pct_pos,
  {O.r9('dur_norm')} AS dur_norm, {O.r9('conn_rate * dur_norm * pct_pos')} AS score
FROM ws ORDER BY conn_rate * dur_norm * pct_pos DESC NULLS FIRST, day_of_week, hour LIMIT 10"""), "A11 P27 O2")
def window_score_top10(spark, sf):
    out = contact.window_score(table(spark, sf))
    return out.withColumns({c: r9(c) for c in ["dur_mean", "dur_norm", "score"]})


_TOP = f"""
SELECT day_of_week, hour, count(*) AS total, {_CONN_SUM} AS connected_count, {_CONN_SUM} / count(*) AS connection_rate
FROM prepared GROUP BY day_of_week, hour HAVING count(*) >= {K.MIN_WINDOW_CALLS} AND day_of_week IN ({_SUN})
ORDER BY connection_rate DESC NULLS FIRST, total DESC, day_of_week, hour"""


@register("top_windows", O.with_stage("prepared", [], _TOP + " LIMIT 10"), "A12 F7 O1 O2")
def top_windows(spark, sf):
    return contact.top_windows(table(spark, sf))


@register("best_window", O.with_stage("prepared", [], _TOP + " LIMIT 1"), "A13")
def best_window(spark, sf):
    return contact.top_windows(table(spark, sf), top=1)


# ---------------------------------------------------------------------------
# sentiment reports
# ---------------------------------------------------------------------------

@register("sentiment_counts", O.with_stage("scored", [], """
SELECT sentiment_own, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM scored GROUP BY sentiment_own"""),
          "A14")
def sentiment_counts(spark, sf):
    return value_counts(table(spark, sf), "sentiment_own")


@register("sentiment_agreement", O.with_stage("scored", [], """
SELECT count(*) AS n_overlap, CAST(sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) AS BIGINT) AS n_match,
  sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) / count(*) AS match_rate
FROM scored WHERE pca_sentimiento IS NOT NULL"""), "A15")
def sentiment_agreement_all(spark, sf):
    return sentiment_agreement(table(spark, sf))


@register("sentiment_agreement_by_campaign", O.with_stage("scored", [], """
SELECT campaign_type, count(*) AS n_overlap, CAST(sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) AS BIGINT)
  AS n_match, sum(CASE WHEN sentiment_own = pca_sentimiento THEN 1 ELSE 0 END) / count(*) AS match_rate
FROM scored WHERE pca_sentimiento IS NOT NULL GROUP BY campaign_type"""), "A15")
def sentiment_agreement_by_campaign(spark, sf):
    return sentiment_agreement(table(spark, sf), ["campaign_type"])


@register("sentiment_campaign_pivot", O.with_stage("scored", [], """
SELECT campaign_type,
  CAST(sum(CASE WHEN sentiment_own = 'negativo' THEN 1 ELSE 0 END) AS BIGINT) AS negativo,
  CAST(sum(CASE WHEN sentiment_own = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
  CAST(sum(CASE WHEN sentiment_own = 'positivo' THEN 1 ELSE 0 END) AS BIGINT) AS positivo,
  count(*) AS total, sum(CASE WHEN sentiment_own = 'negativo' THEN 1 ELSE 0 END) / count(*) AS pct_neg
FROM scored WHERE connected GROUP BY campaign_type"""), "A16 O8 J5")
def sentiment_campaign_pivot(spark, sf):
    return sentiment_pivot(table(spark, sf).filter(F.col("connected")), "campaign_type")


@register("duration_by_sentiment", O.with_stage("scored", [], f"""
SELECT sentiment_own, {O.r9('avg(duration_sec)')} AS dur_mean, {O.r9('median(duration_sec)')} AS dur_median,
  count(*) AS n FROM scored WHERE connected GROUP BY sentiment_own"""), "A17")
def duration_by_sentiment_q(spark, sf):
    out = duration_by_sentiment(table(spark, sf))
    return out.withColumns({"dur_mean": r9("dur_mean"), "dur_median": r9("dur_median")})


@register("top_negative_hours", O.with_stage("scored", [], """
SELECT hour, count(*) AS n_negativo FROM scored WHERE connected AND sentiment_own = 'negativo'
GROUP BY hour ORDER BY n_negativo DESC, hour LIMIT 5"""), "A18")
def top_negative_hours(spark, sf):
    df = table(spark, sf)
    return top_hours_for(df.filter(F.col("connected") & (F.col("sentiment_own") == "negativo")), "n_negativo", 5)


# ---------------------------------------------------------------------------
# examples and audit samples (F9, F10, O3-O5, P16, P17, S9): seeded hash samples per group
# ---------------------------------------------------------------------------

def _key_sql(seed: int = 42) -> str:
    m = pow(SAMPLE_BASE, 1000 + seed, SAMPLE_PRIME)
    return f"(((call_id % {SAMPLE_PRIME}) + {SAMPLE_PRIME}) % {SAMPLE_PRIME}) * {m} % {SAMPLE_PRIME}"


def _trunc_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN concat(substr({x}, 1, {n}), '...') ELSE {x} END"


_USER_SAID = _trunc_sql("array_to_string(" + O.speaker_lines("transcript_text", "User") + ", ' | ')", 300)


@register("sentiment_examples", O.with_stage("scored", [], f"""
SELECT sentiment_own, call_id, duration_sec, disconnected_reason, {_USER_SAID} AS user_said FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment_own ORDER BY {_key_sql()}, call_id) AS rn
  FROM scored WHERE connected AND transcript_text IS NOT NULL AND transcript_length > 100) WHERE rn <= 3"""),
          "O4 F9 P16 P17 O3")
def sentiment_examples(spark, sf):
    """Three connected calls per own sentiment with a transcript over 100 chars; user text ' | ' joined, 300 chars."""
    df = scored(spark, sf).filter(F.col("connected") & F.col("transcript_text").isNotNull()
                                  & (F.col("transcript_length") > 100))
    sample = hash_sample_per_group(df, "sentiment_own", 3)
    return sample.select("sentiment_own", "call_id", "duration_sec", "disconnected_reason",
                         truncate(user_text("transcript_text", " | "), 300).alias("user_said"))


@register("failure_examples", O.with_stage("flagged", [], "\nUNION ALL\n".join(f"""
SELECT failure, call_id, duration_sec, disconnected_reason, sentiment_own, {_trunc_sql('transcript_text', 400)} AS transcript
FROM (SELECT '{c}' AS failure, *, row_number() OVER (ORDER BY {_key_sql()}, call_id) AS rn FROM flagged
      WHERE connected AND transcript_text IS NOT NULL AND transcript_length > 50 AND {c}) WHERE rn <= 2"""
                                                                  for c in K.FAIL_COLUMNS)), "O4 F9 P17 O5")
def failure_examples(spark, sf):
    """Two connected calls per failure type with a transcript over 50 chars, transcript cut at 400 chars."""
    df = flagged(spark, sf).filter(F.col("connected") & F.col("transcript_text").isNotNull()
                                   & (F.col("transcript_length") > 50))
    out = labelled_samples(df, [(F.when(F.col(c), F.lit(c)), 2) for c in K.FAIL_COLUMNS], out="failure")
    return out.select("failure", "call_id", "duration_sec", "disconnected_reason", "sentiment_own",
                      truncate("transcript_text", 400).alias("transcript"))


@register("audit_samples", O.with_stage("prepared", [], f"""
SELECT combo AS sample, call_id, campaign_id, name, target_id, call_url, connected, disconnected_reason, post_call_analysis, call_completed FROM (
  SELECT *, row_number() OVER (PARTITION BY combo ORDER BY {_key_sql()}, call_id) AS rn FROM (
    SELECT *, concat_ws('/', CAST(connected AS VARCHAR), CAST(call_completed AS VARCHAR)) AS combo FROM prepared))
WHERE rn <= 5
UNION ALL
SELECT 'differs', call_id, campaign_id, name, target_id, call_url, connected, disconnected_reason, post_call_analysis, call_completed FROM (
  SELECT *, row_number() OVER (ORDER BY {_key_sql()}, call_id) AS rn FROM prepared
  WHERE connected IS DISTINCT FROM call_completed) WHERE rn <= 10
UNION ALL
SELECT 'not_connected', call_id, campaign_id, name, target_id, call_url, connected, disconnected_reason, post_call_analysis, call_completed FROM (
  SELECT *, row_number() OVER (ORDER BY {_key_sql()}, call_id) AS rn FROM prepared WHERE connected = false)
WHERE rn <= 10"""), "F10 O4 O5 S9")
def audit_samples(spark, sf):
    """Up to five rows of each (connected, call_completed) combination, plus ten rows where they differ."""
    cols = ["campaign_id", "name", "target_id", "call_url", "connected", "disconnected_reason", "post_call_analysis",
            "call_completed"]
    combo = F.concat_ws("/", F.col("connected").cast("string"), F.col("call_completed").cast("string"))
    differs = F.when(~F.col("connected").eqNullSafe(F.col("call_completed")), F.lit("differs"))
    not_connected = F.when(F.col("connected") == F.lit(False), F.lit("not_connected"))
    return labelled_samples(prepared(spark, sf), [(combo, 5), (differs, 10), (not_connected, 10)]).select("sample", "call_id", *cols)


# ---------------------------------------------------------------------------
# raw text input
# ---------------------------------------------------------------------------

_TOKEN = "[" + ", ".join(O.q(t) for t in K.NULL_TOKENS) + f"][event_id % {len(K.NULL_TOKENS)} + 1]"
_TOKENS = ", ".join(O.q(t) for t in K.NULL_TOKENS)
_RAW = f"""raw AS (
SELECT call_id AS event_id, coalesce(campaign_id, {_TOKEN}) AS campaign_id, coalesce(call_url, {_TOKEN}) AS call_url,
  CASE call_id % 11 WHEN 3 THEN 'x' || target_id WHEN 4 THEN '00' || target_id
    ELSE coalesce(CAST(target_id AS VARCHAR), {_TOKEN}) END AS target_id,
  CASE call_id % 11 WHEN 2 THEN 'maybe' ELSE coalesce(CAST(connected AS VARCHAR), {_TOKEN}) END AS connected,
  coalesce(disconnected_reason, {_TOKEN}) AS disconnected_reason,
  CASE call_id % 11 WHEN 0 THEN 'n.d.' ELSE coalesce(CAST(CAST(floor(duration_ms) AS BIGINT) AS VARCHAR), {_TOKEN}) END AS duration_ms,
  CASE call_id % 11 WHEN 1 THEN '31/12/2024 25:00'
    ELSE coalesce(strftime(executed_at, '%Y-%m-%d %H:%M:%S.%f'), {_TOKEN}) END AS executed_at
FROM (SELECT *, call_id AS event_id FROM calls)),
known AS (SELECT event_id, {', '.join(f"CASE WHEN {c} NOT IN ({_TOKENS}) THEN {c} END AS {c}" for c in ('campaign_id', 'call_url', 'target_id', 'connected', 'disconnected_reason', 'duration_ms', 'executed_at'))} FROM raw),
typed AS (
SELECT event_id, campaign_id, try_cast(target_id AS BIGINT) AS target_id, try_cast(connected AS BOOLEAN) AS connected,
  call_url IS NOT NULL AS call_completed, coalesce(lower({O.ustrip('disconnected_reason')}), 'unknown') AS disconnected_reason,
  try_cast(duration_ms AS DOUBLE) / 1000.0 AS duration_sec, try_strptime(executed_at, '%Y-%m-%d %H:%M:%S.%f') AS executed_at
FROM known)"""


def _raw_calls(spark, sf):
    return prepare_calls(typed_calls(raw_text_from_events(read_table(spark, sf, "events"))))


@register("raw_text_rows", O.with_stage("calls", [_RAW], """
SELECT *, CAST(hour(executed_at) AS INTEGER) AS hour, coalesce(connected, false) <> call_completed AS inconsistency_flag
FROM typed"""), "S1 S2 S3 S4 P1 P2 N14")
def raw_text_rows(spark, sf):
    return _raw_calls(spark, sf).select("event_id", "campaign_id", "target_id", "connected", "call_completed", "disconnected_reason",
                                        "duration_sec", "executed_at", "hour", "inconsistency_flag")


_EXPORTED = """,
exported AS (SELECT event_id, CASE WHEN transcript IS NOT NULL THEN replace(transcript, '","', '",' || chr(10) || '"') END AS transcript
FROM (SELECT call_id AS event_id, transcript FROM calls))"""


@register("raw_csv_rows", O.with_stage("calls", [_RAW + _EXPORTED], """
SELECT typed.event_id, campaign_id, target_id, connected, call_completed, disconnected_reason, duration_sec, executed_at, transcript,
  1 + len(transcript) - len(replace(transcript, chr(10), '')) AS transcript_lines FROM typed JOIN exported USING (event_id)"""), "S1 S2 S3 S4 S6")
def raw_csv_rows(spark, sf):
    """The raw text table written as CSV with line breaks inside fields, and read back split by split."""
    raw = raw_text_from_events(read_table(spark, sf, "events"))
    raw = raw.withColumn("Transcript", F.replace("Transcript", F.lit('","'), F.lit('",\n"')))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ringlens-tables/{spark.sparkContext.applicationId}/calls-csv-{uuid.uuid4().hex}"
    write_table(raw, path, fmt="csv")
    calls = prepare_calls(typed_calls(read_csv(spark, path, raw.columns)))
    return calls.select(F.col("event_id").cast("long"), "campaign_id", "target_id", "connected", "call_completed", "disconnected_reason", "duration_sec",
                        "executed_at", "transcript", (1 + F.length("transcript") - F.length(F.replace("transcript", F.lit("\n"), F.lit("")))).alias("transcript_lines"))


@register("raw_missing_values", O.with_stage("calls", [_RAW], """
SELECT count(*) AS n, count(*) FILTER (WHERE target_id IS NULL) AS no_target, count(*) FILTER (WHERE connected IS NULL) AS no_flag,
  count(*) FILTER (WHERE duration_sec IS NULL) AS no_duration, count(*) FILTER (WHERE executed_at IS NULL) AS no_time,
  count(*) FILTER (WHERE NOT call_completed) AS no_url FROM typed"""), "S1 S4 N14")
def raw_missing_values(spark, sf):
    missing = {"no_target": "target_id", "no_flag": "connected", "no_duration": "duration_sec", "no_time": "executed_at"}
    return _raw_calls(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(a) for a, c in missing.items()],
                                     F.count_if(~F.col("call_completed")).alias("no_url"))
