"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each oracle query is a chain of CTEs that mirrors a Spark stage:
``calls`` (call log over ``events``) -> ``prepared`` (cleaning columns) ->
``scored`` (sentiment) -> ``flagged`` (agent failures) -> report query.
The SQL is written independently of the Spark code: explicit character
classes stand in for Java's Unicode ``\\w``/``\\s`` and ranks are taken with
window functions.
"""

from __future__ import annotations

from ringlens import constants as K


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


_WS_SQL = " || ".join(f"chr({ord(c)})" for c in K.WHITESPACE)


def ustrip(x: str) -> str:
    return f"trim({x}, {_WS_SQL})"


def fold(x: str) -> str:
    return f"translate({x}, {q(K.ACCENTS_FROM)}, {q(K.ACCENTS_TO)})"


_WS_RE = "".join(f"\\x{{{ord(c):04X}}}" for c in K.WHITESPACE)


def normalize_text(x: str) -> str:
    return ustrip(f"regexp_replace({fold(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_{_WS_RE}]', ' ', 'g')")


def normalize_category(x: str) -> str:
    return f"nullif(replace({fold(f'lower({ustrip(x)})')}, ' ', '_'), '')"


def speaker_lines(x: str, speaker: str) -> str:
    prefix = f"{speaker}:"
    lines = f"list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: {ustrip('l')})"
    kept = f"list_filter({lines}, lambda l: starts_with(l, {q(prefix)}))"
    return f"list_transform({kept}, lambda l: {ustrip(f'substr(l, {len(prefix) + 1})')})"


def case_map(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {x} = {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def campaign_type(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), {q(p)}) THEN {q(lbl)}" for p, lbl in K.CAMPAIGN_PATTERNS)
    return f"CASE {whens} ELSE {q(K.CAMPAIGN_OTHER)} END"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in dict.fromkeys(values)) + "]"


def _phrases(norm: str, phrases) -> str:
    return "0" if not phrases else " + ".join(f"(CASE WHEN contains({norm}, {q(p)}) THEN {K.PHRASE_WEIGHT} ELSE 0 END)" for p in phrases)


def _words(norm: str, words) -> str:
    return f"len(list_intersect(list_distinct(string_split_regex({norm}, '[{_WS_RE}]+')), {_list(words)}))"


# ---------------------------------------------------------------------------
# CTE fragments
# ---------------------------------------------------------------------------

CALLS = """calls AS (
SELECT event_id AS call_id,
  CAST(user_id % 37 AS VARCHAR) AS campaign_id,
  CASE event_id % 10 WHEN 0 THEN 'Early Churn Julio' WHEN 1 THEN 'Posibles churn' WHEN 2 THEN 'Upsell TV digital'
    WHEN 3 THEN 'Sales Q1' WHEN 4 THEN 'Cliente 2do pago' WHEN 5 THEN 'Aviso corte' WHEN 6 THEN ' Servicio al Cliente '
    WHEN 7 THEN 'Promo RELÁMPAGO' WHEN 8 THEN 'prueba' ELSE 'Varios' END AS name,
  user_id AS target_id,
  CASE WHEN event_type <> 'error' THEN concat('call://', CAST(event_id AS VARCHAR)) END AS call_url,
  event_type IN ('purchase', 'click', 'signup') AS connected,
  CASE event_type WHEN 'purchase' THEN ' User_Hangup' WHEN 'click' THEN 'agent_hangup'
    WHEN 'signup' THEN 'inactivity' WHEN 'view' THEN 'voicemail_reached' END AS disconnected_reason,
  CASE WHEN event_type <> 'error' THEN value * 1000 END AS duration_ms,
  CASE WHEN event_type <> 'error' THEN CASE (event_id + user_id) % 8
    WHEN 0 THEN '["Agent: Hola, le llamo por su servicio","User: No me interesa"]'
    WHEN 1 THEN '["Agent: Hola, le llamo por su servicio","User: Sí, me interesa","Agent: Hola, le llamo por su servicio!"]'
    WHEN 2 THEN '["Agent: ¿Desea recargar hoy?","User: Muchas gracias, todo bien"]'
    WHEN 3 THEN '["User: pésimo servicio, quiero cancelar","Agent: Entiendo"]'
    WHEN 4 THEN '["Agent: ¿Sigue ahí?"]'
    WHEN 5 THEN '[]'
    WHEN 6 THEN '["User: ok","Agent: Gracias"]'
    ELSE '["Agent: Buenas tardes","User: la casa es azul","user: excelente"]' END END AS transcript,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 4
    WHEN 0 THEN '{"sentimiento":"negativo","razon_churn":" No supo recargar ","posible_recuperacion":"No"}'
    WHEN 1 THEN '{"sentimiento":"neutral","razon_churn":"otro","posible_recuperacion":""}'
    WHEN 2 THEN '{"sentimiento":"positivo","razon_churn":"","posible_recuperacion":"Sí"}'
    ELSE '{"sentimiento":"","razon_churn":"Mudanza"}' END END AS post_call_analysis,
  ts AS executed_at,
  coalesce(event_type <> 'error', false) AS call_completed
FROM events)"""


def _pca(field: str) -> str:
    return f"nullif(json_extract_string(post_call_analysis, {q('$.' + field)}), '')"


_DAYS = "[" + ", ".join(q(d) for d in K.DAY_LABELS) + "]"
_CHURN = normalize_category(_pca("razon_churn"))

PREPARED = f"""prepared0 AS (
SELECT call_id, CAST(campaign_id AS VARCHAR) AS campaign_id, {ustrip('name')} AS name, target_id, call_url, connected,
  coalesce(lower({ustrip('disconnected_reason')}), 'unknown') AS disconnected_reason,
  CAST(duration_ms AS DOUBLE) AS duration_ms, transcript, post_call_analysis, executed_at, call_completed,
  CAST(hour(executed_at) AS INTEGER) AS hour,
  CAST(day(executed_at) AS INTEGER) AS day_of_month,
  strftime(executed_at, '%d/%m/%Y') AS date,
  {_DAYS}[isodow(executed_at)] AS day_of_week,
  CAST(duration_ms AS DOUBLE) / 1000.0 AS duration_sec,
  {_pca('resumen')} AS pca_resumen,
  {_pca('sentimiento')} AS pca_sentimiento,
  {case_map(_CHURN, K.CHURN_ALIASES, _CHURN)} AS pca_razon_churn,
  {normalize_category(_pca('posible_recuperacion'))} AS pca_posible_recuperacion,
  {_pca('no_recarga')} AS pca_no_recarga,
  {_pca('dificultad_tecnica')} AS pca_dificultad_tecnica,
  {ustrip("array_to_string(from_json(transcript, '[\"VARCHAR\"]'), chr(10))")} AS transcript_text,
  coalesce(connected, false) <> call_completed AS inconsistency_flag
FROM calls),
prepared AS (
SELECT *, CAST(length(transcript_text) AS INTEGER) AS transcript_length, {campaign_type('name')} AS campaign_type
FROM prepared0)"""

DEFAULT_WORDS = (K.POSITIVE_WORDS, K.NEGATIVE_WORDS, K.POSITIVE_PHRASES, K.NEGATIVE_PHRASES)


def score_ctes(src: str, text_expr: str, out: str, lexicon=DEFAULT_WORDS) -> str:
    """CTEs adding ``user_text``, ``sentiment_score``, ``sentiment_own`` to ``src`` (result CTE ``out``)."""
    good_words, bad_words, good_phrases, bad_phrases = lexicon
    norm = normalize_text("user_text")
    return f"""{out}0 AS (
SELECT *, {text_expr} AS user_text FROM {src}),
{out}1 AS (
SELECT *, {norm} AS _norm FROM {out}0),
{out}2 AS (
SELECT *,
  CASE WHEN coalesce(length({ustrip('user_text')}), 0) < {K.MIN_SCORE_CHARS} THEN 0.0
  ELSE CAST(({_phrases('_norm', good_phrases)} + {_words('_norm', good_words)})
          - ({_phrases('_norm', bad_phrases)} + {_words('_norm', bad_words)}) AS DOUBLE) END AS sentiment_score
FROM {out}1),
{out} AS (
SELECT * EXCLUDE (_norm),
  CASE WHEN coalesce(length({ustrip('user_text')}), 0) < {K.MIN_LABEL_CHARS} THEN 'neutral'
       WHEN sentiment_score >= {K.POSITIVE_CUTOFF} THEN 'positivo'
       WHEN sentiment_score <= {K.NEGATIVE_CUTOFF} THEN 'negativo' ELSE 'neutral' END AS sentiment_own
FROM {out}2)"""


_UT = "array_to_string(" + speaker_lines("transcript_text", "User") + ", ' ')"
SCORED = score_ctes("prepared", _UT, "scored")

_AGENT_LONG = f"list_transform(list_filter({speaker_lines('transcript_text', 'Agent')}, lambda l: length(l) > {K.REPEAT_MIN_CHARS}), lambda l: {normalize_text('l')})"

FLAGGED = f"""flagged0 AS (
SELECT *, {_AGENT_LONG} AS _agent, coalesce(connected, false) AS _conn FROM scored),
flagged AS (
SELECT * EXCLUDE (_agent, _conn),
  CASE WHEN _conn THEN len(_agent) > len(list_distinct(_agent)) ELSE false END AS fail_repetitive,
  CASE WHEN _conn THEN disconnected_reason = 'inactivity' ELSE false END AS fail_inactivity,
  CASE WHEN _conn THEN pca_razon_churn IS NOT NULL AND sentiment_own = 'negativo'
    AND (pca_posible_recuperacion IS NULL OR lower(pca_posible_recuperacion) IN ('no')) ELSE false END AS fail_objection,
  CASE WHEN _conn THEN coalesce(duration_sec, 0.0) < {K.SHORT_CALL_SEC}
    AND disconnected_reason = 'user_hangup' AND sentiment_own = 'negativo' ELSE false END AS fail_misunderstanding,
  CASE WHEN _conn THEN disconnected_reason = 'agent_hangup' ELSE false END AS fail_agent_hangup
FROM flagged0)"""

STAGES = {"calls": [CALLS], "prepared": [CALLS, PREPARED], "scored": [CALLS, PREPARED, SCORED],
          "flagged": [CALLS, PREPARED, SCORED, FLAGGED]}


def nearest_q(table: str, col: str, qv: float, where: str = "TRUE") -> str:
    """Scalar subquery: nearest-rank quantile (0-based rank floor((n-1)q + 0.5))."""
    return f"""(SELECT v FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rk, count(*) OVER () AS n
  FROM {table} WHERE {col} IS NOT NULL AND ({where})) WHERE rk = CAST(floor((n - 1) * {qv!r} + 0.5) AS BIGINT))"""


def with_stage(stage: str, extra_ctes: list[str], select: str) -> str:
    ctes = STAGES[stage] + extra_ctes
    return "WITH " + ",\n".join(ctes) + "\n" + select


def r9(x: str) -> str:
    return f"round({x}, 9)"
