"""Registered queries: transcripts and free text of the given tables, with a lexicon that matches them.

``conversations`` becomes transcript lines turn by turn (``User:`` and ``Agent:`` before every
line), so no conversation is ever gathered into one row: scores are summed per conversation,
and repeated agent lines are counted by (conversation, line).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.text import normalize_text, speaker_lines
from ringlens.operators.sentiment import Lexicon, analyze_sentiment, sentiment_agreement
from ringlens.plans import oracle_sql as O
from ringlens.plans.registry import register
from ringlens.sources.calls import read_table

# parameters: frequent words of the invented prose; they carry no sentiment, they make every rule of the scorer apply
FREQUENT_WORDS = (("with", "for", "from", "la", "avec", "die"), ("was", "but", "not", "der", "les", "en"), ("of the", "en la"), ("in the", "de les"))
FREQUENT = Lexicon(*FREQUENT_WORDS)

_SPEAKER = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Agent' ELSE 'Note' END"
_LINES = f"turns AS (SELECT conv_id, turn, role, concat({_SPEAKER}, ': ', replace(coalesce(text, ''), chr(10), concat(chr(10), {_SPEAKER}, ': '))) AS transcript_text FROM conversations)"
_TURNS = _LINES + ",\n" + O.score_ctes("turns", "array_to_string(" + O.speaker_lines("transcript_text", "User") + ", ' ')", "st", FREQUENT_WORDS)


def turn_lines(spark, sf):
    """(conv_id, turn, role, transcript_text): every line of a turn with its speaker before it."""
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr(
        f"concat({_SPEAKER}, ': ', replace(coalesce(text, ''), '\\n', concat('\\n', {_SPEAKER}, ': ')))").alias("transcript_text"))


def scored_turns(spark, sf):
    return analyze_sentiment(turn_lines(spark, sf), lexicon=FREQUENT, keep_score=True)


@register("turn_sentiment", f"WITH {_TURNS} SELECT conv_id, turn, role, user_text, sentiment_score, sentiment_own FROM st", "P15 X1-X6")
def turn_sentiment(spark, sf):
    return scored_turns(spark, sf).select("conv_id", "turn", "role", "user_text", "sentiment_score", "sentiment_own")


@register("conversation_sentiment", f"""WITH {_TURNS}
SELECT conv_id, count(*) AS n_user_turns, sum(sentiment_score) AS score,
  count(*) FILTER (WHERE sentiment_own = 'positivo') AS n_positive, count(*) FILTER (WHERE sentiment_own = 'negativo') AS n_negative
FROM st WHERE role = 'user' GROUP BY conv_id""", "X1-X6")
def conversation_sentiment(spark, sf):
    return scored_turns(spark, sf).where("role = 'user'").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_user_turns"), F.sum("sentiment_score").alias("score"),
        F.count_if(F.col("sentiment_own") == "positivo").alias("n_positive"), F.count_if(F.col("sentiment_own") == "negativo").alias("n_negative"))


@register("conversation_repeats", f"""WITH {_LINES}, spoken AS (
SELECT conv_id, {O.normalize_text('line')} AS line FROM (
  SELECT conv_id, unnest({O.speaker_lines('transcript_text', 'Agent')}) AS line FROM turns) WHERE length(line) > {K.REPEAT_MIN_CHARS}),
counted AS (SELECT conv_id, line, count(*) AS n FROM spoken GROUP BY conv_id, line)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_distinct, max(n) > 1 AS fail_repetitive FROM counted GROUP BY conv_id""", "G1 P15")
def conversation_repeats(spark, sf):
    lines = turn_lines(spark, sf).select("conv_id", F.explode(speaker_lines("transcript_text", "Agent")).alias("line"))
    counted = lines.where(F.length("line") > K.REPEAT_MIN_CHARS).groupBy("conv_id", normalize_text("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("conv_id").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"), (F.max("n") > 1).alias("fail_repetitive"))


_DOCS = O.score_ctes("documents", "coalesce(text, '')", "ds", FREQUENT_WORDS)
_QUALITY = "CASE quality WHEN 1 THEN 'positivo' WHEN 0 THEN 'negativo' END"


def scored_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return analyze_sentiment(docs, text_col="text", lexicon=FREQUENT, keep_score=True, user_lines=False)


@register("document_frequent_words", f"WITH {_DOCS} SELECT doc_id, lang, sentiment_score, sentiment_own FROM ds", "X2-X6 P13 P14")
def document_frequent_words(spark, sf):
    return scored_documents(spark, sf).select("doc_id", "lang", "sentiment_score", "sentiment_own")


@register("document_label_agreement", f"""WITH {_DOCS}
SELECT lang, count(*) AS n_overlap, CAST(sum(CASE WHEN sentiment_own = recorded THEN 1 ELSE 0 END) AS BIGINT) AS n_match,
  sum(CASE WHEN sentiment_own = recorded THEN 1 ELSE 0 END) / count(*) AS match_rate
FROM (SELECT ds.*, {_QUALITY} AS recorded FROM ds JOIN labels USING (doc_id)) WHERE recorded IS NOT NULL GROUP BY lang""", "A15")
def document_label_agreement(spark, sf):
    known = read_table(spark, sf, "labels").select("doc_id", F.expr(_QUALITY).alias("recorded"))
    return sentiment_agreement(scored_documents(spark, sf).join(known, "doc_id"), ["lang"], recorded="recorded")
