"""Lexicon sentiment of the caller (X1-X6), as column expressions.

Score of the user's text (user lines joined by a space, then normalised):
  +2 for each positive phrase contained (substring, each phrase once),
  -2 for each negative phrase contained,
  +1 / -1 for each *distinct* whitespace token found in the word lists;
  text shorter than 3 characters scores 0.
Label: text shorter than 5 characters -> neutral; score >= 1 positivo;
score <= -1 negativo; otherwise neutral.

The lexicon is a parameter (``Lexicon``); the default is the Spanish
customer-care lexicon in ``constants``. Token matching filters the distinct tokens by
``isin``, phrase matching is ``contains``; no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens import constants as K
from ringlens.functions.text import WS_RUN, normalize_text, user_text, ustrip


@dataclass(frozen=True)
class Lexicon:
    positive_words: tuple = field(default_factory=lambda: tuple(K.POSITIVE_WORDS))
    negative_words: tuple = field(default_factory=lambda: tuple(K.NEGATIVE_WORDS))
    positive_phrases: tuple = field(default_factory=lambda: tuple(K.POSITIVE_PHRASES))
    negative_phrases: tuple = field(default_factory=lambda: tuple(K.NEGATIVE_PHRASES))
    phrase_weight: int = K.PHRASE_WEIGHT
    word_weight: int = K.WORD_WEIGHT


DEFAULT_LEXICON = Lexicon()


def _phrase_points(norm: Column, phrases, weight: int) -> Column:
    if not phrases:
        return F.lit(0)
    terms = [F.when(norm.contains(p), F.lit(weight)).otherwise(F.lit(0)) for p in phrases]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _word_points(tokens: Column, words, weight: int) -> Column:
    if not words:
        return F.lit(0)
    # the list is hashed once for the plan, not once for every row
    return F.size(F.filter(tokens, lambda t: t.isin(list(dict.fromkeys(words))))) * F.lit(weight)


def _score_from(text: Column, norm: Column, tokens: Column, lexicon: Lexicon) -> Column:
    pos = _phrase_points(norm, lexicon.positive_phrases, lexicon.phrase_weight) + _word_points(
        tokens, lexicon.positive_words, lexicon.word_weight)
    neg = _phrase_points(norm, lexicon.negative_phrases, lexicon.phrase_weight) + _word_points(
        tokens, lexicon.negative_words, lexicon.word_weight)
    short = F.coalesce(F.length(ustrip(text)), F.lit(0)) < K.MIN_SCORE_CHARS
    return F.when(short, F.lit(0.0)).otherwise((pos - neg).cast("double"))


def _tokens(norm: Column) -> Column:
    return F.array_distinct(F.split(norm, WS_RUN))


def sentiment_score(text: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Numeric score of an already extracted user text, as one expression.

    Convenient for small inputs; ``analyze_sentiment`` materialises the
    normalised text and token set once per row instead of once per phrase.
    """
    norm = normalize_text(text)
    return _score_from(text, norm, _tokens(norm), lexicon)


def sentiment_label(score: Column, text: Column) -> Column:
    short = F.coalesce(F.length(ustrip(text)), F.lit(0)) < K.MIN_LABEL_CHARS
    return (
        F.when(short, F.lit("neutral"))
        .when(score >= K.POSITIVE_CUTOFF, F.lit("positivo"))
        .when(score <= K.NEGATIVE_CUTOFF, F.lit("negativo"))
        .otherwise(F.lit("neutral"))
    )


def analyze_sentiment(df: DataFrame, text_col: str = "transcript_text", lexicon: Lexicon = DEFAULT_LEXICON,
                      strict_nulls: bool = False, keep_score: bool = False, user_lines: bool = True) -> DataFrame:
    """Add ``sentiment_own`` (and optionally ``sentiment_score``, ``user_text``).

    The user text, its normalised form and its token set are separate
    projections: each is referenced many times by the phrase and word terms,
    so Catalyst keeps them as columns (evaluated once per row) instead of
    inlining a copy into every term.

    A call without transcript is ``neutral`` (no user text, no signal); with
    ``strict_nulls=True`` it is null instead. ``user_lines=False`` scores the
    whole text (documents, free text) instead of the ``User:`` lines.
    """
    src = user_text(text_col) if user_lines else F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_user_text", src)
    df = df.withColumn("_norm", normalize_text(F.col("_user_text")))
    df = df.withColumn("_tokens", _tokens(F.col("_norm")))
    df = df.withColumn("_score", _score_from(F.col("_user_text"), F.col("_norm"), F.col("_tokens"), lexicon))
    df = df.withColumn("sentiment_own", sentiment_label(F.col("_score"), F.col("_user_text")))
    if strict_nulls:
        df = df.withColumn("sentiment_own",
                           F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).otherwise(F.col("sentiment_own")))
    df = df.drop("_norm", "_tokens")
    if keep_score:
        return df.withColumnsRenamed({"_score": "sentiment_score", "_user_text": "user_text"})
    return df.drop("_score", "_user_text")


def sentiment_agreement(df: DataFrame, by: list[str] | None = None, own: str = "sentiment_own",
                        recorded: str = "pca_sentimiento") -> DataFrame:
    """Share of rows whose own label equals the recorded one, over rows with a recorded label."""
    base = df.filter(F.col(recorded).isNotNull())
    agg = [
        F.count(F.lit(1)).alias("n_overlap"),
        F.sum(F.when(F.col(own) == F.col(recorded), 1).otherwise(0)).alias("n_match"),
    ]
    out = base.groupBy(*(by or [])).agg(*agg)
    return out.withColumn("match_rate", F.col("n_match") / F.col("n_overlap"))
