"""Text column expressions (no Python UDFs).

All rules are written as built-in Spark expressions so they stay inside
whole-stage codegen and run on executors:

* edge whitespace is the Unicode whitespace set, not only ASCII spaces;
* word characters are Unicode letters/numbers/underscore, so ``señal`` stays one word;
* accent folding covers exactly the characters in ``constants.ACCENTS_FROM``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringlens.constants import ACCENTS_FROM, ACCENTS_TO, WHITESPACE

# explicit classes instead of Java's (?U)\w / (?U)\s, whose Unicode tables
# differ from the rule's (combining marks, connector punctuation, No digits,
# U+001C-U+001F): word = letters, numbers, underscore; space = WHITESPACE
WS_CLASS = "".join(f"\\u{ord(c):04X}" for c in WHITESPACE)
WORD_CLASS = r"\p{L}\p{N}_"
_PUNCT = f"[^{WORD_CLASS}{WS_CLASS}]"
WS_RUN = f"[{WS_CLASS}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """Strip leading/trailing Unicode whitespace.

    Spark's one-argument ``trim`` strips spaces only; ``trim`` with an explicit
    character set strips exactly the whitespace set of ``constants.WHITESPACE``
    without a regex.
    """
    return F.trim(_c(col), F.lit(WHITESPACE))


def fold_accents(col) -> Column:
    """Fold ``áéíóúüñ`` (both cases) to ASCII; every other character is kept."""
    return F.translate(_c(col), ACCENTS_FROM, ACCENTS_TO)


def normalize_text(col) -> Column:
    """Lower, fold accents, every punctuation char -> one space, strip.

    Inner runs of spaces are *not* collapsed: ``'¿Sí, señal_1?'`` becomes
    ``'si  senal_1'``.
    """
    return ustrip(F.regexp_replace(fold_accents(F.lower(_c(col))), _PUNCT, " "))


def speaker_lines(col, speaker: str) -> Column:
    """Lines of one speaker from a newline transcript.

    Split on ``\\n``; each stripped line must start with ``'<speaker>:'``
    (case-sensitive); the rest of the line, stripped, is returned. Lines
    without a prefix (continuations) are dropped. Null text -> empty array.
    """
    prefix = f"{speaker}:"
    n = len(prefix)
    lines = F.transform(F.split(F.coalesce(_c(col), F.lit("")), "\n"), lambda l: ustrip(l))
    kept = F.filter(lines, lambda l: l.startswith(prefix))
    return F.transform(kept, lambda l: ustrip(l.substr(F.lit(n + 1), F.length(l))))


def user_text(col, sep: str = " ") -> Column:
    """User lines joined by ``sep`` (a space for scoring, ``' | '`` for display)."""
    return F.array_join(speaker_lines(col, "User"), sep)


def truncate(col, n: int, suffix: str = "...") -> Column:
    """First ``n`` characters plus ``suffix`` when longer than ``n``."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def normalize_category(col, space_char: str = "_") -> Column:
    """Category value: strip, lower, fold accents, spaces -> ``space_char``; empty -> null."""
    v = F.replace(fold_accents(F.lower(ustrip(_c(col)))), F.lit(" "), F.lit(space_char))
    return F.nullif(v, F.lit(""))
