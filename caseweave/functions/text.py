"""Text helpers used by datasets and grading."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A number in free text, and phrases of an answer that gives none.
NUMBER_PATTERN = r"-?\d+\.?\d*"
REFUSAL_PHRASES = [
    "failed", "error", "incorrect", "may not be correct",
    "i will", "i'll", "let me", "please provide",
    "i'm ready", "i can help",
]


def as_column(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def squeeze(text: str | Column) -> Column:
    """Runs of white space become one blank; none is left at either end."""
    return F.trim(F.regexp_replace(as_column(text), r"\s+", " "))


def numbers_in(text: str | Column) -> Column:
    """All numbers of a text as doubles, thousands separators removed first."""
    found = F.regexp_extract_all(F.replace(as_column(text), F.lit(",")), F.lit(NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda n: n.cast("double"))


def refuses(text: str | Column) -> Column:
    """True when the text contains a refusal or error phrase, in any case."""
    lowered = F.lower(as_column(text))
    hit = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


def sql_literal(value: str | Column) -> Column:
    """A string value as Spark SQL text writes it: quoted, backslashes and inner quotes doubled."""
    doubled = F.replace(as_column(value), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(doubled, F.lit("'"), F.lit("''")), F.lit("'"))
