"""Text expressions: stripping, word splitting, bigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank at the ends of a line, and what separates words in ROUGE.
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
ROUGE_SEPARATOR = "[^a-z0-9]+"
START_MARK = "<s>"


def is_filled(value: Column) -> Column:
    """Not null and at least one character long; blanks count as characters."""
    return value.isNotNull() & (F.length(value.cast("string")) > 0)


def strip_text(value: Column) -> Column:
    """Unicode strip; ``trim`` would only take spaces."""
    return F.regexp_replace(value, STRIP_PATTERN, "")


def words(text: Column, at_most: int | None = None) -> Column:
    """Whitespace words without empties.

    With ``at_most`` the split stops early: a text has at most one empty piece in front, so ``at_most + 2`` pieces
    hold the first ``at_most`` words and the unsplit rest.
    """
    if at_most is None:
        return F.array_remove(F.split(text, r"\s+"), "")
    return F.slice(F.array_remove(F.split(text, r"\s+", at_most + 2), ""), 1, at_most)


def rouge_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), ROUGE_SEPARATOR), "")


def bigrams(tokens: Column) -> Column:
    """``(prev, token)`` for every token, the first one after the start mark, and one with a null token at the end.

    Takes a column, not an expression: it is used twice.
    """
    return F.arrays_zip(F.concat(F.array(F.lit(START_MARK)), tokens).alias("prev"), tokens.alias("token"))
