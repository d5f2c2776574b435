"""Text to tokens, and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"\s+"
NOT_WORD = r"[^\p{L}\p{N}]+"

QUERY_SLOT = "[QUERY]"


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased tokens between whitespace."""
    return F.array_remove(F.split(F.lower(text), WHITESPACE), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def spaced(text: Column) -> Column:
    """Text with single spaces, one of them on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, WHITESPACE, " ")), F.lit(" "))


def fill_prompt(template: Column, text: Column) -> Column:
    """Every literal slot replaced by the text; neither side is read as a pattern."""
    return F.replace(template, F.lit(QUERY_SLOT), text)
