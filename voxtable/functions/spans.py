"""Column helpers for intervals on the time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_sec(a_start, a_end, b_start, b_end) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(
        F.lit(0.0), F.least(c(a_end), c(b_end)) - F.greatest(c(a_start), c(b_start))
    )


def midpoint(start="start_sec", end="end_sec") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.lit(0.5) * (c(start) + c(end))


def word_count(text="text") -> Column:
    from .text import words

    return F.size(words(text))


def turn_duration(turns: DataFrame) -> Column:
    """Length of a turn; without usable times a quarter second per word, at least one word."""
    by_words = (
        F.greatest(word_count("text"), F.lit(1)) / F.lit(4.0)
        if "text" in turns.columns
        else F.lit(0.0)
    )
    timed = F.col("end_sec") > F.col("start_sec")
    return F.when(timed, F.col("end_sec") - F.col("start_sec")).otherwise(by_words)
