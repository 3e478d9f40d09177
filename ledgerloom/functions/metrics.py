"""Metrics and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import squeeze


def character_error_rate(predicted: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; may pass 1. An empty truth: 1 if anything is predicted, else 0."""
    return F.when(F.length(truth) == 0, F.when(F.length(predicted) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.levenshtein(predicted, truth) / F.length(truth))


def word_error_rate(predicted: Column, truth: Column) -> Column:
    """The character error rate of lower-cased texts with single spaces (its name notwithstanding)."""
    return character_error_rate(squeeze(F.lower(predicted)), squeeze(F.lower(truth)))


def money(c: Column) -> Column:
    """Whole amounts, halves to even."""
    return F.bround(c, 0).cast("long")


def rounded(c: Column, digits: int = 4) -> Column:
    return F.bround(c, digits)


def price_is_near(price: Column, expected: Column, within: float = 0.15) -> Column:
    return F.coalesce((expected > 0) & (F.abs(price - expected) / F.nullif(expected, F.lit(0)) < within), F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1), to four places."""
    return rounded(part / F.greatest(whole, F.lit(1)))
