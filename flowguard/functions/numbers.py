"""Scalar expressions. SQL NULL is the only "missing" value inside the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")

# What an infinity becomes before scoring, the scaled range kept,
# the error range kept, and the threshold used when a saved one is unusable.
SCORING_LIMIT = 1e6
SCALED_LIMIT = 5.0
ERROR_RANGE = (1e-10, 1e6)
DEFAULT_THRESHOLD = 0.01

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_NOT_A_NUMBER = r"(?i)^[+-]?nan$"


def missing_if_not_finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == INF), F.lit(None)).otherwise(value)


def sanitise(value: Column, limit: float = SCORING_LIMIT) -> Column:
    """NaN and NULL become 0, infinities become plus or minus ``limit``."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(0.0))
        .when(value == INF, F.lit(limit))
        .when(value == -INF, F.lit(-limit))
        .otherwise(value)
    )


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Limit to [low, high]; NULL and NaN pass through (``greatest`` alone would skip NULL)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value < low, low).when(~F.isnan(value) & (value > high), high).otherwise(value)


def clip_error(value: Column) -> Column:
    return clip(value, *ERROR_RANGE)


def parse_number(text: Column) -> Column:
    """Text to double under Python's ``float`` rules; NULL when the text is not a number.

    Spark's own cast also takes Java suffixes (``1d``), which are refused here,
    and refuses digit-group underscores, which are accepted here.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(t.rlike(_NUMBER) | t.rlike(_INFINITE), t.try_cast("double")).when(
        t.rlike(_NOT_A_NUMBER), F.lit(NAN)
    )


def usable_threshold(value: Column) -> Column:
    """A threshold that is missing, NaN or not positive is replaced by the default."""
    bad = value.isNull() | F.isnan(value) | (value <= 0)
    return F.when(bad, F.lit(DEFAULT_THRESHOLD)).otherwise(value)
