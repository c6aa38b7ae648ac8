"""Expressions over sequences stored as array<array<double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import INF


def mean_squared_error(actual: Column, rebuilt: Column) -> Column:
    """Mean squared difference over every cell of two equally shaped sequences."""
    a, b = F.flatten(actual), F.flatten(rebuilt)
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), F.size(a))


def mean_absolute_error(actual: Column, rebuilt: Column) -> Column:
    a, b = F.flatten(actual), F.flatten(rebuilt)
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v), F.size(a))


def rebuild_by_mean(sequence: Column) -> Column:
    """The simplest reconstruction: every row becomes the sequence's mean row."""
    first = F.get(sequence, F.lit(0))
    total = F.aggregate(
        sequence,
        F.transform(first, lambda _: F.lit(0.0)),
        lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y),
    )
    mean = F.transform(total, lambda v: v / F.size(sequence))
    return F.transform(sequence, lambda _: mean)


def all_finite(sequence: Column) -> Column:
    """True when no cell is NULL, NaN or infinite (a NULL row counts as not finite)."""
    no_null_row = ~F.exists(sequence, lambda row: row.isNull())
    cells = F.forall(
        F.flatten(sequence), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF)
    )
    return F.coalesce(no_null_row & cells, F.lit(False))


def last_items(items: Column, n: int) -> Column:
    """The last ``n`` items, or all of them (``slice`` alone is empty on short arrays)."""
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))
