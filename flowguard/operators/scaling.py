"""Scaling: one aggregate to fit, one projection to apply.

A column without spread is divided by 1, so it scales to 0 (or to the low end of
a min-max range).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import SCALED_LIMIT, clip, sanitise
from ..functions.quantiles import quantiles


@dataclass
class ScaleParams:
    """scaled = (value - centre) / spread, then optionally mapped from [low, high] to a range."""

    columns: list[str]
    centre: list[float]
    spread: list[float]
    low: list[float] | None = None
    high: list[float] | None = None
    target: tuple[float, float] = (-1.0, 1.0)


def _spread_or_one(value: float | None) -> float:
    return value if value else 1.0


def fit_standard(df: DataFrame, columns: Sequence[str]) -> ScaleParams:
    """Mean and population standard deviation."""
    measures = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        measures += [
            F.avg(v).alias(f"a{i}"),
            F.stddev_pop(v).alias(f"s{i}"),
            (F.min(v) == F.max(v)).alias(f"flat{i}"),
        ]
    row = df.agg(*measures).first()
    d = range(len(columns))
    return ScaleParams(
        list(columns),
        [row[f"a{i}"] if row[f"a{i}"] is not None else 0.0 for i in d],
        # Equal extremes settle it: the computed deviation may be a rounding residue.
        [1.0 if row[f"flat{i}"] else _spread_or_one(row[f"s{i}"]) for i in d],
    )


def fit_robust(df: DataFrame, columns: Sequence[str], *, exact: bool = True) -> ScaleParams:
    """Median and interquartile range."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    return ScaleParams(
        list(columns),
        [found[c][1] if found[c][1] is not None else 0.0 for c in columns],
        [_spread_or_one(found[c][2] - found[c][0]) if found[c][1] is not None else 1.0 for c in columns],
    )


def fit_robust_min_max(
    df: DataFrame,
    columns: Sequence[str],
    *,
    target: tuple[float, float] = (-1.0, 1.0),
    exact: bool = True,
) -> ScaleParams:
    """Robust scaling followed by min-max: the scaled extremes are the extremes, scaled."""
    params = fit_robust(df, columns, exact=exact)
    measures = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        measures += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = df.agg(*measures).first()
    d = range(len(columns))
    params.low = [((row[f"l{i}"] or 0.0) - params.centre[i]) / params.spread[i] for i in d]
    params.high = [((row[f"h{i}"] or 0.0) - params.centre[i]) / params.spread[i] for i in d]
    params.target = target
    return params


def fit_min_max(
    df: DataFrame, columns: Sequence[str], *, target: tuple[float, float] = (-1.0, 1.0)
) -> ScaleParams:
    measures = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        measures += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = df.agg(*measures).first()
    d = range(len(columns))
    return ScaleParams(
        list(columns),
        [0.0] * len(columns),
        [1.0] * len(columns),
        [row[f"l{i}"] or 0.0 for i in d],
        [row[f"h{i}"] or 0.0 for i in d],
        target,
    )


def scale_columns(df: DataFrame, params: ScaleParams) -> DataFrame:
    """Replaces each fitted column by its scaled value."""
    return df.withColumns(
        {c: _scaled(F.col(c).cast("double"), params, i) for i, c in enumerate(params.columns)}
    )


def _scaled(value: Column, params: ScaleParams, i: int) -> Column:
    out = (value - F.lit(params.centre[i])) / F.lit(params.spread[i])
    if params.low is not None and params.high is not None:
        to_low, to_high = params.target
        width = _spread_or_one(params.high[i] - params.low[i])
        out = F.lit(to_low) + F.lit(to_high - to_low) * (out - F.lit(params.low[i])) / F.lit(width)
    return out


def scale_features(
    features: Column, params: ScaleParams, *, limit: float | None = SCALED_LIMIT
) -> Column:
    """Scales a feature array for scoring: sanitise, scale, then limit to +-``limit``.

    NULL when the array is missing or its width is not the fitted width: a failed
    scaling must not look like a sample at the origin.
    """
    d = len(params.columns)
    centre, factor, offset = (F.array(*[F.lit(v) for v in part]) for part in zip(*_steps(params)))

    def one(value: Column, i: Column) -> Column:
        out = (sanitise(value) - F.get(centre, i)) * F.get(factor, i) + F.get(offset, i)
        return clip(out, -limit, limit) if limit is not None else out

    return F.when(F.size(features) == d, F.transform(features, one))


def _steps(params: ScaleParams) -> list[tuple[float, float, float]]:
    """The whole chain per column as scaled = (value - centre) * factor + offset."""
    out = []
    for i, centre in enumerate(params.centre):
        factor, offset = 1.0 / params.spread[i], 0.0
        if params.low is not None and params.high is not None:
            to_low, to_high = params.target
            k = (to_high - to_low) / _spread_or_one(params.high[i] - params.low[i])
            factor, offset = factor * k, to_low - params.low[i] * k
        out.append((centre, factor, offset))
    return out


def params_table(spark, params: ScaleParams) -> DataFrame:
    """(feature, centre, spread) rows of a fitted scaler."""
    from ..functions.bounded import small_table

    rows = [
        {"feature": c, "centre": params.centre[i], "spread": params.spread[i]}
        for i, c in enumerate(params.columns)
    ]
    return small_table(spark, rows, "feature string, centre double, spread double")
