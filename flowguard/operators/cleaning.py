"""Cleaning and feature selection.

Every *fit* is a constant number of whole-table aggregates that cover all
columns at once and bring back only per-column numbers; every *apply* is one
projection, so filters and column pruning still reach the scan below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clip, missing_if_not_finite
from ..functions.quantiles import quantiles
from .labels import group_label

# Selection limits of the two cleaning recipes.
CLASSIFIER_CORRELATION = 0.95
ANOMALY_CORRELATION = 0.98
NEAR_CONSTANT_STD = 1e-6
LOW_VARIANCE = 0.01
IQR_FACTOR = 3.0


@dataclass
class CleanParams:
    """What a cleaning recipe learned: kept columns and their per-column numbers."""

    feature_columns: list[str]
    medians: dict[str, float | None]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude
    ]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact de-duplication over all columns; copies collapse before the shuffle."""
    return df.distinct()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """(rows_before, rows_after, rows_removed) from one grouping of the rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def missing_for_not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: missing_if_not_finite(F.col(c)) for c in columns})


def medians(
    df: DataFrame,
    columns: Sequence[str],
    exact: bool = True,
    counts: dict[str, int] | None = None,
) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, columns, [0.5], exact=exact, counts=counts).items()}


def fill_missing(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(filled) if filled else df


def column_spread(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Per column: known values, low, high, sample std and variance, in one aggregate."""
    if not columns:
        return {}
    measures = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        measures += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"low{i}"),
            F.max(v).alias(f"high{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.var_samp(v).alias(f"var{i}"),
        ]
    row = df.agg(*measures).first()
    return {
        c: {m: row[f"{m}{i}"] for m in ("n", "low", "high", "std", "var")}
        for i, c in enumerate(columns)
    }


def constant_columns(spread: dict[str, dict]) -> list[str]:
    """At most one distinct non-missing value: the extremes agree, or there are none."""
    return [c for c, s in spread.items() if s["low"] is None or s["low"] == s["high"]]


def near_constant_columns(spread: dict[str, dict], limit: float = NEAR_CONSTANT_STD) -> list[str]:
    return [c for c, s in spread.items() if s["std"] is not None and s["std"] < limit]


def low_variance_columns(spread: dict[str, dict], limit: float = LOW_VARIANCE) -> list[str]:
    return [c for c, s in spread.items() if s["var"] is not None and s["var"] < limit]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations of complete columns; NaN where one side is constant.

    Columns are standardised, so that large offsets do not drown the products,
    and one distributed aggregate gives the columns x columns result.
    """
    columns = list(columns)
    d = len(columns)
    matrix = np.full((d, d), np.nan)
    if d == 0:
        return matrix
    measures = [F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)]
    measures += [F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    row = df.agg(*measures).first()
    usable = [i for i in range(d) if row[f"s{i}"]]
    if len(usable) < 2:
        return matrix
    unit = df.select(
        *[((F.col(columns[i]).cast("double") - row[f"a{i}"]) / row[f"s{i}"]).alias(f"u{i}") for i in usable]
    )
    vectors = VectorAssembler(inputCols=unit.columns, outputCol="u").transform(unit).select("u")
    found = Correlation.corr(vectors, "u").first()[0].toArray()
    for a, i in enumerate(usable):
        for b, j in enumerate(usable):
            if i != j:
                matrix[i, j] = found[a, b]
    return matrix


def correlated_columns(matrix: np.ndarray, columns: Sequence[str], limit: float) -> list[str]:
    """Columns that correlate beyond the limit with any earlier column, dropped or not."""
    strong = np.abs(np.nan_to_num(matrix)) > limit
    return [c for j, c in enumerate(columns) if strong[:j, j].any()]


def fit_classifier_cleaning(
    df: DataFrame,
    label: str = "Label",
    *,
    exclude: Sequence[str] = (),
    limit: float = CLASSIFIER_CORRELATION,
    exact: bool = True,
) -> CleanParams:
    """Medians, constant columns, then correlation pruning over filled columns."""
    columns = numeric_columns(df, exclude=[label, *exclude])
    data = missing_for_not_finite(df.select(*columns), columns)
    dropped = {
        c: "not numeric" for c in df.columns if c not in columns and c != label and c not in exclude
    }
    spread = column_spread(data, columns)
    constant = constant_columns(spread)
    dropped |= {c: "constant" for c in constant}
    columns = [c for c in columns if c not in constant]
    middle = medians(data, columns, exact, {c: spread[c]["n"] for c in columns})
    filled = fill_missing(data, middle)
    pruned = correlated_columns(correlation_matrix(filled, columns), columns, limit)
    dropped |= {c: "correlated" for c in pruned}
    kept = [c for c in columns if c not in pruned]
    return CleanParams(kept, {c: middle[c] for c in kept}, dropped=dropped)


def apply_classifier_cleaning(
    df: DataFrame, params: CleanParams, keep: Sequence[str] = ("Label",)
) -> DataFrame:
    kept = params.feature_columns
    narrow = df.select(*kept, *[c for c in keep if c in df.columns])
    return fill_missing(missing_for_not_finite(narrow, kept), params.medians)


def prepare_labelled_flows(df: DataFrame, label: str = "Label") -> DataFrame:
    """Group the labels, then drop exact copies (infinities still count as values here)."""
    return drop_duplicate_rows(df.withColumn(label, group_label(F.col(label))))


def outlier_bounds(quartiles: Sequence[float], factor: float = IQR_FACTOR) -> tuple[float, float]:
    q1, _, q3 = quartiles
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def fit_anomaly_cleaning(
    df: DataFrame,
    *,
    exclude: Sequence[str] = (),
    limit: float = ANOMALY_CORRELATION,
    exact: bool = True,
) -> CleanParams:
    """Near-constant columns, outlier bounds, correlation pruning, low variance, in that order.

    The median lies between the quartiles, so clipping at the bounds cannot move
    it and one quantile pass serves both.
    """
    columns = numeric_columns(df, exclude=exclude)
    data = missing_for_not_finite(df.select(*columns), columns)
    spread = column_spread(data, columns)
    dropped = {c: "constant" for c in constant_columns(spread)}
    dropped |= {c: "near constant" for c in near_constant_columns(spread) if c not in dropped}
    columns = [c for c in columns if c not in dropped]
    counts = {c: spread[c]["n"] for c in columns}
    quartiles = quantiles(data, columns, [0.25, 0.5, 0.75], exact=exact, counts=counts)
    bounds = {c: outlier_bounds(quartiles[c]) for c in columns}
    middle = {c: quartiles[c][1] for c in columns}
    clipped = _clip_and_fill(data.select(*columns), bounds, middle)
    pruned = correlated_columns(correlation_matrix(clipped, columns), columns, limit)
    dropped |= {c: "correlated" for c in pruned}
    columns = [c for c in columns if c not in pruned]
    flat = low_variance_columns(column_spread(clipped, columns))
    dropped |= {c: "low variance" for c in flat}
    kept = [c for c in columns if c not in flat]
    return CleanParams(
        kept, {c: middle[c] for c in kept}, {c: bounds[c] for c in kept}, dropped
    )


def _clip_and_fill(
    df: DataFrame, bounds: dict[str, tuple[float, float]], middle: dict[str, float | None]
) -> DataFrame:
    clipped = {c: clip(F.col(c), low, high) for c, (low, high) in bounds.items()}
    return fill_missing(df.withColumns(clipped) if clipped else df, middle)


def apply_anomaly_cleaning(df: DataFrame, params: CleanParams, keep: Sequence[str] = ()) -> DataFrame:
    """Missing for not finite, clip, fill with the median: no missing value can remain."""
    kept = params.feature_columns
    narrow = df.select(*kept, *[c for c in keep if c in df.columns])
    return _clip_and_fill(missing_for_not_finite(narrow, kept), params.bounds, params.medians)


def table_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_count, feature_count, lowest, highest) over all the columns."""
    values = [F.col(c).cast("double") for c in columns]
    low = [F.min(v) for v in values]
    high = [F.max(v) for v in values]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(columns)).cast("long").alias("feature_count"),
        (F.least(*low) if len(low) > 1 else low[0]).alias("lowest"),
        (F.greatest(*high) if len(high) > 1 else high[0]).alias("highest"),
    )


def class_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per class, most frequent first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(label))


def label_occurrences(df: DataFrame, label: str = "Label") -> DataFrame:
    """The held-out label table: (class, occurrences_number)."""
    return df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("occurrences_number")
    )
