"""The tables behind the diagnostic plots."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import small_table
from ..functions.quantiles import quantiles, quantiles_by

BINS = 50
QQ_POINTS = 99


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n) for equal-width bins over the column's range; empty bins included.

    The last bin includes the maximum. A column without spread gets a range of
    width 1 around its value.
    """
    value = F.col(column).cast("double")
    row = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if row["low"] is None:
        return small_table(df.sparkSession, [], "bin long, low double, high double, n long")
    low, high = row["low"], row["high"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((value - F.lit(low)) / F.lit(width)).cast("long"), F.lit(bins - 1).cast("long"))
    counts = df.where(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def error_timeline(errors: DataFrame, index: list[str], threshold: float) -> DataFrame:
    """(index columns, mse, threshold), one row per sequence."""
    return errors.select(*index, "mse", F.lit(threshold).alias("threshold"))


def normal_qq(df: DataFrame, column: str, points: int = QQ_POINTS, *, exact: bool = True) -> DataFrame:
    """(point, theoretical, observed): normal quantiles against the column's, on an even grid."""
    shares = [i / (points + 1) for i in range(1, points + 1)]
    found = quantiles(df, [column], shares, exact=exact)[column]
    normal = NormalDist()
    rows = [
        {"point": i, "theoretical": normal.inv_cdf(p), "observed": v}
        for i, (p, v) in enumerate(zip(shares, found), start=1)
        if v is not None
    ]
    return small_table(df.sparkSession, rows, "point long, theoretical double, observed double")


def error_scatter(detected: DataFrame, index: list[str]) -> DataFrame:
    return detected.select(*index, "mse", "mae", "is_anomaly")


def box_summary(detected: DataFrame, column: str = "mse", by: str = "is_anomaly", *, least_groups: int = 2) -> DataFrame:
    """Box-plot numbers per value of ``by``: quartiles, whiskers, outlier count.

    Whiskers reach the outermost values within 1.5 IQR of the box. Empty where
    fewer than ``least_groups`` groups occur: by default, unless both classes do.
    All groups come from one set of passes.
    """
    spark = detected.sparkSession
    kind = detected.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, n long, {_BOX}"
    boxes = {g: q[column] for g, q in quantiles_by(detected, by, [column], [0.25, 0.5, 0.75]).items() if q[column][0] is not None}
    if len(boxes) < max(1, least_groups):
        return small_table(spark, [], schema)
    fences = [
        {by: g, "q1": q1, "median": median, "q3": q3, "_low": q1 - 1.5 * (q3 - q1), "_high": q3 + 1.5 * (q3 - q1)}
        for g, (q1, median, q3) in boxes.items()
    ]
    table = small_table(spark, fences, f"`{by}` {kind}, q1 double, median double, q3 double, _low double, _high double")
    value = F.col(column).cast("double")
    inside = value.between(F.col("_low"), F.col("_high"))
    joined = detected.select(by, value.alias(column)).join(F.broadcast(table), by)
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, value)).alias("low_whisker"),
        F.max(F.when(inside, value)).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


_BOX = "q1 double, median double, q3 double, low_whisker double, high_whisker double, outliers long"
