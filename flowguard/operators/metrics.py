"""Classification metrics.

Everything but the log-loss is derived from one grouped count of (actual,
predicted) pairs, so scored rows are read and shuffled once, after map-side
counting; what follows works on classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import settle, small_table

LOG_LOSS_FLOOR = 1e-15


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n), only pairs that occur; counted once, then a local table."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return settle(counts)


def _class_table(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    return F.broadcast(
        small_table(df.sparkSession, [{"class": c} for c in classes], "class string")
    )


def confusion_cells(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Every (actual, predicted) cell over the class list, zero-filled: the heat-map table."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = _class_table(counts, classes).select(
        F.col("class").alias("actual"), F.explode(names).alias("predicted")
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_matrix(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    cells = confusion_cells(counts, classes)
    return cells.groupBy("actual").agg(
        *[F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(c) for c in classes]
    )


def _per_class(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The class report with the number of hits."""
    support = counts.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    called = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    hits = counts.where("actual = predicted").select(F.col("actual").alias("class"), F.col("n").alias("hit"))
    joined = (
        _class_table(counts, classes)
        .join(support, "class", "left")
        .join(called, "class", "left")
        .join(hits, "class", "left")
        .na.fill(0, ["support", "called", "hit"])
    )
    precision = F.coalesce(F.try_divide("hit", "called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return joined.select(
        "class", precision.alias("precision"), recall.alias("recall"), "support", "hit"
    ).withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def _weighted(column: str) -> Column:
    """Mean over classes weighted by support; 0 without rows."""
    total = F.sum(F.col(column) * F.col("support"))
    return F.coalesce(F.try_divide(total, F.sum("support")), F.lit(0.0)).alias(column)


def class_report(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, precision, recall, f1, support) per class; undefined ratios are 0.

    ``classes`` is the full vocabulary, so that classes which never occur or are
    never predicted still have their row.
    """
    return _per_class(counts, classes).select("class", "precision", "recall", "f1", "support")


def classification_report(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The class report with its macro and support-weighted average rows."""
    per_class = class_report(counts, classes)
    ratios = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")
    macro = per_class.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ratios], support)
    average = per_class.agg(F.lit("weighted avg").alias("class"), *[_weighted(c) for c in ratios], support)
    return per_class.unionByName(macro).unionByName(average)


def overall_metrics(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    accuracy = F.coalesce(F.try_divide(F.sum("hit"), F.sum("support")), F.lit(0.0))
    return _per_class(counts, classes).agg(
        accuracy.alias("accuracy"), *[_weighted(c) for c in ("precision", "recall", "f1")]
    )


def log_loss(
    df: DataFrame, classes: Sequence[str], *, actual: str = "actual", by: Sequence[str] = ()
) -> DataFrame:
    """Mean -ln(probability given to the true class), per ``by`` group."""
    p = None
    for i, c in enumerate(classes):
        test, value = F.col(actual) == c, F.get("probability", F.lit(i))
        p = F.when(test, value) if p is None else p.when(test, value)
    loss = -F.ln(F.greatest(p, F.lit(LOG_LOSS_FLOOR)))
    loss = F.when(p.isNotNull(), loss)
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.count(p).alias("n"))
