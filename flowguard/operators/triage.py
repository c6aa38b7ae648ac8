"""The three triage policies over scored rows (``probability`` array, class list).

They differ on purpose. *Training* triage also flags uncertain attacks. *Online*
triage never doubts a predicted attack. *Extraction* takes only DOUBT and weak
BENIGN rows, with a lower confidence limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probabilities import (
    BENIGN,
    DOUBT,
    attack_classes,
    attack_probability,
    class_probability,
    max_confidence,
    predicted_class,
)

# Confidence limits, and when a BENIGN verdict looks suspicious.
CONFIDENCE_LIMIT = 0.7
EXTRACTION_LIMIT = 0.65
SUSPICIOUS_ATTACK = 0.2
SUSPICIOUS_BENIGN = 0.9
SUSPICIOUS_NAME = "Suspicious BENIGN"


def add_prediction(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds ``predicted_class``, ``confidence`` and ``attack_probability``."""
    p = F.col("probability")
    return scored.withColumns(
        {
            "predicted_class": predicted_class(p, classes),
            "confidence": max_confidence(p),
            "attack_probability": attack_probability(p, classes),
        }
    )


def _criteria(
    classes: Sequence[str], limit: float
) -> tuple[Column, Column, Column]:
    predicted, confidence = F.col("predicted_class"), F.col("confidence")
    low = confidence < limit
    doubt = predicted == DOUBT
    suspicious = F.lit(False)
    if BENIGN in classes and attack_classes(classes):
        suspicious = (
            (predicted == BENIGN)
            & (F.col("attack_probability") > SUSPICIOUS_ATTACK)
            & (class_probability(F.col("probability"), classes, BENIGN) < SUSPICIOUS_BENIGN)
        )
    return low, doubt, suspicious


def training_triage(
    scored: DataFrame, classes: Sequence[str], *, limit: float = CONFIDENCE_LIMIT
) -> DataFrame:
    """Adds the three overlapping criteria and ``is_doubt``, their union."""
    low, doubt, suspicious = _criteria(classes, limit)
    return add_prediction(scored, classes).withColumns(
        {
            "low_confidence": low,
            "doubt_class": doubt,
            "suspicious_benign": suspicious,
            "is_doubt": low | doubt | suspicious,
        }
    )


def uncertain_rows(triaged: DataFrame) -> DataFrame:
    return triaged.where("is_doubt")


def training_triage_summary(triaged: DataFrame) -> DataFrame:
    """One row: rows per criterion (they overlap), total uncertain rows, percent."""
    return triaged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("low_confidence").alias("low_confidence"),
        F.count_if("doubt_class").alias("doubt_class"),
        F.count_if("suspicious_benign").alias("suspicious_benign"),
        F.count_if("is_doubt").alias("total_doubt"),
    ).withColumn("doubt_percent", F.try_divide(100.0 * F.col("total_doubt"), F.col("total_rows")))


def online_triage(
    scored: DataFrame, classes: Sequence[str], *, limit: float = CONFIDENCE_LIMIT
) -> DataFrame:
    """Adds ``traffic_type`` (BENIGN, ATTACK, DOUBT); ``predicted_class`` names doubted BENIGN rows."""
    rows = add_prediction(scored, classes)
    predicted, confidence = F.col("predicted_class"), F.col("confidence")
    doubted = F.lit(False)
    if attack_classes(classes):
        doubted = (predicted == BENIGN) & (
            (confidence < limit)
            | (
                (F.col("attack_probability") > SUSPICIOUS_ATTACK)
                & (confidence < SUSPICIOUS_BENIGN)
            )
        )
    return rows.withColumn(
        "traffic_type",
        F.when((predicted == DOUBT) | doubted, F.lit("DOUBT"))
        .when(predicted == BENIGN, F.lit("BENIGN"))
        .otherwise(F.lit("ATTACK")),
    ).withColumn(
        "predicted_class", F.when(doubted, F.lit(SUSPICIOUS_NAME)).otherwise(predicted)
    )


def extract_uncertain(
    scored: DataFrame, classes: Sequence[str], *, limit: float = EXTRACTION_LIMIT
) -> DataFrame:
    """Rows predicted DOUBT, or BENIGN below the limit, with their original columns only."""
    p = F.col("probability")
    predicted = predicted_class(p, classes)
    keep = (predicted == DOUBT) | ((predicted == BENIGN) & (max_confidence(p) < limit))
    return scored.where(keep).drop("probability")


def prediction_table(scored: DataFrame, classes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide result: prediction, max_probability, one prob_<class> column per class."""
    p = F.col("probability")
    return scored.select(
        *keep,
        predicted_class(p, classes).alias("prediction"),
        max_confidence(p).alias("max_probability"),
        *[F.get(p, F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(classes)],
    )


def prediction_summary(predictions: DataFrame, column: str = "prediction") -> DataFrame:
    counts = predictions.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(column))
