"""Bus records to device messages to numeric feature arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import compute_once
from ..functions.numbers import parse_number

# Fixed value: the device name of a message without a key.
UNKNOWN_DEVICE = "unknown"


def bus_messages(records: DataFrame, *, position: bool = False) -> DataFrame:
    """Bus records (key, value, timestamp) to (device_id, csv_data, timestamp).

    ``position=True`` keeps the bus partition and offset, the arrival order of
    records that share a key.
    """
    extra = ["partition", "offset"] if position else []
    return records.select(
        F.col("key").cast("string").alias("device_id"),
        F.col("value").cast("string").alias("csv_data"),
        F.col("timestamp"),
        *extra,
    )


def device_or_unknown(device: Column) -> Column:
    return F.coalesce(F.nullif(device, F.lit("")), F.lit(UNKNOWN_DEVICE))


def parse_features(csv: Column) -> Column:
    """CSV text to an array of doubles; NULL marks a field that is not a number."""
    return F.transform(F.split(csv, ",", -1), parse_number)


def parse_messages(messages: DataFrame, width: int | None = None) -> DataFrame:
    """Adds ``features`` and ``is_valid``, and fills in the device.

    A message is invalid when its text is NULL, when any field is not a number,
    or when the field count differs from ``width``. Each text is parsed once,
    whatever reads its features later.
    """
    parsed = messages.withColumn("device_id", device_or_unknown(F.col("device_id"))).withColumn(
        "features", compute_once(parse_features(F.col("csv_data")))
    )
    ok = F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull())
    if width is not None:
        ok = ok & (F.size("features") == width)
    return parsed.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def valid_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_valid").drop("is_valid", "csv_data")


def rejected_messages(parsed: DataFrame) -> DataFrame:
    """The dead-letter side: original text, no features."""
    return parsed.where(~F.col("is_valid")).drop("is_valid", "features")
