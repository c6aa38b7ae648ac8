"""Message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.messages import bus_messages

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("csv_data", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def read_messages(
    spark: SparkSession,
    source: str = "kafka",
    *,
    brokers: str | None = None,
    topic: str | None = None,
    path: str | None = None,
    schema: T.StructType | None = None,
    starting_offsets: str = "latest",
    max_per_trigger: int | None = None,
    position: bool = True,
) -> DataFrame:
    """A stream of (device_id, csv_data, timestamp).

    ``source="kafka"`` needs the public Kafka connector on the class path and
    also gives ``partition`` and ``offset``, the arrival order within a device.
    Any file format name reads files of messages from ``path``, with extra order
    columns where ``schema`` has them.
    ``max_per_trigger`` bounds a micro-batch in records (Kafka) or files.
    """
    if source == "kafka":
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
        )
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return bus_messages(reader.load(), position=position)
    reader = spark.readStream.format(source).schema(schema or MESSAGE_SCHEMA)
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.load(path)
