"""Shared working folders and path checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Fewest partitions that models are trained on.
TRAINING_PARTITIONS = 16


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder; none where the folder doesn't exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def first_line(spark: SparkSession, path: str, block: int = 1 << 16) -> str | None:
    """The first line of a text file in any store that Spark reads, or None where it is empty.

    Reads one block, or as many as the line is long; compressed files are
    decompressed as Spark does it, by their names.
    """
    hadoop = spark._jvm.org.apache.hadoop
    conf, target = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
    stream = target.getFileSystem(conf).open(target)
    try:
        stream = stream if codec is None else codec.createInputStream(stream)
        data = b""
        while not (b"\n" in data or b"\r" in data[:-1]):
            part = bytes(stream.readNBytes(block))
            data += part
            if len(part) < block:
                break
    finally:
        stream.close()
    lines = data.decode("utf-8", "replace").removeprefix("\ufeff").splitlines()
    return lines[0] if lines else None


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder stands in, but only in
    local mode: on a cluster other machines could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="flowguard-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Materialises a stage as a table: lost executors reread it instead of recomputing it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``write_and_read`` in a new working folder, for a result that is used several times."""
    return write_and_read(df, work_folder(df.sparkSession, name))


def spread_for_training(df: DataFrame, partitions: int = TRAINING_PARTITIONS) -> DataFrame:
    """Repartitions rows that sit in fewer partitions than asked for.

    Training passes over its input many times, so one shuffle of a badly split
    input pays off. The number is a parameter rather than the cluster's cores,
    as a fitted forest depends on it. Meant for written tables, whose
    partitions are known without running anything.
    """
    return df.repartition(partitions) if df.rdd.getNumPartitions() < partitions else df
