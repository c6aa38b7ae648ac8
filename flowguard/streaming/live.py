"""Live statistics of a stream of triaged or judged rows: counters, attack types, snapshots.

Each micro-batch adds its increments to tables below an output folder. A retried
micro-batch replaces its own increments, so every sample counts once, and the
numbers of any moment are one aggregate over small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.bounded import small_table
from ..operators.ordering import block_length, running_totals
from ..operators.stats import (
    COUNTERS,
    SNAPSHOT_EVERY,
    TIER2_COUNTERS,
    change_rows,
    device_counters,
    snapshot_counts,
)
from ..sources.paths import children, path_exists, write_and_read
from .deltas import MERGE_AFTER, DeltaTable

ALL_COUNTERS = (*COUNTERS, *TIER2_COUNTERS)


def _longs(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def counter_table(
    spark: SparkSession, output: str, names: Sequence[str] = ALL_COUNTERS, merge_after: int = MERGE_AFTER
) -> DeltaTable:
    """Increments of the counters per device."""
    schema = T.StructType([T.StructField("device_id", T.StringType()), *_longs(names)])
    total = lambda rows: rows.groupBy("device_id").agg(*[F.sum(n).alias(n) for n in names])
    return DeltaTable(spark, f"{output}/counters", schema, ["device_id"], total, merge_after=merge_after)


def attack_table(spark: SparkSession, output: str, merge_after: int = MERGE_AFTER) -> DeltaTable:
    """Increments of the attacks per device and class."""
    schema = T.StructType(
        [T.StructField("device_id", T.StringType()), T.StructField("predicted_class", T.StringType()), *_longs(["n"])]
    )
    total = lambda rows: rows.groupBy("device_id", "predicted_class").agg(F.sum("n").alias("n"))
    return DeltaTable(spark, f"{output}/attacks", schema, ["device_id"], total, merge_after=merge_after)


def live_counters(spark: SparkSession, output: str, names: Sequence[str] = ALL_COUNTERS) -> DataFrame:
    """The counters per device, as of the last complete micro-batch."""
    return counter_table(spark, output, names).state()


def start_live_counters(
    triaged: DataFrame, *, output: str, checkpoint: str, trigger: dict | None = None, merge_after: int = MERGE_AFTER
) -> StreamingQuery:
    """Counts a triaged stream per device into tables below ``output``: see ``live_counters``.

    Counting is partial before the shuffle, so a busy device sends one row per
    task, and a micro-batch writes only the devices it has seen.
    """
    names = ALL_COUNTERS if "tier2_status" in triaged.columns else tuple(COUNTERS)

    def count(batch: DataFrame, batch_id: int) -> None:
        table = counter_table(batch.sparkSession, output, names, merge_after)
        table.compact(batch_id)
        table.append(batch_id, device_counters(batch))

    return (
        triaged.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 seconds"}))
        .start()
    )


@dataclass
class Progress:
    """What the next micro-batch needs to know: samples so far, overall counters, devices of the open snapshot."""

    samples: int = 0
    overall: dict[str, int] = field(default_factory=lambda: dict.fromkeys(ALL_COUNTERS, 0))
    # Fewer than the snapshot interval.
    open_devices: list[str] = field(default_factory=list)


_LEDGER = "samples long, open_devices array<string>, " + ", ".join(f"{n} long" for n in ALL_COUNTERS)


class Ledger:
    """One row per micro-batch that had messages, written after all its tables."""

    def __init__(self, spark: SparkSession, output: str) -> None:
        self.spark, self.output = spark, output

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        names = [n.removeprefix(prefix) for n in children(self.spark, f"{self.output}/{folder}") if n.startswith(prefix)]
        return sorted(int(n) for n in names if n.isdigit())

    def before(self, batch_id: int) -> Progress:
        """The progress before a micro-batch. An earlier one with results but without its entry is an error."""
        earlier = [n for n in self._numbers("results", "batch_id=") if n < batch_id]
        if not earlier:
            return Progress()
        path = f"{self.output}/ledger/{earlier[-1]}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            # Starting from nothing would number samples anew and pad every device's sequence.
            raise FileNotFoundError(f"micro-batch {batch_id} needs {path}, which is gone")
        row = self.spark.read.schema(_LEDGER).parquet(path).first()
        return Progress(row["samples"], {n: row[n] for n in ALL_COUNTERS}, list(row["open_devices"]))

    def write(self, batch_id: int, progress: Progress) -> None:
        row = {"samples": progress.samples, "open_devices": progress.open_devices} | progress.overall
        small_table(self.spark, [row], _LEDGER).write.mode("overwrite").parquet(f"{self.output}/ledger/{batch_id}")


def record_statistics(
    judged: DataFrame, output: str, batch_id: int, before: Progress, *,
    every: int = SNAPSHOT_EVERY, merge_after: int = MERGE_AFTER, work: str,
) -> Progress:
    """Adds one micro-batch of numbered, judged rows to the statistics and returns the new progress.

    Snapshots that became complete are appended as change rows: the running
    counters of the devices that changed, and the overall row. Only the totals
    of those devices are looked up.
    """
    spark = judged.sparkSession
    names = list(ALL_COUNTERS)
    counters, attacks = (t(spark, output, merge_after=merge_after) for t in (counter_table, attack_table))
    counters.compact(batch_id)
    attacks.compact(batch_id)
    # From here on, all comes from these counts per snapshot and device.
    counts = write_and_read(snapshot_counts(judged, every), f"{work}/snapshot-counts")
    device_totals = counts.groupBy("device_id").agg(*[F.sum(n).alias(n) for n in names])
    counters.append(batch_id, device_totals)
    attacks.append(
        batch_id,
        judged.where("traffic_type = 'ATTACK'").groupBy("device_id", "predicted_class").agg(F.count(F.lit(1)).alias("n")),
    )
    # A snapshot has fewer devices than samples, so what is gathered per snapshot is bounded by the interval.
    per_shot = counts.groupBy("shot").agg(*[F.sum(n).alias(n) for n in names], F.collect_set("device_id").alias("devices"))
    added = per_shot.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.max("shot").alias("top"), F.max_by("devices", "shot").alias("devices")
    ).first()
    after = Progress(before.samples + added["total"], {n: before.overall[n] + added[n] for n in names})
    done, last = before.samples // every, after.samples // every
    at_open = added["devices"] if added["top"] == last + 1 else []
    after.open_devices = sorted({*at_open, *(before.open_devices if last == done else [])})

    # Devices that only earlier micro-batches counted towards the open snapshot change in it as well.
    waiting = [{"shot": done + 1, "device_id": d} | dict.fromkeys(names, 0) for d in before.open_devices]
    kinds = ", ".join(f"{n} long" for n in names)
    waiting = small_table(spark, waiting, f"shot long, device_id string, {kinds}")
    touched = counts.unionByName(waiting).groupBy("shot", "device_id").agg(*[F.sum(n).alias(n) for n in names])
    touched = touched.where(F.col("shot") <= last).withColumn("scope", F.lit("device"))
    overall = per_shot.where(F.col("shot") <= last).drop("devices").withColumns({"scope": F.lit("overall"), "device_id": F.lit("")})
    # The totals so far stand in front of the first snapshot that changes them.
    known = counters.lookup(touched, batch_id).withColumns({"scope": F.lit("device"), "shot": F.lit(done).cast("long")})
    so_far = small_table(spark, [{"scope": "overall", "device_id": "", "shot": done} | before.overall], f"scope string, device_id string, shot long, {kinds}")
    rows = reduce(DataFrame.unionByName, [touched, overall, known, so_far])
    totals = running_totals(rows, ["scope", "device_id"], "shot", names, block=block_length(last - done))
    totals = totals.where(F.col("shot") > done)
    totals.select("scope", "device_id", (F.col("shot") * every).alias("valid_from"), *names).write.mode("overwrite").parquet(
        f"{output}/snapshots/batch_id={batch_id}"
    )
    return after


_SNAPSHOTS = T.StructType(
    [T.StructField("scope", T.StringType()), T.StructField("device_id", T.StringType()), *_longs(["valid_from", *ALL_COUNTERS])]
)


def live_snapshots(spark: SparkSession, output: str, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The recorded snapshots as change rows, like ``statistics_changes``; ``snapshots_at`` looks them up."""
    rows = spark.read.schema(_SNAPSHOTS).option("basePath", f"{output}/snapshots").parquet(f"{output}/snapshots")
    shots = (rows.agg(F.max("valid_from")).first()[0] or 0) // every
    return change_rows(rows.select(*_SNAPSHOTS.names), ALL_COUNTERS, block=block_length(shots) * every)
