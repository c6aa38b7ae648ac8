"""Per-device and overall statistics over triaged rows, and alert rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import block_length, following, number_rows, totals_and_following

COUNTERS = {
    "total": lambda: F.lit(True),
    "benign": lambda: F.col("traffic_type") == "BENIGN",
    "attack": lambda: F.col("traffic_type") == "ATTACK",
    "doubt": lambda: F.col("traffic_type") == "DOUBT",
}
TIER2_COUNTERS = {
    "analysed": lambda: F.col("tier2_status").isin("ANOMALY", "BENIGN"),
    "confirmed_anomaly": lambda: F.col("tier2_status") == "ANOMALY",
    "confirmed_benign": lambda: F.col("tier2_status") == "BENIGN",
    "tier2_errors": lambda: F.col("tier2_status") == "ERROR",
}

# Fixed value: samples between two statistics snapshots.
SNAPSHOT_EVERY = 25
# Dense snapshots of one device that are listed before the next device's.
LISTED_TOGETHER = 1024


def number_samples(valid: DataFrame, order_by: Sequence[str], slice_by: Column) -> DataFrame:
    """Adds ``sample_id``: the arrival number over all devices, valid messages only."""
    return number_rows(valid, order_by, slice_by, "sample_id")


def _measures(df: DataFrame) -> dict[str, Column]:
    tests = COUNTERS | (TIER2_COUNTERS if "tier2_status" in df.columns else {})
    return {name: F.count_if(test()) for name, test in tests.items()}


def device_counters(df: DataFrame) -> DataFrame:
    """Counters per device; tier-2 counters when the rows carry a tier-2 status."""
    return df.groupBy("device_id").agg(*[m.alias(n) for n, m in _measures(df).items()])


def with_overall(per_device: DataFrame) -> DataFrame:
    """Adds the overall row (``device_id`` NULL, ``scope`` 'overall') to per-device counters.

    The rollup runs over the device summary, so flow rows are not expanded.
    """
    names = [c for c in per_device.columns if c != "device_id"]
    return (
        per_device.rollup("device_id")
        .agg(F.grouping("device_id").alias("_all"), *[F.sum(n).alias(n) for n in names])
        .select(
            F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.lit("device")).alias("scope"),
            "device_id",
            *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        )
    )


def add_rates(counters: DataFrame) -> DataFrame:
    """Percentages of each traffic type; tier-2 rates only where something was analysed."""
    def percent(part: Column, whole: Column) -> Column:
        return F.try_divide(100.0 * part, whole)

    out = counters.withColumns(
        {f"{n}_percent": percent(F.col(n), F.col("total")) for n in ("benign", "attack", "doubt")}
    )
    if "analysed" not in counters.columns:
        return out
    analysed = F.when(F.col("analysed") > 0, F.col("analysed"))
    return out.withColumns(
        {
            "anomaly_rate": percent(F.col("confirmed_anomaly"), analysed),
            "success_rate": percent(analysed, analysed + F.col("tier2_errors")),
        }
    )


def active_devices(counters: DataFrame) -> DataFrame:
    return counters.where(F.col("total") > 0).orderBy("device_id")


def attack_type_counts(df: DataFrame) -> DataFrame:
    """(scope, device_id, predicted_class, n): attacks per device, and overall (device NULL)."""
    attacks = df.where(F.col("traffic_type") == "ATTACK")
    return sum_attack_types(attacks.groupBy("device_id", "predicted_class").agg(F.count(F.lit(1)).alias("n")))


def sum_attack_types(per_device: DataFrame) -> DataFrame:
    """Adds the overall rows to attacks per device and class."""
    # Two grouping sets over the summary, not over the flows.
    sets = per_device.groupingSets(
        [[F.col("device_id"), F.col("predicted_class")], [F.col("predicted_class")]],
        F.col("device_id"),
        F.col("predicted_class"),
    ).agg(F.grouping("device_id").alias("_all"), F.sum("n").alias("n"))
    return sets.select(
        F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.lit("device")).alias("scope"),
        "device_id",
        "predicted_class",
        "n",
    )


def attack_type_map(counts: DataFrame) -> DataFrame:
    """(scope, device_id, attack_types): one map per device, with one entry per attack class."""
    return counts.groupBy("scope", "device_id").agg(
        F.map_from_entries(F.collect_list(F.struct("predicted_class", "n"))).alias("attack_types")
    )


def snapshot_counts(samples: DataFrame, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """(shot, device_id, counters): each device's samples towards the shot-th snapshot.

    Snapshots are taken after every ``every``-th sample over all devices. Write
    the result before ``statistics_changes``, which reads it several times.
    """
    shot = F.expr(f"(sample_id + {int(every) - 1}) div {int(every)}").cast("long")
    # A snapshot's samples, ``every`` at most, go to one task: what is summed per snapshot hardly shuffles then.
    together = samples.withColumn("shot", shot).repartition("shot")
    return together.groupBy("shot", "device_id").agg(*[m.alias(n) for n, m in _measures(samples).items()])


def counter_names(df: DataFrame) -> list[str]:
    return [n for n in (*COUNTERS, *TIER2_COUNTERS) if n in df.columns]


def statistics_changes(counts: DataFrame, every: int = SNAPSHOT_EVERY, *, block: int | None = None) -> DataFrame:
    """The counters of all complete snapshots as change rows.

    Gives scope, device_id, valid_from, valid_to and the running counters: what
    every snapshot from sample ``valid_from`` on shows, up to but without
    ``valid_to`` (NULL: still valid). A device has a row only where its counters
    changed, so rows grow with the samples and not with devices times snapshots.
    The overall rows (``device_id`` NULL) change in each snapshot. Totals run in
    two levels: no device, nor the overall row, is one task's work. Without
    ``block``, the blocks' length grows with the snapshots.
    """
    names = counter_names(counts)
    last = (counts.agg(F.sum("total")).first()[0] or 0) // every
    done = counts.where(F.col("shot") <= last)
    overall = done.groupBy("shot").agg(*[F.sum(n).alias(n) for n in names])
    changes = done.withColumn("scope", F.lit("device")).unionByName(
        overall.withColumn("scope", F.lit("overall")), allowMissingColumns=True
    )
    changes = changes.withColumn("device_id", F.coalesce("device_id", F.lit("")))
    changes = changes.withColumn("valid_from", F.col("shot") * every)
    block = (block or block_length(last)) * every
    return _change_columns(
        totals_and_following(changes, ["scope", "device_id"], "valid_from", names, "valid_to", block=block), names
    )


def change_rows(totals: DataFrame, names: Sequence[str], *, block: int) -> DataFrame:
    """Adds valid_to to running counters per scope, device ('' for overall) and valid_from."""
    return _change_columns(following(totals, ["scope", "device_id"], "valid_from", "valid_to", block=block), names)


def _change_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.select(
        "scope",
        F.when(F.col("scope") == "device", F.col("device_id")).alias("device_id"),
        "valid_from",
        "valid_to",
        *names,
    )


def snapshots_at(changes: DataFrame, at: Sequence[int]) -> DataFrame:
    """The dense snapshots at the named sample numbers: (at_sample, scope, device_id, counters).

    Each lists the overall row and every device seen by then. Between two
    snapshots the earlier one holds. Rows are looked up by where their validity
    begins and ends among the named numbers: nothing is joined.

    Within a partition, the same run of numbers is listed device by device, so
    that its columns repeat at a short distance and a written table is small
    beside its rows.
    """
    named = sorted(set(int(n) for n in at))
    names = counter_names(changes)
    if not named:
        return changes.limit(0).select(F.col("valid_from").alias("at_sample"), "scope", "device_id", *names)
    # A number's place is how many named numbers lie below it.
    splits = [-math.inf, *map(float, named), math.inf]
    edges = changes.withColumns({
        "_from": F.col("valid_from") - F.lit(0.5), "_to": F.coalesce(F.col("valid_to") - F.lit(0.5), F.lit(float(named[-1]) + 1))
    })
    placed = Bucketizer(
        splitsArray=[splits, splits], inputCols=["_from", "_to"], outputCols=["_first", "_end"]
    ).transform(edges).where(F.col("_first") < F.col("_end"))
    first, last = F.col("_first").cast("int"), (F.col("_end") - 1).cast("int")
    together = F.lit(LISTED_TOGETHER)
    runs = F.sequence(F.floor(first / together).cast("int"), F.floor(last / together).cast("int"))
    # Sorted are change rows, cut at the runs' ends, and not yet the dense rows.
    cut = placed.withColumn("_run", F.explode(runs)).sortWithinPartitions("_run", "scope", "device_id", "_first")
    places = F.sequence(F.greatest(first, F.col("_run") * together), F.least(last, (F.col("_run") + 1) * together - 1))
    return cut.withColumn("_place", F.explode(places)).select(
        F.get(F.lit(named).cast("array<bigint>"), F.col("_place")).alias("at_sample"), "scope", "device_id", *names
    )


# What an alert reports, and how serious it is.
EVENTS = {
    "benign": "INFO",
    "attack": "ALERT",
    "confirmed_anomaly": "ALERT",
    "confirmed_benign": "INFO",
    "analysis_failed": "WARNING",
    "analysis_off": "WARNING",
}


def alerts(rows: DataFrame, events: Sequence[str] = tuple(EVENTS)) -> DataFrame:
    """One alert per judged sample, as columns: sample_id, device_id, level, event and its figures.

    ``attack_class`` names the class of an attack; ``confidence`` is the first
    tier's; the error, its threshold, the score and the model's kind are the
    second tier's where it gave a verdict. ``events`` picks some events only.
    """
    kind, status = F.col("traffic_type"), F.col("tier2_status")
    event = (
        F.when(kind == "BENIGN", F.lit("benign"))
        .when(kind == "ATTACK", F.lit("attack"))
        .when(status == "ANOMALY", F.lit("confirmed_anomaly"))
        .when(status == "BENIGN", F.lit("confirmed_benign"))
        .when(status == "ERROR", F.lit("analysis_failed"))
        .otherwise(F.lit("analysis_off"))
    )
    level = None
    for name, value in EVENTS.items():
        test = F.col("event") == name
        level = F.when(test, F.lit(value)) if level is None else level.when(test, F.lit(value))
    detail = ("reconstruction_error", "threshold", "anomaly_score", "model_type")
    order = [c for c in ("timestamp",) if c in rows.columns]
    return (
        rows.withColumn("event", event).where(F.col("event").isin(*events))
        .select(
            "sample_id",
            "device_id",
            *order,
            level.alias("level"),
            "event",
            F.when(kind == "ATTACK", F.col("predicted_class")).alias("attack_class"),
            "confidence",
            *[F.col(f"tier2_detail.{c}").alias(c) for c in detail],
        )
    )
