"""Live monitoring: message stream in, judged messages, alerts and statistics out.

    spark-submit -m flowguard.plans.monitor --brokers HOST:PORT --topic TOPIC \\
        --classifier PATH --anomaly PATH --output PATH
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import (
    SNAPSHOT_EVERY,
    active_devices,
    add_rates,
    attack_type_counts,
    attack_type_map,
    device_counters,
    number_samples,
    snapshot_counts,
    statistics_changes,
    sum_attack_types,
    with_overall,
)
from ..sources.bus import read_messages
from ..sources.packages import load_anomaly_model, load_classifier
from ..sources.paths import stage
from ..streaming.cascade import Tier1, Tier2, first_tier, second_tier, start_cascade
from ..streaming.live import attack_table, live_counters, live_snapshots

# Records of a bus partition that form one slice of a device's rows.
SLICE_RECORDS = 100_000


def start_monitor(
    spark: SparkSession,
    messages: DataFrame,
    *,
    classifier: str,
    anomaly: str | None,
    output: str,
    checkpoint: str,
    order_by: list[str],
    slice_by: Column | None = None,
    stats_interval: int = SNAPSHOT_EVERY,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Loads the saved packages and starts the cascade. No anomaly package: tier 2 is off."""
    package = load_classifier(spark, classifier)
    columns = package.feature_columns
    return start_cascade(
        messages,
        first_tier(package),
        second_tier(load_anomaly_model(spark, anomaly), columns),
        output=output,
        checkpoint=checkpoint,
        width=len(columns),
        order_by=order_by,
        slice_by=slice_by,
        stats_interval=stats_interval,
        trigger=trigger,
        **options,
    )


def monitor_until_stopped(
    messages: DataFrame, tier1: Tier1, tier2: Tier2 | None, *, output: str, **options
) -> dict[str, DataFrame]:
    """Runs the cascade until its query ends or is interrupted; then writes the final statistics."""
    return until_stopped(start_cascade(messages, tier1, tier2, output=output, **options), messages.sparkSession, output)


def until_stopped(query: StreamingQuery, spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """Waits for the query and leaves the final statistics below ``output``/final, however it ended."""
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    finally:
        written = write_final_statistics(spark, output)
    return written


def final_statistics(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The statistics of all micro-batches, from the tables that the job keeps: no message is read again.

    ``devices`` (active ones, in order), ``overall``, and ``attack_types``, one
    map per device and one overall.
    """
    counters = add_rates(with_overall(live_counters(spark, output)))
    attacks = sum_attack_types(attack_table(spark, output).state())
    return {
        "devices": active_devices(counters.where("scope = 'device'")),
        "overall": counters.where("scope = 'overall'"),
        "attack_types": attack_type_map(attacks),
    }


def write_final_statistics(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    written = {}
    for name, table in final_statistics(spark, output).items():
        table.write.mode("overwrite").parquet(f"{output}/final/{name}")
        written[name] = spark.read.schema(table.schema).parquet(f"{output}/final/{name}")
    return written


def statistics_report(
    results: DataFrame,
    order_by: list[str] | None = None,
    slice_by: Column | None = None,
    every: int = SNAPSHOT_EVERY,
) -> dict[str, DataFrame]:
    """The statistics tables over judged messages (the ``results`` table, or a part of it).

    With an order, samples are numbered by it anew; else their ``sample_id`` counts.
    ``snapshots`` are change rows: see ``statistics_changes``.
    """
    counters = add_rates(with_overall(device_counters(results)))
    numbered = results if order_by is None else number_samples(results.drop("sample_id"), order_by, slice_by)
    return {
        "devices": active_devices(counters.where("scope = 'device'")),
        "overall": counters.where("scope = 'overall'"),
        "attack_types": attack_type_map(attack_type_counts(results)),
        "snapshots": statistics_changes(stage(snapshot_counts(numbered, every), "snapshot-counts"), every),
    }


def recorded_snapshots(spark: SparkSession, output: str, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The snapshots that the job recorded, as change rows."""
    return live_snapshots(spark, output, every)


def record_slice(records: int = SLICE_RECORDS) -> Column:
    """Slices of bus records: it grows with (partition, offset)."""
    return F.col("partition").cast("long") * F.lit(1 << 40) + F.expr(f"offset div {int(records)}")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--brokers", required=True)
    parser.add_argument("--topic", required=True)
    parser.add_argument("--classifier", required=True, help="folder of a saved classifier package")
    parser.add_argument("--anomaly", help="folder of a saved anomaly package")
    parser.add_argument("--output", required=True, help="shared folder for results and state")
    parser.add_argument("--max-per-trigger", type=int, help="records per micro-batch")
    parser.add_argument(
        "--stats-interval", type=int, default=SNAPSHOT_EVERY, help="samples between two statistics snapshots"
    )
    parser.add_argument(
        "--slice-records", type=int, default=SLICE_RECORDS, help="records that one task orders of a busy device"
    )
    parser.add_argument("--expire-after", type=int, help="micro-batches after which a silent device is forgotten")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("flow-monitor").getOrCreate()
    stream = read_messages(
        spark, brokers=args.brokers, topic=args.topic, max_per_trigger=args.max_per_trigger
    )
    query = start_monitor(
        spark,
        stream,
        classifier=args.classifier,
        anomaly=args.anomaly,
        output=args.output,
        checkpoint=f"{args.output}/checkpoint",
        order_by=["partition", "offset"],
        slice_by=record_slice(args.slice_records),
        stats_interval=args.stats_interval,
        expire_after=args.expire_after,
    )
    for table in until_stopped(query, spark, args.output).values():
        table.show(truncate=False)


if __name__ == "__main__":
    main()
