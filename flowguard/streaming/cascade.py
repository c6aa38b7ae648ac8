"""The two-tier cascade over messages, as a batch job and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.anomaly import AnomalyParams, add_verdict, reconstruct
from ..operators.classify import ClassifierPackage, score
from ..operators.messages import parse_messages, rejected_messages, valid_messages
from ..operators.ordering import in_ranges, number_ranges
from ..operators.scaling import scale_features
from ..operators.sequences import SEQUENCE_LENGTH, newest_rows, rolling_sequences
from ..operators.stats import EVENTS, SNAPSHOT_EVERY, alerts
from ..operators.triage import CONFIDENCE_LIMIT, online_triage
from ..sources.packages import AnomalyPackage
from ..sources.paths import path_exists, remove_path, write_and_read
from .deltas import MERGE_AFTER, DeltaTable
from .live import Ledger, record_statistics

TRIGGER = "1 seconds"


@dataclass
class Tier1:
    """``score`` adds a ``probability`` array in the order of ``classes``."""

    classes: Sequence[str]
    score: Callable[[DataFrame], DataFrame]


@dataclass
class Tier2:
    """``vector`` turns message features into the model's input; ``rebuild`` adds ``rebuilt``."""

    vector: Callable[[Column], Column]
    rebuild: Callable[[DataFrame], DataFrame]
    params: AnomalyParams
    length: int = SEQUENCE_LENGTH


def first_tier(package: ClassifierPackage) -> Tier1:
    return Tier1(package.classes, lambda df: score(df, package, F.col("features")))


def second_tier(package: AnomalyPackage | None, message_columns: Sequence[str]) -> Tier2 | None:
    """The anomaly model on its own columns, picked by name out of the message's."""
    if package is None:
        return None
    at = [list(message_columns).index(c) for c in package.feature_columns]
    return Tier2(
        lambda features: scale_features(F.array(*[F.get(features, F.lit(i)) for i in at]), package.scaler),
        lambda df: reconstruct(df, package.model),
        package.params,
        package.sequence_length,
    )


def classify_messages(valid: DataFrame, tier1: Tier1, limit: float = CONFIDENCE_LIMIT) -> DataFrame:
    """Stateless part: triage of every valid message."""
    return online_triage(tier1.score(valid), tier1.classes, limit=limit)


def analyse_doubt(
    doubt: DataFrame,
    tier2: Tier2,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = ("device_id",),
    slice_by: Column | None = None,
) -> DataFrame:
    """Second tier over DOUBT rows that carry ``vector``: rolling sequence, reconstruction, verdict."""
    rows = rolling_sequences(
        doubt, keys, order_by, "vector", length=tier2.length, slice_by=slice_by
    )
    judged = add_verdict(tier2.rebuild(rows), tier2.params)
    return judged.drop("sequence", "rebuilt")


def run_cascade(
    triaged: DataFrame,
    tier2: Tier2 | None,
    order_by: Sequence[str],
    *,
    keys: Sequence[str] = ("device_id",),
    slice_by: Column | None = None,
) -> DataFrame:
    """All triaged rows with tier-2 columns, which stay NULL outside DOUBT.

    Both branches read ``triaged``: hand in a written or persisted table, so that
    scoring runs once.
    """
    certain = triaged.where(F.col("traffic_type") != "DOUBT")
    doubt = triaged.where(F.col("traffic_type") == "DOUBT")
    if tier2 is None:
        judged = add_verdict(doubt, None)
    else:
        judged = analyse_doubt(
            doubt.withColumn("vector", tier2.vector(F.col("features"))),
            tier2,
            order_by,
            keys=keys,
            slice_by=slice_by,
        ).drop("vector")
    return certain.unionByName(judged, allowMissingColumns=True)


def start_cascade(
    messages: DataFrame,
    tier1: Tier1,
    tier2: Tier2 | None,
    *,
    output: str,
    checkpoint: str,
    width: int | None = None,
    order_by: Sequence[str] = ("timestamp",),
    keys: Sequence[str] = ("device_id",),
    slice_by: Column | None = None,
    limit: float = CONFIDENCE_LIMIT,
    stats_interval: int = SNAPSHOT_EVERY,
    alert_on: Sequence[str] = tuple(EVENTS),
    merge_after: int = MERGE_AFTER,
    expire_after: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Runs the cascade over a message stream and returns the started query.

    Tables under ``output``, each with one folder per micro-batch: ``results``
    (every valid message, numbered over all devices in ``sample_id``),
    ``rejected``, ``alerts`` and ``snapshots``; and, as tables that a
    micro-batch adds its touched keys to, ``history`` (each device's newest
    DOUBT vectors), ``counters`` and ``attacks``. ``live`` reads them.

    A retried micro-batch rewrites its own folders from what was there before
    it, so each message counts once. One without messages writes nothing.
    Devices that were silent for more than ``expire_after`` micro-batches are
    forgotten: their sequences begin anew.

    Arrival order is the micro-batch first, then ``order_by`` (unique per key).
    An output folder with results of another run is refused: a new checkpoint
    counts micro-batches from 0 again and would mix both runs.
    """
    spark = messages.sparkSession
    if path_exists(spark, f"{output}/results") and not path_exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{output} has results of a run whose checkpoint is not {checkpoint}")
    order = ["_batch", *order_by]
    arrival = list(dict.fromkeys([*order_by, *keys]))
    carried = list(dict.fromkeys([*keys, *order, "vector"]))

    def process(batch: DataFrame, batch_id: int) -> None:
        session, work = batch.sparkSession, f"{output}/working/{batch_id}"
        # Cutting ranges reads what it cuts twice: the messages as they came, not the parsed ones. Rows equal
        # in ``order_by`` are in one range, so the order by ``arrival`` holds inside ranges and between them.
        parsed = write_and_read(parse_messages(in_ranges(batch, order_by), width), f"{work}/messages")
        # The counts that the numbering needs also tell whether there is anything to do.
        sizes = parsed.groupBy("_range").agg(F.count_if("is_valid")).collect()
        if sizes:
            ledger = Ledger(session, output)
            before = ledger.before(batch_id)
            rejected_messages(parsed).drop("_range").write.mode("overwrite").parquet(f"{output}/rejected/batch_id={batch_id}")
            valid = valid_messages(parsed).withColumn("_batch", F.lit(batch_id).cast("long"))
            numbered = number_ranges(valid, arrival, "sample_id", dict(sizes), start=before.samples)
            triaged = write_and_read(classify_messages(numbered, tier1, limit), f"{work}/triaged")
            judged = run_cascade(triaged, None, order) if tier2 is None else judge(triaged, batch_id)
            results = judged.drop("_batch")
            target = f"{output}/results/batch_id={batch_id}"
            results.write.mode("overwrite").parquet(target)
            written = session.read.schema(results.schema).parquet(target)
            alerts(written, alert_on).write.mode("overwrite").parquet(f"{output}/alerts/batch_id={batch_id}")
            after = record_statistics(
                written, output, batch_id, before, every=stats_interval, merge_after=merge_after, work=work
            )
            ledger.write(batch_id, after)
        remove_path(session, work)

    def newest(rows: DataFrame, batch_id: int) -> DataFrame:
        """Each device's newest vectors, unless it was silent for too long."""
        kept = newest_rows(rows, keys, order, tier2.length - 1)
        if expire_after is None:
            return kept
        last = F.max("_batch").over(Window.partitionBy(*keys))
        return kept.withColumn("_last", last).where(F.col("_last") >= batch_id - expire_after - 1).drop("_last")

    def judge(triaged: DataFrame, batch_id: int) -> DataFrame:
        doubt = triaged.where(F.col("traffic_type") == "DOUBT").withColumn(
            "vector", tier2.vector(F.col("features"))
        )
        own = doubt.select(*carried)
        history = DeltaTable(
            triaged.sparkSession, f"{output}/history", own.schema, keys, lambda rows: newest(rows, batch_id),
            merge_after=merge_after,
        )
        history.compact(batch_id)
        held = newest(history.lookup(own, batch_id), batch_id)
        history.append(batch_id, newest_rows(own, keys, order, tier2.length - 1))
        rows = doubt.withColumn("_new", F.lit(True)).unionByName(
            held.withColumn("_new", F.lit(False)), allowMissingColumns=True
        )
        # Carried rows only fill sequences: they are judged by no one twice.
        whole_slice = None if slice_by is None else F.struct(
            F.col("_batch").alias("batch"),
            F.when(F.col("_new"), slice_by).alias("part"),
        )
        sequenced = rolling_sequences(
            rows, keys, order, "vector", length=tier2.length, slice_by=whole_slice
        ).where("_new").drop("_new")
        judged = add_verdict(tier2.rebuild(sequenced), tier2.params).drop(
            "sequence", "rebuilt", "vector"
        )
        certain = triaged.where(F.col("traffic_type") != "DOUBT")
        return certain.unionByName(judged, allowMissingColumns=True)

    return (
        messages.writeStream.foreachBatch(process)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )
