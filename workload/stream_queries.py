"""Streaming jobs, replayed from files written from the test tables.

Messages arrive in three deliveries, by event number modulo three, so arrival
order differs from event time. The stream is stopped and restarted between
deliveries, from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.bounded import compute_once
from flowguard.functions.numbers import clip, sanitise
from flowguard.functions.vectors import rebuild_by_mean
from flowguard.operators import messages, ordering, stats
from flowguard.operators.anomaly import AnomalyParams
from flowguard.plans import monitor
from flowguard.sources.bus import MESSAGE_SCHEMA, read_messages
from flowguard.sources.paths import children, stage, work_folder
from flowguard.streaming import live
from flowguard.streaming.cascade import Tier1, Tier2, classify_messages, run_cascade, start_cascade
from flowguard.streaming.live import live_snapshots, start_live_counters
from flowguard.streaming.rolling import rolling_sequence_stream

from .testmap import rounded, sql, view

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


CLASSES = ["BENIGN", "DOUBT", "DoS"]
WIDTH = 3
LIVE = (
    "events",
    [
        "CASE WHEN user_id % 40 = 1 THEN NULL WHEN user_id % 25 = 0 THEN '' "
        "ELSE CAST(user_id AS VARCHAR(20)) END AS device_id",
        "CASE WHEN event_id % 77 = 0 THEN NULL "
        "WHEN event_id % 73 = 0 THEN concat_ws(',', CAST(value AS VARCHAR(40)), '1') "
        "ELSE concat_ws(',', CAST(value AS VARCHAR(40)), "
        "CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(user_id % 10 AS VARCHAR(20)) END, "
        "CAST(event_id % 7 AS VARCHAR(20))) END AS csv_data",
        "ts AS timestamp",
        "event_id",
    ],
)
# Scores from the three fields: linear in the value, the user digit, the event digit.
_SCORE = ["{0} * 2 + 5", "({1}) * 12 + 1", "({2}) * 30 + 1"]
_CENTRE, _SPREAD, _THRESHOLD = 40.0, 19.0, 1.51


def deliveries(spark, sf, source=LIVE):
    rows = view(spark, sf, source).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return [rows.where(F.col("event_id") % 3 == i) for i in range(3)]


def schema():
    return T.StructType([*MESSAGE_SCHEMA.fields, T.StructField("event_id", T.LongType())])


def fixture_scores(valid):
    raw = [F.expr(e.format("get(features, 0)", "get(features, 1)", "get(features, 2)")) for e in _SCORE]
    total = raw[0] + raw[1] + raw[2]
    return valid.withColumn("probability", compute_once(F.array(*[r / total for r in raw])))


TIER1 = Tier1(CLASSES, fixture_scores)
TIER2 = Tier2(
    lambda features: F.array(clip((sanitise(F.get(features, F.lit(0))) - _CENTRE) / _SPREAD, -5.0, 5.0)),
    lambda df: df.withColumn("rebuilt", rebuild_by_mean(F.col("sequence"))),
    AnomalyParams(_THRESHOLD, 0.0, 1.0),
)
ORDER = ["timestamp", "event_id"]
TEN_DAYS = 10 * 24 * 3600


def replay(spark, sf, start, source=LIVE):
    """Delivers the parts one by one, running ``start(stream)`` to the end after each."""
    inbox = work_folder(spark, "inbox")
    for part in deliveries(spark, sf, source):
        part.write.mode("append").parquet(inbox)
        running = start(read_messages(spark, "parquet", path=inbox, schema=schema()))
        running.awaitTermination()


def cascade_output(spark, sf, source=LIVE, **options):
    out = work_folder(spark, "cascade")

    def start(stream):
        return start_cascade(
            stream,
            TIER1,
            TIER2,
            output=out,
            checkpoint=f"{out}/checkpoint",
            width=WIDTH,
            order_by=ORDER,
            slice_by=ordering.time_slice(F.col("timestamp"), TEN_DAYS),
            trigger={"availableNow": True},
            **options,
        )

    replay(spark, sf, start, source)
    return out


_RAW = [e.format("f[1]", "f[2]", "f[3]") for e in _SCORE]
_LIVE = f"""m AS ({sql(LIVE)}),
fields AS (SELECT *, coalesce(nullif(device_id, ''), 'unknown') AS device, event_id % 3 AS batch,
    list_transform(str_split(csv_data, ','), lambda x: try_cast(x AS DOUBLE)) AS f FROM m),
ok AS (SELECT * FROM fields WHERE len(f) = 3 AND len(list_filter(f, lambda x: x IS NULL)) = 0),
scored AS (SELECT *, ({_RAW[0]}) / t AS p0, ({_RAW[1]}) / t AS p1, ({_RAW[2]}) / t AS p2
  FROM (SELECT *, ({_RAW[0]}) + ({_RAW[1]}) + ({_RAW[2]}) AS t FROM ok)),
cls AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 = greatest(p0, p1, p2) THEN 'BENIGN'
    WHEN p1 = greatest(p0, p1, p2) THEN 'DOUBT' ELSE 'DoS' END AS c FROM scored),
triaged AS (SELECT *, CASE WHEN c = 'DOUBT' THEN 'DOUBT'
    WHEN c = 'BENIGN' AND (conf < 0.7 OR (p2 > 0.2 AND conf < 0.9)) THEN 'DOUBT'
    WHEN c = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS traffic_type,
    CASE WHEN c = 'BENIGN' AND (conf < 0.7 OR (p2 > 0.2 AND conf < 0.9)) THEN 'Suspicious BENIGN' ELSE c END
      AS predicted_class FROM cls),
doubt AS (SELECT *, greatest(-5, least(5, (f[1] - {_CENTRE}) / {_SPREAD})) AS v FROM triaged WHERE traffic_type = 'DOUBT'),
recent AS (SELECT *, list(v) OVER (PARTITION BY device ORDER BY batch, timestamp, event_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r FROM doubt),
padded AS (SELECT *, list_concat(list_transform(range(10 - len(r)), lambda i: v), r) AS s FROM recent),
measured AS (SELECT event_id, greatest(1e-10, list_avg(list_transform(s, lambda x: (x - list_avg(s)) * (x - list_avg(s)))))
    AS mse FROM padded),
judged AS (SELECT t.*, mse, CASE WHEN mse IS NULL THEN NULL WHEN mse > {_THRESHOLD} THEN 'ANOMALY' ELSE 'BENIGN' END
    AS tier2_status,
    CASE WHEN mse / {_THRESHOLD} > 10 THEN least(100, 10 + log10(mse / {_THRESHOLD} - 9)) ELSE mse / {_THRESHOLD} END
    AS score FROM triaged t LEFT JOIN measured USING (event_id))"""
_RESULT = """SELECT device AS device_id, event_id, traffic_type, predicted_class, round(conf, 6) AS confidence,
  tier2_status, round(mse, 6) AS reconstruction_error, round(score, 6) AS anomaly_score FROM judged"""


def result_columns(results):
    return results.select(
        "device_id",
        "event_id",
        "traffic_type",
        "predicted_class",
        F.round("confidence", 6).alias("confidence"),
        "tier2_status",
        F.round("tier2_detail.reconstruction_error", 6).alias("reconstruction_error"),
        F.round("tier2_detail.anomaly_score", 6).alias("anomaly_score"),
    )


@query(
    "S4_message_source",
    f"WITH {_LIVE} SELECT device_id, count(*) AS n, count(csv_data) AS with_text FROM m GROUP BY device_id",
)
def message_source(spark, sf):
    """Messages as the source gives them, over a restart; files stand in for the bus."""
    out = work_folder(spark, "source")

    def start(stream):
        return (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{out}/rows")
        )

    replay(spark, sf, start)
    return spark.read.parquet(f"{out}/rows").groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("csv_data").alias("with_text")
    )


@query("ST2_cascade_stream", f"WITH {_LIVE} {_RESULT}")
def cascade_stream(spark, sf):
    return result_columns(spark.read.parquet(f"{cascade_output(spark, sf)}/results"))


def batch_cascade(spark, sf):
    """The same cascade over all messages at once, in the same arrival order."""
    rows = view(spark, sf, LIVE).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    valid = messages.valid_messages(messages.parse_messages(rows, WIDTH))
    triaged = classify_messages(valid.withColumn("delivery", F.col("event_id") % 3), TIER1)
    # Both branches of the cascade read the scored messages.
    triaged = stage(triaged, "triaged")
    part = F.col("delivery") * 10**6 + ordering.time_slice(F.col("timestamp"), TEN_DAYS)
    return run_cascade(triaged, TIER2, ["delivery", *ORDER], slice_by=part)


@query("ST2_cascade_batch", f"WITH {_LIVE} {_RESULT}")
def cascade_batch(spark, sf):
    return result_columns(batch_cascade(spark, sf))


_NUMBERED = f"""{_LIVE}, numbered AS (SELECT *, row_number() OVER (ORDER BY batch, timestamp, event_id) AS sample_id FROM judged)"""
_ALERTS = f"""WITH {_NUMBERED} SELECT sample_id, device AS device_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN traffic_type = 'ATTACK' OR tier2_status = 'ANOMALY' THEN 'ALERT' ELSE 'INFO' END AS level,
  CASE WHEN traffic_type = 'BENIGN' THEN 'benign' WHEN traffic_type = 'ATTACK' THEN 'attack'
    WHEN tier2_status = 'ANOMALY' THEN 'confirmed_anomaly' ELSE 'confirmed_benign' END AS event,
  CASE WHEN traffic_type = 'ATTACK' THEN predicted_class END AS attack_class, round(conf, 6) AS confidence,
  round(mse, 6) AS reconstruction_error, CASE WHEN mse IS NOT NULL THEN {_THRESHOLD}::DOUBLE END AS threshold,
  round(score, 6) AS anomaly_score, CASE WHEN mse IS NOT NULL THEN 'standard' END AS model_type FROM numbered"""


def alert_columns(rows):
    """All columns of an alert; figures rounded for comparison."""
    return rounded(rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


@query("ST11_alerts", _ALERTS)
def alerts(spark, sf):
    """One structured alert per judged message, in batch."""
    part = F.col("delivery") * 10**6 + ordering.time_slice(F.col("timestamp"), TEN_DAYS)
    # Numbering reads the judged messages twice.
    judged = stage(batch_cascade(spark, sf), "judged")
    return alert_columns(stats.alerts(stats.number_samples(judged, ["delivery", *ORDER], part)))


@query("ST11_alert_sink", _ALERTS)
def alert_sink(spark, sf):
    """The alerts that the stream has written, with its live numbers."""
    rows = spark.read.parquet(f"{cascade_output(spark, sf)}/alerts")
    return alert_columns(rows.drop("batch_id"))


@query(
    "ST3_live_numbers",
    f"WITH {_NUMBERED} SELECT event_id, device AS device_id, sample_id FROM numbered",
)
def live_numbers(spark, sf):
    """The number that each result of the stream carries, over restarts."""
    return spark.read.parquet(f"{cascade_output(spark, sf)}/results").select("event_id", "device_id", "sample_id")


def _changes_sql(with_rows: str, every: int) -> str:
    """Change rows of all complete snapshots over ``numbered`` rows."""
    names = ["total", "benign", "attack", "doubt", "analysed", "confirmed_anomaly", "confirmed_benign", "tier2_errors"]
    tests = ["true", "traffic_type = 'BENIGN'", "traffic_type = 'ATTACK'", "traffic_type = 'DOUBT'",
             "tier2_status IN ('ANOMALY', 'BENIGN')", "tier2_status = 'ANOMALY'", "tier2_status = 'BENIGN'", "tier2_status = 'ERROR'"]
    counted = ", ".join(f"count(*) FILTER ({t}) AS {n}" for n, t in zip(names, tests))
    running = ", ".join(f"CAST(sum({n}) OVER w AS BIGINT) AS {n}" for n in names)
    return f"""WITH {with_rows},
    shots AS (SELECT (sample_id + {every - 1}) // {every} AS shot, device AS device_id, traffic_type, tier2_status FROM numbered
      WHERE (sample_id + {every - 1}) // {every} <= (SELECT max(sample_id) // {every} FROM numbered)),
    parts AS (SELECT 'device' AS scope, device_id, shot, {counted} FROM shots GROUP BY ALL
      UNION ALL SELECT 'overall', NULL, shot, {counted} FROM shots GROUP BY shot)
    SELECT scope, device_id, shot * {every} AS valid_from, lead(shot) OVER w * {every} AS valid_to, {running}
    FROM parts WINDOW w AS (PARTITION BY scope, device_id ORDER BY shot)"""


@query("ST10_snapshot_changes", _changes_sql(_NUMBERED, 25))
def snapshot_changes(spark, sf):
    """Change rows of the snapshots after every 25th sample, in batch."""
    part = F.col("delivery") * 10**6 + ordering.time_slice(F.col("timestamp"), TEN_DAYS)
    judged = stage(batch_cascade(spark, sf), "judged")
    numbered = stats.number_samples(judged, ["delivery", *ORDER], part)
    return stats.statistics_changes(stage(stats.snapshot_counts(numbered), "snapshot-counts"))


@query("ST10_live_snapshots", _changes_sql(_NUMBERED, 25))
def recorded_snapshots(spark, sf):
    """Change rows that the stream has recorded over its restarts."""
    return live_snapshots(spark, cascade_output(spark, sf))


@query(
    "ST12_monitor_job",
    f"""WITH {_LIVE}, c AS (SELECT CASE WHEN grouping(device) = 1 THEN 'overall' ELSE 'device' END AS scope, device AS device_id,
      count(*) AS total, count(*) FILTER (traffic_type = 'BENIGN') AS benign, count(*) FILTER (traffic_type = 'ATTACK') AS attack,
      count(*) FILTER (traffic_type = 'DOUBT') AS doubt, count(tier2_status) AS analysed,
      count(*) FILTER (tier2_status = 'ANOMALY') AS confirmed_anomaly, count(*) FILTER (tier2_status = 'BENIGN') AS confirmed_benign,
      CAST(0 AS BIGINT) AS tier2_errors, count(*) FILTER (predicted_class = 'DoS' AND traffic_type = 'ATTACK') AS dos
      FROM judged GROUP BY ROLLUP (device))
    SELECT *, round(100.0::DOUBLE * benign / total, 6) AS benign_percent, round(100.0::DOUBLE * attack / total, 6) AS attack_percent,
      round(100.0::DOUBLE * doubt / total, 6) AS doubt_percent,
      CASE WHEN analysed > 0 THEN round(100.0::DOUBLE * confirmed_anomaly / analysed, 6) END AS anomaly_rate,
      CASE WHEN analysed > 0 THEN 100.0::DOUBLE END AS success_rate FROM c""",
)
def monitor_job(spark, sf):
    """The job over three deliveries, stopped and restarted, and the final statistics that it leaves."""
    out = work_folder(spark, "monitor")
    inbox = work_folder(spark, "inbox")
    for part in deliveries(spark, sf):
        part.write.mode("append").parquet(inbox)
        final = monitor.monitor_until_stopped(
            read_messages(spark, "parquet", path=inbox, schema=schema()), TIER1, TIER2, output=out,
            checkpoint=f"{out}/checkpoint", width=WIDTH, order_by=ORDER,
            slice_by=ordering.time_slice(F.col("timestamp"), TEN_DAYS), trigger={"availableNow": True},
        )
    counters = final["devices"].unionByName(final["overall"])
    dos = final["attack_types"].select(
        F.col("scope").alias("s"), F.col("device_id").alias("d"), F.try_element_at("attack_types", F.lit("DoS")).alias("dos")
    )
    same = (F.col("scope") == F.col("s")) & F.col("device_id").eqNullSafe(F.col("d"))
    return rounded(counters.join(dos, same, "left").withColumn("dos", F.coalesce("dos", F.lit(0))).drop("s", "d"))


@query(
    "P13_empty_batches",
    f"WITH {_LIVE} SELECT 3 AS batches, (SELECT count(*) FROM ok) AS results, (SELECT max(batch) FROM ok) = 2 AS numbered_through",
)
def empty_batches(spark, sf):
    """Deliveries with an empty one between each two: only those with messages leave anything."""
    out, inbox = work_folder(spark, "empty"), work_folder(spark, "inbox")
    parts = deliveries(spark, sf)
    for part in (parts[0], parts[0].limit(0), parts[1], parts[1].limit(0), parts[2]):
        part.coalesce(1).write.mode("append").parquet(inbox)
        start_cascade(
            read_messages(spark, "parquet", path=inbox, schema=schema()), TIER1, TIER2, output=out,
            checkpoint=f"{out}/checkpoint", width=WIDTH, order_by=ORDER, trigger={"availableNow": True},
        ).awaitTermination()
    written = {f: children(spark, f"{out}/{f}") for f in ("results", "rejected", "alerts", "snapshots")}
    numbers = [len([n for n in names if n.startswith("batch_id=")]) for names in written.values()]
    batches = numbers[0] if len(set(numbers)) == 1 and len(children(spark, f"{out}/ledger")) == numbers[0] else -1
    return spark.read.parquet(f"{out}/results").agg(
        F.lit(batches).alias("batches"),
        F.count(F.lit(1)).alias("results"),
        ((F.max("sample_id") == F.count(F.lit(1))) & (F.countDistinct("sample_id") == F.count(F.lit(1)))).alias("numbered_through"),
    )


_HOT = (LIVE[0], [c.replace("CASE WHEN user_id % 40 = 1", "CASE WHEN event_id % 11 < 4 THEN 'hot' WHEN user_id % 40 = 1") for c in LIVE[1]])


@query("ST2_hot_device_stream", f"WITH {_LIVE.replace(sql(LIVE), sql(_HOT))} {_RESULT}")
def hot_device_stream(spark, sf):
    """The cascade where one device sends a third of all messages, with merges of the history between."""
    return result_columns(spark.read.parquet(f"{cascade_output(spark, sf, _HOT, merge_after=1)}/results"))


@query(
    "S7_stream_sinks",
    f"""WITH {_LIVE} SELECT 'results' AS sink, device AS device_id, count(*) AS n FROM ok GROUP BY device
    UNION ALL SELECT 'rejected', device, count(*) FROM fields
      WHERE event_id NOT IN (SELECT event_id FROM ok) GROUP BY device""",
)
def sinks(spark, sf):
    out = cascade_output(spark, sf)
    parts = [spark.read.parquet(f"{out}/{s}").select(F.lit(s).alias("sink"), "device_id") for s in ("results", "rejected")]
    return parts[0].unionByName(parts[1]).groupBy("sink", "device_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ST1_rolling_stream",
    f"""WITH {_LIVE}, v AS (SELECT *, f[1] AS v1 FROM ok),
    r AS (SELECT *, list(v1) OVER (PARTITION BY device ORDER BY batch, timestamp, event_id
      ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r,
      row_number() OVER (PARTITION BY device ORDER BY batch, timestamp, event_id) AS device_sample_no FROM v)
    SELECT device AS device_id, event_id, device_sample_no,
      round(list_sum(r) + (10 - len(r)) * v1, 6) AS total, round(CASE WHEN len(r) = 10 THEN r[1] ELSE v1 END, 6) AS oldest
    FROM r""",
)
def rolling_stream(spark, sf):
    """Keyed state: each device's last vectors, kept across restarts."""
    out = work_folder(spark, "rolling")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start(stream):
        valid = messages.valid_messages(messages.parse_messages(stream, WIDTH))
        rows = rolling_sequence_stream(
            valid.withColumn("vector", F.array(F.get("features", F.lit(0)))), order_by=ORDER
        )
        return (
            rows.writeStream.format("parquet")
            .option("checkpointLocation", f"{out}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start(f"{out}/rows")
        )

    try:
        replay(spark, sf, start)
    finally:
        spark.conf.set(provider, before)
    flat = F.flatten("sequence")
    return rounded(
        spark.read.parquet(f"{out}/rows").select(
            "device_id",
            "event_id",
            "device_sample_no",
            F.aggregate(flat, F.lit(0.0), lambda s, v: s + v).alias("total"),
            flat[0].alias("oldest"),
        )
    )


@query(
    "ST4_live_counters",
    f"""WITH {_LIVE} SELECT device AS device_id, count(*) AS total, count(*) FILTER (traffic_type = 'BENIGN') AS benign,
      count(*) FILTER (traffic_type = 'ATTACK') AS attack, count(*) FILTER (traffic_type = 'DOUBT') AS doubt
    FROM triaged GROUP BY device""",
)
def live_counters(spark, sf):
    """Increments of a triaged stream in tables, with merges between; a repeated micro-batch counts once."""
    out = work_folder(spark, "live")
    inbox = work_folder(spark, "inbox")
    for part in deliveries(spark, sf):
        part.write.mode("append").parquet(inbox)
    stream = read_messages(spark, "parquet", path=inbox, schema=schema(), max_per_trigger=1)
    triaged = classify_messages(messages.valid_messages(messages.parse_messages(stream, WIDTH)), TIER1)
    for _ in range(2):  # the second run is started from scratch and repeats all micro-batches
        start_live_counters(
            triaged, output=out, checkpoint=work_folder(spark, "live-checkpoint"), trigger={"availableNow": True}, merge_after=2
        ).awaitTermination()
    return live.live_counters(spark, out, tuple(stats.COUNTERS))
