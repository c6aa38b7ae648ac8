"""Triage, statistics and metrics over the scored fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.operators import metrics, ordering, stats, triage
from flowguard.sources.paths import stage

from .testmap import CLASSES, LINE_KEY, SCORES, rounded, scores, sql

_KEY = ", ".join(LINE_KEY)
_SCORED = f"""
scores AS ({sql(SCORES)}),
scored AS (
  SELECT *, greatest(p0, p1, p2, p3) AS conf, p2 + p3 AS attack_p,
    CASE WHEN p0 = greatest(p0, p1, p2, p3) THEN 'BENIGN' WHEN p1 = greatest(p0, p1, p2, p3) THEN 'DOUBT'
         WHEN p2 = greatest(p0, p1, p2, p3) THEN 'DoS' ELSE 'Malware' END AS cls
  FROM scores),
triaged AS (
  SELECT *,
    CASE WHEN cls = 'DOUBT' THEN 'DOUBT'
         WHEN cls = 'BENIGN' AND (conf < 0.7 OR (attack_p > 0.2 AND conf < 0.9)) THEN 'DOUBT'
         WHEN cls = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS traffic_type,
    CASE WHEN cls = 'BENIGN' AND (conf < 0.7 OR (attack_p > 0.2 AND conf < 0.9))
         THEN 'Suspicious BENIGN' ELSE cls END AS predicted_class
  FROM scored)
"""
_TRIAGE_A = f"""
{_SCORED},
train_triage AS (
  SELECT *, conf < 0.7 AS low_confidence, cls = 'DOUBT' AS doubt_class,
    cls = 'BENIGN' AND attack_p > 0.2 AND p0 < 0.9 AS suspicious_benign FROM scored)
"""

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


@query(
    "M3_confidence_argmax",
    f"""WITH {_SCORED} SELECT {_KEY}, cls AS predicted_class, round(conf, 6) AS confidence FROM scored""",
)
def confidence(spark, sf):
    rows = triage.add_prediction(scores(spark, sf), CLASSES)
    return rows.select(*LINE_KEY, "predicted_class", F.round("confidence", 6).alias("confidence"))


@query(
    "M4_attack_probability",
    f"""WITH {_SCORED} SELECT {_KEY}, round(attack_p, 6) AS attack_probability FROM scored""",
)
def attack_probability(spark, sf):
    rows = triage.add_prediction(scores(spark, sf), CLASSES)
    return rows.select(*LINE_KEY, F.round("attack_probability", 6).alias("attack_probability"))


@query(
    "M5_training_triage",
    f"""WITH {_TRIAGE_A} SELECT {_KEY}, low_confidence, doubt_class, suspicious_benign
    FROM train_triage WHERE low_confidence OR doubt_class OR suspicious_benign""",
)
def training_triage(spark, sf):
    rows = triage.uncertain_rows(triage.training_triage(scores(spark, sf), CLASSES))
    return rows.select(*LINE_KEY, "low_confidence", "doubt_class", "suspicious_benign")


@query(
    "M6_training_triage_summary",
    f"""WITH {_TRIAGE_A} SELECT count(*) AS total_rows,
      CAST(count(*) FILTER (low_confidence) AS BIGINT) AS low_confidence,
      CAST(count(*) FILTER (doubt_class) AS BIGINT) AS doubt_class,
      CAST(count(*) FILTER (suspicious_benign) AS BIGINT) AS suspicious_benign,
      CAST(count(*) FILTER (low_confidence OR doubt_class OR suspicious_benign) AS BIGINT) AS total_doubt,
      round(100.0::DOUBLE * count(*) FILTER (low_confidence OR doubt_class OR suspicious_benign) / count(*), 6)
        AS doubt_percent
    FROM train_triage""",
)
def training_summary(spark, sf):
    return rounded(triage.training_triage_summary(triage.training_triage(scores(spark, sf), CLASSES)))


@query(
    "M7_online_triage",
    f"""WITH {_SCORED} SELECT {_KEY}, device_id, traffic_type, predicted_class, round(conf, 6) AS confidence
    FROM triaged""",
)
def online_triage(spark, sf):
    rows = triage.online_triage(scores(spark, sf), CLASSES)
    return rows.select(
        *LINE_KEY, "device_id", "traffic_type", "predicted_class", F.round("confidence", 6).alias("confidence")
    )


@query(
    "M8_extract_uncertain",
    f"""WITH {_SCORED} SELECT {_KEY}, l_returnflag, device_id FROM scored
    WHERE cls = 'DOUBT' OR (cls = 'BENIGN' AND conf < 0.65)""",
)
def extract(spark, sf):
    return triage.extract_uncertain(scores(spark, sf), CLASSES)


@query(
    "P12_row_filter",
    f"""WITH {_TRIAGE_A} SELECT device_id, count(*) AS n FROM train_triage
    WHERE low_confidence OR doubt_class OR suspicious_benign GROUP BY device_id""",
)
def row_filter(spark, sf):
    rows = triage.uncertain_rows(triage.training_triage(scores(spark, sf), CLASSES))
    return rows.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M9_prediction_table",
    f"""WITH {_SCORED} SELECT {_KEY}, cls AS prediction, round(conf, 6) AS max_probability,
      round(p0, 6) AS "prob_BENIGN", round(p1, 6) AS "prob_DOUBT", round(p2, 6) AS "prob_DoS",
      round(p3, 6) AS "prob_Malware" FROM scored""",
)
def predictions(spark, sf):
    table = triage.prediction_table(scores(spark, sf), CLASSES, keep=LINE_KEY)
    probs = ["max_probability", *[f"prob_{c}" for c in CLASSES]]
    return table.select(*LINE_KEY, "prediction", *[F.round(c, 6).alias(c) for c in probs])


@query(
    "M10_prediction_summary",
    f"""WITH {_SCORED} SELECT cls AS prediction, count(*) AS count FROM scored GROUP BY cls""",
)
def prediction_summary(spark, sf):
    return triage.prediction_summary(triage.prediction_table(scores(spark, sf), CLASSES))


# --- metrics: actual class from the return flag, predicted from the scores ---

_ACTUAL = "CASE l_returnflag WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'DoS' WHEN 'R' THEN 'Malware' END"
_CONFUSION = f"""{_SCORED},
pairs AS (SELECT {_ACTUAL} AS actual, cls AS predicted, p0, p1, p2, p3, l_linenumber FROM scored),
classes AS (SELECT unnest(['BENIGN', 'DOUBT', 'DoS', 'Malware']) AS class),
ratios AS (
  SELECT c.class,
    (SELECT count(*) FROM pairs WHERE actual = c.class) AS support,
    (SELECT count(*) FROM pairs WHERE predicted = c.class) AS called,
    (SELECT count(*) FROM pairs WHERE predicted = c.class AND actual = c.class) AS hit
  FROM classes c),
pr AS (SELECT class, support, coalesce(hit / nullif(called, 0), 0)::DOUBLE AS precision,
  coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall FROM ratios),
report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM pr)
"""


def scored_pairs(spark, sf):
    rows = triage.add_prediction(scores(spark, sf), CLASSES)
    return rows.select(
        F.expr(_ACTUAL).alias("actual"),
        F.col("predicted_class").alias("predicted"),
        "probability",
        (F.col("l_linenumber") % 2 == 0).alias("even"),
    )


@query(
    "M11_overall_metrics",
    f"""WITH {_CONFUSION} SELECT
      round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM pairs), 6) AS accuracy,
      round(sum(precision * support) / sum(support), 6) AS precision,
      round(sum(recall * support) / sum(support), 6) AS recall,
      round(sum(f1 * support) / sum(support), 6) AS f1 FROM report""",
)
def overall(spark, sf):
    return rounded(metrics.overall_metrics(metrics.confusion_counts(scored_pairs(spark, sf)), CLASSES))


@query(
    "M12_class_report",
    f"""WITH {_CONFUSION}
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
      FROM report
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
      CAST(sum(support) AS BIGINT) FROM report
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      CAST(sum(support) AS BIGINT) FROM report""",
)
def report(spark, sf):
    counts = metrics.confusion_counts(scored_pairs(spark, sf))
    return rounded(metrics.classification_report(counts, CLASSES))


@query(
    "M13_confusion_matrix",
    f"""WITH {_CONFUSION} SELECT c.class AS actual,
      count(*) FILTER (predicted = 'BENIGN') AS "BENIGN", count(*) FILTER (predicted = 'DOUBT') AS "DOUBT",
      count(*) FILTER (predicted = 'DoS') AS "DoS", count(*) FILTER (predicted = 'Malware') AS "Malware"
    FROM classes c LEFT JOIN pairs p ON p.actual = c.class GROUP BY c.class""",
)
def confusion(spark, sf):
    return metrics.confusion_matrix(metrics.confusion_counts(scored_pairs(spark, sf)), CLASSES)


@query(
    "V6_confusion_cells",
    f"""WITH {_CONFUSION} SELECT a.class AS actual, b.class AS predicted, count(p.actual) AS n
    FROM classes a CROSS JOIN classes b
    LEFT JOIN pairs p ON p.actual = a.class AND p.predicted = b.class GROUP BY a.class, b.class""",
)
def cells(spark, sf):
    return metrics.confusion_cells(metrics.confusion_counts(scored_pairs(spark, sf)), CLASSES)


@query(
    "M15_log_loss",
    f"""WITH {_CONFUSION} SELECT l_linenumber % 2 = 0 AS even, count(*) AS n,
      round(avg(-ln(greatest(CASE actual WHEN 'BENIGN' THEN p0 WHEN 'DoS' THEN p2 ELSE p3 END, 1e-15))), 6)
        AS log_loss
    FROM pairs GROUP BY 1""",
)
def log_loss(spark, sf):
    return rounded(metrics.log_loss(scored_pairs(spark, sf), CLASSES, by=["even"]))


# --- statistics ---


def triaged(spark, sf):
    rows = triage.online_triage(scores(spark, sf), CLASSES)
    return rows.select("device_id", "traffic_type", "predicted_class", "confidence", *LINE_KEY)


_COUNTS = """count(*) AS total, count(*) FILTER (traffic_type = 'BENIGN') AS benign,
  count(*) FILTER (traffic_type = 'ATTACK') AS attack, count(*) FILTER (traffic_type = 'DOUBT') AS doubt"""


@query("ST4_device_counters", f"WITH {_SCORED} SELECT device_id, {_COUNTS} FROM triaged GROUP BY device_id")
def device_counters(spark, sf):
    return stats.device_counters(triaged(spark, sf))


@query(
    "ST5_overall_counters",
    f"""WITH {_SCORED} SELECT CASE WHEN grouping(device_id) = 1 THEN 'overall' ELSE 'device' END AS scope,
      device_id, {_COUNTS} FROM triaged GROUP BY ROLLUP (device_id)""",
)
def overall_counters(spark, sf):
    return stats.with_overall(stats.device_counters(triaged(spark, sf)))


@query(
    "ST6_attack_types",
    f"""WITH {_SCORED} SELECT CASE WHEN grouping(device_id) = 1 THEN 'overall' ELSE 'device' END AS scope,
      device_id, predicted_class, count(*) AS n FROM triaged WHERE traffic_type = 'ATTACK'
      GROUP BY GROUPING SETS ((device_id, predicted_class), (predicted_class))""",
)
def attack_types(spark, sf):
    return stats.attack_type_counts(triaged(spark, sf))


@query(
    "ST6_attack_type_map",
    f"""WITH {_SCORED} SELECT CASE WHEN grouping(device_id) = 1 THEN 'overall' ELSE 'device' END AS scope,
      device_id, count(*) FILTER (predicted_class = 'DoS') AS dos,
      count(*) FILTER (predicted_class = 'Malware') AS malware FROM triaged WHERE traffic_type = 'ATTACK'
      GROUP BY ROLLUP (device_id)""",
)
def attack_map(spark, sf):
    maps = stats.attack_type_map(stats.attack_type_counts(triaged(spark, sf)))
    return maps.select(
        "scope",
        "device_id",
        *[F.coalesce(F.try_element_at("attack_types", F.lit(c)), F.lit(0)).alias(c.lower()) for c in ("DoS", "Malware")],
    )


@query(
    "ST8_rates",
    f"""WITH {_SCORED}, c AS (SELECT CASE WHEN grouping(device_id) = 1 THEN 'overall' ELSE 'device' END AS scope,
      device_id, {_COUNTS} FROM triaged GROUP BY ROLLUP (device_id))
    SELECT *, round(benign * 100.0::DOUBLE / total, 6) AS benign_percent,
      round(attack * 100.0::DOUBLE / total, 6) AS attack_percent,
      round(doubt * 100.0::DOUBLE / total, 6) AS doubt_percent FROM c""",
)
def rates(spark, sf):
    return rounded(stats.add_rates(stats.with_overall(stats.device_counters(triaged(spark, sf)))))


@query(
    "ST9_active_devices",
    f"WITH {_SCORED} SELECT device_id, {_COUNTS} FROM triaged GROUP BY device_id ORDER BY device_id",
)
def active(spark, sf):
    return stats.active_devices(stats.device_counters(triaged(spark, sf)))


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_shipdate"]


def numbered(spark, sf):
    # Order keys grow with the order, so runs of them are its slices.
    return stats.number_samples(
        triaged(spark, sf), _ORDER, F.floor(F.col("l_orderkey") / 1024).cast("long")
    )


@query(
    "ST3_sample_numbers",
    f"""WITH {_SCORED} SELECT {_KEY}, row_number() OVER (ORDER BY {', '.join(_ORDER)}) AS sample_id FROM triaged""",
)
def sample_numbers(spark, sf):
    return numbered(spark, sf).select(*LINE_KEY, "sample_id")


_SNAPSHOT = 500


@query(
    "ST10_snapshots",
    f"""WITH {_SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDER)}) AS sample_id FROM triaged),
    parts AS (SELECT (sample_id + {_SNAPSHOT - 1}) // {_SNAPSHOT} AS shot, device_id, {_COUNTS} FROM n GROUP BY 1, 2),
    shots AS (SELECT unnest(range(1, (SELECT max(sample_id) // {_SNAPSHOT} FROM n) + 1)) AS shot),
    dense AS (SELECT s.shot, d.device_id, coalesce(p.total, 0) AS total, coalesce(p.benign, 0) AS benign,
        coalesce(p.attack, 0) AS attack, coalesce(p.doubt, 0) AS doubt
      FROM shots s CROSS JOIN (SELECT DISTINCT device_id FROM n) d
      LEFT JOIN parts p ON p.shot = s.shot AND p.device_id = d.device_id),
    per_device AS (SELECT shot, device_id, sum(total) OVER w AS total, sum(benign) OVER w AS benign,
        sum(attack) OVER w AS attack, sum(doubt) OVER w AS doubt
      FROM dense WINDOW w AS (PARTITION BY device_id ORDER BY shot))
    SELECT CAST(shot * {_SNAPSHOT} AS BIGINT) AS at_sample, 'device' AS scope, device_id,
      CAST(total AS BIGINT) AS total, CAST(benign AS BIGINT) AS benign, CAST(attack AS BIGINT) AS attack,
      CAST(doubt AS BIGINT) AS doubt FROM per_device WHERE total > 0
    UNION ALL SELECT CAST(shot * {_SNAPSHOT} AS BIGINT), 'overall', NULL, CAST(sum(total) AS BIGINT),
      CAST(sum(benign) AS BIGINT), CAST(sum(attack) AS BIGINT), CAST(sum(doubt) AS BIGINT)
      FROM per_device GROUP BY shot""",
)
def snapshots(spark, sf):
    """Dense snapshots after every 500th sample, looked up in the changes of every 25th."""
    counts = stage(stats.snapshot_counts(numbered(spark, sf)), "snapshot-counts")
    last = counts.agg(F.sum("total")).first()[0] // _SNAPSHOT
    at = [_SNAPSHOT * k for k in range(1, last + 1)]
    return stats.snapshots_at(stats.statistics_changes(counts), at)
