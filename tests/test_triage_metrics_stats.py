import re

import pytest
from pyspark.sql import functions as F

from flowguard.functions.bounded import small_table
from flowguard.operators import metrics, ordering, stats, triage
from flowguard.sources.paths import write_and_read

CLASSES = ["BENIGN", "DOUBT", "DoS"]


def scored(spark, probabilities):
    return spark.createDataFrame([(i, p) for i, p in enumerate(probabilities)], "i int, probability array<double>")


# Strict limits: exactly 0.7, 0.9 and 0.2 are not yet doubtful.
CASES = [
    ([0.7, 0.1, 0.2], "BENIGN", False),
    ([0.69, 0.31, 0.0], "DOUBT", True),
    ([0.75, 0.0, 0.25], "DOUBT", True),
    ([0.9, 0.0, 0.1], "BENIGN", False),
    ([0.1, 0.8, 0.1], "DOUBT", True),
    ([0.2, 0.3, 0.5], "ATTACK", True),
    ([0.1, 0.1, 0.8], "ATTACK", False),
    ([0.4, 0.2, 0.4], "DOUBT", True),
]


def test_policies_differ_where_they_should(spark):
    df = scored(spark, [c[0] for c in CASES])
    online = [r.traffic_type for r in triage.online_triage(df, CLASSES).orderBy("i").collect()]
    training = [r.is_doubt for r in triage.training_triage(df, CLASSES).orderBy("i").collect()]
    assert online == [c[1] for c in CASES]
    assert training == [c[2] for c in CASES]
    kept = [r.i for r in triage.extract_uncertain(df, CLASSES).orderBy("i").collect()]
    assert kept == [4, 7]


def test_no_attack_class_means_no_suspicion(spark):
    df = scored(spark, [[0.6, 0.4]])
    assert triage.online_triage(df, ["BENIGN", "DOUBT"]).first().traffic_type == "BENIGN"
    assert triage.training_triage(df, ["BENIGN", "DOUBT"]).first().suspicious_benign is False


def test_suspicious_name(spark):
    assert triage.online_triage(scored(spark, [[0.6, 0.0, 0.4]]), CLASSES).first().predicted_class == "Suspicious BENIGN"


def test_summary_of_nothing(spark):
    empty = scored(spark, [[1.0, 0.0, 0.0]]).limit(0)
    row = triage.training_triage_summary(triage.training_triage(empty, CLASSES)).first()
    assert row.total_doubt == 0 and row.doubt_percent is None


def test_report_covers_the_whole_class_list(spark):
    pairs = [("BENIGN", "BENIGN")] * 6 + [("BENIGN", "DOUBT")] * 2 + [("DoS", "BENIGN")] * 2
    df = spark.createDataFrame(pairs, "actual string, predicted string")
    counts = metrics.confusion_counts(df)
    report = {r["class"]: r for r in metrics.class_report(counts, CLASSES).collect()}
    assert (report["BENIGN"].precision, report["BENIGN"].recall) == (0.75, 0.75)
    assert (report["DOUBT"].precision, report["DOUBT"].recall, report["DOUBT"].support) == (0.0, 0.0, 0)
    assert (report["DoS"].precision, report["DoS"].f1, report["DoS"].support) == (0.0, 0.0, 2)
    overall = metrics.overall_metrics(counts, CLASSES).first()
    assert overall.accuracy == 0.6 and overall.recall == pytest.approx(0.6)
    matrix = {r.actual: (r.BENIGN, r.DOUBT, r.DoS) for r in metrics.confusion_matrix(counts, CLASSES).collect()}
    assert matrix == {"BENIGN": (6, 2, 0), "DOUBT": (0, 0, 0), "DoS": (2, 0, 0)}


def test_log_loss_floor_and_unknown_class(spark):
    df = spark.createDataFrame(
        [("DoS", [1.0, 0.0, 0.0]), ("other", [1.0, 0.0, 0.0])], "actual string, probability array<double>"
    )
    row = metrics.log_loss(df, CLASSES).first()
    assert row.log_loss == pytest.approx(34.538776) and row.n == 1


def triaged(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, device_id string, traffic_type string, predicted_class string, tier2_status string")


ROWS = [
    (1, "a", "BENIGN", "BENIGN", None),
    (2, "b", "ATTACK", "DoS", None),
    (3, "a", "DOUBT", "DOUBT", "ANOMALY"),
    (4, "a", "DOUBT", "DOUBT", "ERROR"),
    (5, "c", "DOUBT", "DOUBT", "DISABLED"),
    (6, "b", "ATTACK", "DoS", None),
    (7, "a", "BENIGN", "BENIGN", None),
]


def test_counters_and_rates(spark):
    counters = stats.add_rates(stats.with_overall(stats.device_counters(triaged(spark, ROWS))))
    rows = {r.device_id: r for r in counters.collect()}
    assert rows[None].scope == "overall" and rows[None].total == 7
    assert (rows["a"].analysed, rows["a"].confirmed_anomaly, rows["a"].tier2_errors) == (1, 1, 1)
    assert rows["a"].anomaly_rate == 100.0 and rows["a"].success_rate == 50.0
    # Nothing analysed: no rate. A switched-off tier is neither analysed nor failed.
    assert rows["c"].anomaly_rate is None and rows["c"].success_rate is None
    assert (rows["c"].analysed, rows["c"].tier2_errors) == (0, 0)


def test_attack_maps(spark):
    maps = stats.attack_type_map(stats.attack_type_counts(triaged(spark, ROWS)))
    assert {r.device_id: r.attack_types for r in maps.collect()} == {"b": {"DoS": 2}, None: {"DoS": 2}}


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_snapshots_list_silent_devices(spark, block):
    changes = stats.statistics_changes(stats.snapshot_counts(triaged(spark, ROWS), 2), 2, block=block)
    got = stats.snapshots_at(changes, [2, 4, 6])
    table = {(r.at_sample, r.device_id): r.total for r in got.collect()}
    assert table == {
        (2, "a"): 1, (2, "b"): 1, (2, None): 2,
        (4, "a"): 3, (4, "b"): 1, (4, None): 4,
        (6, "a"): 3, (6, "b"): 2, (6, "c"): 1, (6, None): 6,
    }


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_change_rows_hold_until_the_next_change(spark, block):
    changes = stats.statistics_changes(stats.snapshot_counts(triaged(spark, ROWS), 2), 2, block=block)
    rows = {(r.scope, r.device_id, r.valid_from): (r.valid_to, r.total) for r in changes.collect()}
    assert rows == {
        ("device", "a", 2): (4, 1), ("device", "a", 4): (None, 3),
        ("device", "b", 2): (6, 1), ("device", "b", 6): (None, 2),
        ("device", "c", 6): (None, 1),
        ("overall", None, 2): (4, 2), ("overall", None, 4): (6, 4), ("overall", None, 6): (None, 6),
    }


def test_snapshots_between_and_before_snapshots(spark):
    changes = stats.statistics_changes(stats.snapshot_counts(triaged(spark, ROWS), 2), 2)
    got = {(r.at_sample, r.device_id): r.total for r in stats.snapshots_at(changes, [1, 3, 3, 99]).collect()}
    assert got == {
        (3, "a"): 1, (3, "b"): 1, (3, None): 2, (99, "a"): 3, (99, "b"): 2, (99, "c"): 1, (99, None): 6,
    }
    assert stats.snapshots_at(changes, []).collect() == []
    nothing = stats.statistics_changes(stats.snapshot_counts(triaged(spark, ROWS[:1]), 2), 2)
    assert nothing.collect() == [] and stats.snapshots_at(nothing, [2]).collect() == []


def test_change_rows_grow_with_changes(spark):
    """One busy device and many that spoke once: no row for what stayed the same."""
    rows = [(i, f"d{i}" if i <= 50 else "busy", "BENIGN", "BENIGN", None) for i in range(1, 301)]
    changes = stats.statistics_changes(stats.snapshot_counts(triaged(spark, rows), 10), 10, block=3)
    assert changes.count() == 50 + 25 + 30


def final_plan(df):
    """The plan that ran, without the one it began with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_change_rows_shuffle_once(spark, tmp_path):
    """Rows go to their blocks in one shuffle that both levels use; the others carry one row per block or snapshot."""
    rows = [(i, f"d{i % 7}", "BENIGN", "BENIGN", None) for i in range(1, 301)]
    counts = write_and_read(stats.snapshot_counts(triaged(spark, rows), 10), str(tmp_path / "counts"))
    plan = final_plan(stats.statistics_changes(counts, 10))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "Reused" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in shuffles) == 2
    assert len(set(re.findall(r"Exchange (hashpartitioning\([^)]*\))", plan))) <= 4 and "ReusedExchange" in plan


def test_dense_snapshots_list_the_same_numbers_device_by_device(spark, monkeypatch):
    """Runs of the numbers repeat from device to device, and are whole across the runs' ends."""
    monkeypatch.setattr(stats, "LISTED_TOGETHER", 4)
    rows = [(i, f"d{i % 3}", "BENIGN", "BENIGN", None) for i in range(1, 61)]
    changes = stats.statistics_changes(stats.snapshot_counts(triaged(spark, rows), 2), 2).coalesce(1)
    at = list(range(2, 61, 2))
    got = stats.snapshots_at(changes, at).collect()
    assert {(r.at_sample, r.device_id): r.total for r in got} == {
        (n, d): t for n in at for d, t in
        [(None, n), *((f"d{k}", sum(i % 3 == k for i in range(1, n + 1))) for k in range(3))] if t
    }
    assert len(got) == len({(r.at_sample, r.device_id) for r in got})
    listed = [at.index(r.at_sample) // 4 for r in got]
    assert listed == sorted(listed)


def test_alerts(spark):
    rows = triaged(spark, ROWS).withColumn("confidence", F.lit(0.5)).withColumn(
        "tier2_detail",
        F.expr(
            "CASE WHEN tier2_status IN ('ANOMALY', 'BENIGN') THEN named_struct('reconstruction_error', 2.0D, "
            "'threshold', 1.0D, 'anomaly_score', 2.0D, 'model_type', 'standard') END"
        ),
    )
    got = {r.sample_id: r for r in stats.alerts(rows).collect()}
    assert {n: (r.level, r.event) for n, r in got.items()} == {
        1: ("INFO", "benign"), 2: ("ALERT", "attack"), 3: ("ALERT", "confirmed_anomaly"), 4: ("WARNING", "analysis_failed"),
        5: ("WARNING", "analysis_off"), 6: ("ALERT", "attack"), 7: ("INFO", "benign"),
    }
    assert (got[2].attack_class, got[2].device_id, got[2].confidence) == ("DoS", "b", 0.5)
    assert (got[3].reconstruction_error, got[3].threshold, got[3].model_type, got[3].attack_class) == (2.0, 1.0, "standard", None)
    assert got[4].reconstruction_error is None
    assert [r.sample_id for r in stats.alerts(rows, ["confirmed_anomaly"]).collect()] == [3]


def test_active_devices_are_sorted(spark):
    table = small_table(spark, [{"device_id": d, "total": n} for d, n in (("b", 1), ("a", 2), ("z", 0))], "device_id string, total long")
    assert [r.device_id for r in stats.active_devices(table).collect()] == ["a", "b"]
