from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.numbers import DEFAULT_THRESHOLD
from flowguard.functions.vectors import rebuild_by_mean
from flowguard.operators import anomaly, classify, messages, scaling, sequences, stats
from flowguard.operators.ordering import time_slice
from flowguard.plans import monitor
from flowguard.plans.anomaly import judge_flows, train_anomaly_model, train_from_flows
from flowguard.plans.classifier import score_features, train_flow_classifier, uncertain_extractor
from flowguard.sources import packages, tables
from flowguard.sources.bus import MESSAGE_SCHEMA, read_messages
from flowguard.sources.paths import path_exists, remove_path, stage, work_folder
from flowguard.streaming import cascade, rolling
from flowguard.streaming.cascade import Tier1, Tier2, start_cascade
from flowguard.streaming.deltas import DeltaTable


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for name, n, centre in (("BENIGN", 1500, 0.0), ("DoS Hulk", 1100, 4.0), ("Bot", 60, -5.0)):
        x = rng.normal(size=(n, 3)) + centre
        rows += [(float(a), float(b), float(c), float(a * 2), 1.0, name) for a, b, c in x]
    rows += rows[:40]
    return spark.createDataFrame(rows, "a double, b double, c double, twice double, flat double, Label string").repartition(4)


@pytest.fixture(scope="module")
def classifier(spark, flows, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("classifier"))
    return work, train_flow_classifier(flows, work, trees=8, depth=4)


def test_classifier_plan(spark, classifier):
    work, run = classifier
    assert run.package.classes == ["BENIGN", "DOUBT", "DoS", "Malware"]
    assert run.package.feature_columns == ["a", "b", "c"]
    assert run.tables["metrics"].first().accuracy > 0.8
    assert {r.part for r in run.tables["losses"].collect()} == {"train", "validation"}
    n = {r["class"]: int(r.occurrences_number) for r in spark.read.csv(f"{work}/test_labels", header=True).collect()}
    features = tables.read_features(spark, f"{work}/test_features", run.package.feature_columns)
    assert features.count() == sum(n.values()) == 133
    predictions = spark.read.csv(f"{work}/test_predictions", header=True)
    assert predictions.columns == ["prediction", "max_probability", "prob_BENIGN", "prob_DOUBT", "prob_DoS", "prob_Malware"]
    assert run.tables["uncertain"].count() == run.tables["triage"].first().total_doubt
    assert run.tables["importances"].count() == 3


def test_saved_classifier_scores_new_rows(spark, classifier):
    work, run = classifier
    loaded = packages.load_classifier(spark, f"{work}/package")
    features = tables.read_features(spark, f"{work}/test_features", loaded.feature_columns)
    table = score_features(features, loaded).collect()
    for r in table:
        p = [r[f"prob_{c}"] for c in loaded.classes]
        assert sum(p) == pytest.approx(1.0) and r.max_probability == max(p)
    saved = f"{work}/raw_uncertain"
    kept = tables.load_or_extract(spark, saved, uncertain_extractor(features, loaded))
    assert kept.columns == loaded.feature_columns and path_exists(spark, f"{saved}/_SUCCESS")
    assert tables.load_or_extract(spark, saved, None).count() == kept.count()
    with pytest.raises(ValueError):
        tables.load_or_extract(spark, f"{work}/missing", None)


def test_incomplete_package_is_refused(spark, classifier, tmp_path):
    work, run = classifier
    with pytest.raises(FileNotFoundError):
        packages.load_classifier(spark, str(tmp_path / "none"))
    broken = classify.ClassifierPackage(run.package.model, run.package.scaler, [], ["a"], "forest", [0])
    packages.save_classifier(spark, broken, str(tmp_path / "broken"))
    with pytest.raises(KeyError, match="classes"):
        packages.load_classifier(spark, str(tmp_path / "broken"))


def test_boosted_method_normalises(spark, flows):
    rows = flows.withColumn("Label", F.when(F.col("Label") == "BENIGN", "BENIGN").otherwise("DoS"))
    scaler = scaling.fit_standard(rows, ["a", "b"])
    package = classify.train_classifier(rows, scaler, ["BENIGN", "DoS", "Never"], method="boosted", trees=2, depth=2)
    for r in classify.score(rows, package).select("probability").limit(50).collect():
        assert sum(r.probability) == pytest.approx(1.0) and r.probability[2] == 0.0
    with pytest.raises(ValueError):
        classify.train_classifier(rows, scaler, ["BENIGN"], method="other")


def test_scores_are_not_recomputed_in_filters(spark, classifier):
    _, run = classifier
    rows = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    from flowguard.operators.triage import online_triage

    plan = online_triage(classify.score(rows, run.package), run.package.classes).where("traffic_type = 'DOUBT'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    lowest = text[text.rindex("Filter") :].splitlines()[0]
    assert "UDF" not in lowest and "probability" in lowest


@pytest.fixture(scope="module")
def anomaly_run(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    n = 900
    x = np.column_stack([np.sin(np.arange(n) / 5) * 10, np.cos(np.arange(n) / 5) * 3, rng.normal(size=n)])
    x[500:505] += 200
    rows = [(f"d{i % 3}", i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "device string, i long, a double, b double, c double").repartition(5)
    work = str(tmp_path_factory.mktemp("anomaly"))
    return work, train_anomaly_model(
        df, work, keys=["device"], order_by=["i"], slice_by=F.expr("i div 100"), length=5, components=4
    )


def test_anomaly_plan(spark, anomaly_run):
    work, run = anomaly_run
    windows = spark.read.parquet(f"{work}/windows")
    assert windows.count() == 3 * ((300 - 5) // 3 + 1)
    assert run.package.params.threshold == sorted(
        run.thresholds[k] for k in ("statistical", "percentile", "iqr")
    )[1]
    total = run.tables["summary"].first()
    assert total.anomalies + total.normal == total.total == windows.where("split = 'test'").count()
    assert run.tables["mse_histogram"].agg(F.sum("n")).first()[0] == run.tables["timeline"].count()
    assert run.tables["qq"].count() == 99
    assert run.tables["overfit"].first().overfit_ratio > 0


def test_saved_anomaly_model(spark, anomaly_run, tmp_path):
    work, run = anomaly_run
    loaded = packages.load_anomaly_model(spark, f"{work}/package")
    assert loaded.params == run.package.params and loaded.scaler == run.package.scaler
    assert loaded.feature_columns == run.package.feature_columns and loaded.sequence_length == 5
    assert packages.load_anomaly_model(spark, str(tmp_path / "none")) is None
    assert packages.load_anomaly_model(spark, None) is None
    run.package.params.threshold, before = float("nan"), run.package.params.threshold
    packages.save_anomaly_model(spark, run.package, str(tmp_path / "nan"))
    run.package.params.threshold = before
    assert packages.load_anomaly_model(spark, str(tmp_path / "nan")).params.threshold == DEFAULT_THRESHOLD
    assert packages.package_summary(spark, f"{work}/package").first().features == len(loaded.feature_columns)


def new_flows(spark):
    """Columns in another order, names that operators use, gaps, and a device of too few rows."""
    rng = np.random.default_rng(14)
    rows = [(float(c), f"d{i % 4}", i, float(b), float(a), "x", 1.0) for i, (a, b, c) in enumerate(rng.normal(size=(120, 3)) * 8)]
    rows[10] = (None, *rows[10][1:])
    rows[21] = (float("inf"), *rows[21][1:3], float("nan"), *rows[21][4:])
    rows += [(1.0, "short", i, 1.0, 1.0, "x", 1.0) for i in range(4)]
    return spark.createDataFrame(rows, "c double, device string, i long, b double, a double, sequence string, mse double")


def judged_by_hand(rows, package, stride):
    """(device, window, mse) with numpy: clean numbers, scale, window, project."""
    mean = package.model.stages[0].mean.toArray()
    basis = package.model.stages[1].pc.toArray()
    s = package.scaler

    def scaled(row):
        out = []
        for i, c in enumerate(package.feature_columns):
            v = row[c]
            v = 0.0 if v is None or np.isnan(v) else min(max(v, -1e6), 1e6)
            v = (v - s.centre[i]) / s.spread[i]
            v = -1 + 2 * (v - s.low[i]) / ((s.high[i] - s.low[i]) or 1)
            out.append(min(max(v, -5.0), 5.0))
        return out

    found = {}
    for device in {r.device for r in rows}:
        vectors = [scaled(r) for r in sorted(rows, key=lambda r: r.i) if r.device == device]
        for w, at in enumerate(range(0, len(vectors) - package.sequence_length + 1, stride)):
            x = np.ravel(vectors[at : at + package.sequence_length])
            found[device, w] = float(np.mean((x - mean - (x - mean) @ basis @ basis.T) ** 2))
    return found


@pytest.mark.parametrize("stride", [1, 4])
def test_new_table_judged_by_a_saved_package(spark, anomaly_run, tmp_path, stride):
    df = new_flows(spark)
    package = anomaly_run[1].package
    tables_ = judge_flows(
        df.repartition(6), f"{anomaly_run[0]}/package", str(tmp_path), keys=["device"], order_by=["i"],
        slice_by=F.expr("i div 30"), stride=stride,
    )
    want = judged_by_hand(df.collect(), package, stride)
    got = {(r.device, r.window_no): r for r in tables_["judged"].collect()}
    limit, std = package.params.threshold, package.params.mse_std
    assert got.keys() == want.keys() and "short" not in {d for d, _ in got}
    for k, mse in want.items():
        assert got[k].mse == pytest.approx(mse) and got[k].is_anomaly == (mse > limit)
        assert got[k].anomaly_confidence == pytest.approx(abs(mse - limit) / std)
    above = sum(v > limit for v in want.values())
    total = tables_["summary"].first()
    assert (total.total, total.anomalies, total.normal) == (len(want), above, len(want) - above)
    assert tables_["expected_rate"].first()[0] == pytest.approx(above / len(want))
    for r in tables_["by_key"].collect():
        mine = [v for (d, _), v in want.items() if d == r.device]
        assert (r.windows, r.anomalies) == (len(mine), sum(v > limit for v in mine))
        assert r.highest_mse == pytest.approx(max(mine)) and r.anomaly_share == pytest.approx(r.anomalies / r.windows)


def test_what_cannot_be_judged(spark, anomaly_run, tmp_path):
    package = anomaly_run[1].package
    with pytest.raises(FileNotFoundError):
        judge_flows(new_flows(spark), str(tmp_path / "none"), str(tmp_path), order_by=["i"])
    with pytest.raises(ValueError, match="'c'"):
        judge_flows(new_flows(spark).drop("c"), package, str(tmp_path), order_by=["i"])
    few = new_flows(spark).where("device = 'short'")
    with pytest.raises(ValueError, match="not enough rows"):
        judge_flows(few, package, str(tmp_path), order_by=["i"])
    empty = judge_flows(few, package, str(tmp_path / "empty"), keys=["device"], order_by=["i"])
    assert empty["judged"].count() == 0 and empty["summary"].first().total == 0 and empty["by_key"].count() == 0


def test_training_from_flows_extracts_once(spark, classifier, flows, tmp_path):
    """Saved classifier, extraction, training; the second run reads what the first one saved."""
    path, work = f"{classifier[0]}/package", str(tmp_path / "anomaly")
    # Between the two large classes the classifier is unsure.
    between = flows.where("Label = 'BENIGN'").withColumns({c: F.col(c) + 2 for c in "abc"})
    numbered = flows.unionByName(between).withColumn("i", F.monotonically_increasing_id()).withColumn("device", F.lit("d")).withColumn("extra", F.lit(3.5))
    numbered = stage(numbered, "numbered")
    settings = dict(order_by=["i"], keys=["device"], length=3, components=2)
    run = train_from_flows(spark, work, flows=numbered, classifier=path, **settings)
    saved = spark.read.parquet(f"{work}/uncertain")
    want = uncertain_extractor(numbered, packages.load_classifier(spark, path))()
    assert saved.columns == ["device", "i", "a", "b", "c"] and 100 < saved.count() < numbered.count()
    assert sorted(r.i for r in saved.collect()) == sorted(r.i for r in want.select("i").collect())
    again = train_from_flows(spark, str(tmp_path / "again"), saved=f"{work}/uncertain", **settings)
    assert again.package.params.threshold == pytest.approx(run.package.params.threshold)
    with pytest.raises(ValueError, match="no saved rows"):
        train_from_flows(spark, str(tmp_path / "nothing"), flows=numbered, **settings)


def test_global_order_needs_enough_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i % 2) * 5) for i in range(6)], "i long, a double, b double")
    with pytest.raises(ValueError, match="not enough rows"):
        train_anomaly_model(df, str(tmp_path), order_by=["i"], length=10)


def message_rows(spark, numbers):
    rows = [("hot" if i % 3 else f"d{i % 4}", f"{i % 13}.5,{i % 5},{i % 7}" if i % 17 else "bad", i) for i in numbers]
    return spark.createDataFrame(rows, "device_id string, csv_data string, n long").select(
        "device_id", "csv_data", F.timestamp_seconds("n").alias("timestamp")
    )


def test_monitor_with_trained_packages_equals_batch(spark, classifier, anomaly_run, tmp_path):
    """Saved packages, two deliveries, a restart, and a switched-off second tier."""
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    for part in (range(0, 150), range(150, 260)):
        message_rows(spark, part).write.mode("append").parquet(inbox)
        stream = read_messages(spark, "parquet", path=inbox, position=False)
        monitor.start_monitor(
            spark, stream, classifier=f"{classifier[0]}/package", anomaly=f"{anomaly_run[0]}/package",
            output=out, checkpoint=f"{out}/checkpoint", order_by=["timestamp"],
            slice_by=time_slice(F.col("timestamp"), 20), trigger={"availableNow": True},
        ).awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    bad = sum(1 for i in range(260) if i % 17 == 0)
    assert results.count() == 260 - bad and spark.read.parquet(f"{out}/rejected").count() == bad
    doubt = results.where("traffic_type = 'DOUBT'")
    assert doubt.count() > 0
    assert doubt.where("tier2_status NOT IN ('ANOMALY', 'BENIGN')").count() == 0
    assert results.where("traffic_type <> 'DOUBT' AND tier2_status IS NOT NULL").count() == 0

    # The same messages at once, through the batch operators.
    from flowguard.streaming.cascade import classify_messages, first_tier, run_cascade, second_tier

    package = packages.load_classifier(spark, f"{classifier[0]}/package")
    tier2 = second_tier(packages.load_anomaly_model(spark, f"{anomaly_run[0]}/package"), package.feature_columns)
    valid = messages.valid_messages(messages.parse_messages(message_rows(spark, range(260)), 3))
    batch = run_cascade(stage(classify_messages(valid, first_tier(package))), tier2, ["timestamp"])
    def key(df):
        return sorted(
            (r.timestamp, r.traffic_type, r.tier2_status,
             None if r.tier2_detail is None else round(r.tier2_detail.reconstruction_error, 9))
            for r in df.collect()
        )
    assert str(key(results)) == str(key(batch))

    report = monitor.statistics_report(results, ["timestamp"], time_slice(F.col("timestamp"), 50), every=50)
    overall = report["overall"].first()
    assert overall.total == 260 - bad and overall.analysed == doubt.count()
    assert report["snapshots"].where("scope = 'overall'").count() == (260 - bad) // 50

    # What the job has kept says the same as its results.
    report = monitor.statistics_report(results)
    final = monitor.final_statistics(spark, out)
    for name in ("devices", "overall", "attack_types"):
        assert sorted(map(str, final[name].collect())) == sorted(map(str, report[name].collect()))
    same = [sorted(map(str, df.collect())) for df in (monitor.recorded_snapshots(spark, out), report["snapshots"])]
    assert same[0] == same[1] and len(same[0]) > 0
    assert spark.read.parquet(f"{out}/alerts").count() == results.count()


def test_without_a_second_tier(spark, classifier, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    message_rows(spark, range(60)).write.parquet(inbox)
    monitor.start_monitor(
        spark, read_messages(spark, "parquet", path=inbox), classifier=f"{classifier[0]}/package", anomaly=None,
        output=out, checkpoint=f"{out}/checkpoint", order_by=["timestamp"], trigger={"availableNow": True},
    ).awaitTermination()
    rows = spark.read.parquet(f"{out}/results")
    assert {r.tier2_status for r in rows.where("traffic_type = 'DOUBT'").collect()} <= {"DISABLED"}
    counted = stats.device_counters(rows).agg(F.sum("analysed"), F.sum("tier2_errors")).first()
    assert tuple(counted) == (0, 0)


def test_a_retried_batch_gives_the_same_tables(spark, tmp_path):
    """Losing the commit of a micro-batch replays it: no row twice, same history."""
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    tier1 = Tier1(["BENIGN", "DOUBT"], lambda df: df.withColumn("probability", F.array(F.lit(0.1), F.lit(0.9))))
    tier2 = Tier2(lambda f: F.array(F.get(f, F.lit(0))), lambda df: df.withColumn("rebuilt", rebuild_by_mean(F.col("sequence"))), anomaly.AnomalyParams(1.0, 0, 1), 4)

    def run():
        start_cascade(
            read_messages(spark, "parquet", path=inbox), tier1, tier2, output=out, checkpoint=checkpoint,
            width=3, trigger={"availableNow": True},
        ).awaitTermination()

    for part in (range(1, 40), range(40, 70), range(70, 100)):
        message_rows(spark, part).write.mode("append").parquet(inbox)
        run()
    first = sorted(map(str, spark.read.parquet(f"{out}/results").collect()))
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted(map(str, spark.read.parquet(f"{out}/results").collect())) == first
    assert len(first) == 99 - sum(1 for i in range(1, 100) if i % 17 == 0)
    kept = [p.name for p in (tmp_path / "out" / "history" / "delta").iterdir()]
    assert str(last) in kept
    # No sample was numbered or counted twice.
    rows = spark.read.parquet(f"{out}/results")
    assert sorted(r.sample_id for r in rows.collect()) == list(range(1, len(first) + 1))
    assert monitor.final_statistics(spark, out)["overall"].first().total == len(first)
    same = [sorted(map(str, df.collect())) for df in (monitor.recorded_snapshots(spark, out), monitor.statistics_report(rows)["snapshots"])]
    assert same[0] == same[1]
    # Without its ledger entry the next micro-batch would count from nothing.
    remove_path(spark, f"{out}/ledger/{last}")
    message_rows(spark, range(100, 110)).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="which is gone"):
        run()


def device_rows(spark, rows):
    return spark.createDataFrame(rows, "device_id string, n long")


@pytest.mark.parametrize("merge_after", [1, 3, 100])
def test_delta_table_counts_each_micro_batch_once(spark, tmp_path, merge_after):
    batches = [[("a", 1), ("b", 2)], [("a", 10)], [], [("c", 5), ("b", 1)], [("a", 100)], [("d", 7)], [("a", 1000), ("d", 1)]]
    total = lambda rows: rows.groupBy("device_id").agg(F.sum("n").alias("n"))
    table = DeltaTable(spark, str(tmp_path), device_rows(spark, []).schema, ["device_id"], total, buckets=4, merge_after=merge_after)
    assert table.state().collect() == []
    want: dict = {}
    for number, batch in enumerate(batches):
        after = dict(want)
        for device, n in batch:
            after[device] = after.get(device, 0) + n
        for _ in range(2):  # the second attempt repeats the first
            table.compact(number)
            found = total(table.lookup(device_rows(spark, [("a", 0), ("zz", 0)]), number))
            assert list(map(tuple, found.collect())) == ([("a", want["a"])] if "a" in want else [])
            assert dict(map(tuple, table.state(number).collect())) == want
            table.append(number, device_rows(spark, batch))
            assert dict(map(tuple, table.state().collect())) == after
        want = after
    kept = sorted(int(p.name) for p in (tmp_path / "delta").iterdir())
    assert len(kept) <= 2 * merge_after + 1


def test_silent_devices_are_forgotten(spark, tmp_path):
    """A device that comes back after more than two micro-batches begins a new sequence."""
    tier1 = Tier1(["BENIGN", "DOUBT"], lambda df: df.withColumn("probability", F.array(F.lit(0.1), F.lit(0.9))))
    rebuilt = lambda df: df.withColumn("rebuilt", rebuild_by_mean(F.col("sequence")))
    tier2 = Tier2(lambda f: F.array(F.get(f, F.lit(0))), rebuilt, anomaly.AnomalyParams(1.0, 0, 1), 3)

    def errors(expire_after, merge_after):
        inbox, out = (str(tmp_path / f"{n}-{expire_after}-{merge_after}") for n in ("inbox", "out"))
        for number, devices in enumerate(["ab", "b", "b", "b", "ab"]):
            rows = [(d, f"{10 * number}.0", number) for d in devices]
            df = spark.createDataFrame(rows, "device_id string, csv_data string, n long")
            df.select("device_id", "csv_data", F.timestamp_seconds("n").alias("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
            start_cascade(
                read_messages(spark, "parquet", path=inbox), tier1, tier2, output=out, checkpoint=f"{out}/checkpoint", width=1,
                expire_after=expire_after, merge_after=merge_after, trigger={"availableNow": True},
            ).awaitTermination()
        last = spark.read.parquet(f"{out}/results").where("batch_id = 4").collect()
        return {r.device_id: round(r.tier2_detail.reconstruction_error, 6) for r in last}

    kept = errors(None, 20)
    # a: 40, 0, 40 (padded in front by the current value) against three times 40.
    assert kept["a"] == pytest.approx(355.555556) and kept["b"] == pytest.approx(66.666667)
    for merge_after in (1, 20):
        gone = errors(2, merge_after)
        assert gone["a"] < 1e-9 and gone["b"] == kept["b"]
        assert errors(3, merge_after) == kept


def test_one_device_with_a_third_of_all_rows_is_split(spark):
    """No task of the sequence window holds more than a slice of the hot device."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("k"),
        F.col("id").alias("i"),
        F.col("id").cast("double").alias("v"),
    )
    rows = sequences.rolling_sequences(df, ["k"], ["i"], "v", slice_by=F.expr("i div 100"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "collect_list" in line and "Window" in line]
    assert wide and "WindowGroupLimit" in plan
    assert rows.count() == 3000


def test_a_message_is_parsed_once(spark):
    """The filter on valid messages and the readers of their fields share one parsed array."""
    rows = spark.createDataFrame([("a", "1,2,3"), ("b", None), ("c", "1,x,2"), ("d", "1,2")], "device_id string, csv_data string")
    valid = messages.valid_messages(messages.parse_messages(rows, 3))
    read = valid.select("device_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3)]).where("f0 < f1 AND f1 < f2")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in read.collect()] == [("a", 1.0, 2.0, 3.0)]


def test_ranges_are_cut_before_messages_are_parsed(spark, tmp_path, monkeypatch):
    """Cutting ranges computes its input twice; devices that tie in time are numbered by their names all the same."""
    cut, whole = [], cascade.in_ranges
    monkeypatch.setattr(cascade, "in_ranges", lambda df, by: (cut.append((df.columns, list(by))), whole(df, by))[1])
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    rows = [(d, "1,2", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(30) for d in ("z", None, "b", "", "unknown0")]
    messages = spark.createDataFrame(rows, "device_id string, csv_data string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    messages.write.parquet(inbox)
    tier1 = cascade.Tier1(["BENIGN", "DoS"], lambda df: df.withColumn("probability", F.array(F.lit(0.1), F.lit(0.9))))
    cascade.start_cascade(
        read_messages(spark, "parquet", path=inbox), tier1, None, output=out, checkpoint=f"{out}/checkpoint", width=2, trigger={"availableNow": True}
    ).awaitTermination()
    assert cut and all("features" not in columns and by == ["timestamp"] for columns, by in cut)
    got = [(str(r.timestamp), r.device_id) for r in spark.read.parquet(f"{out}/results").orderBy("sample_id").collect()]
    assert len(got) == 150 and got == sorted(got)


def test_kafka_options_are_built_lazily(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_messages(spark, brokers="h:1", topic="t")
    args = monitor.arguments(["--brokers", "b", "--topic", "t", "--classifier", "c", "--output", "o"])
    assert args.anomaly is None and args.topic == "t"


def test_labelled_csv_under_plain_names(spark, tmp_path):
    folder = tmp_path / "flows"
    folder.mkdir()
    (folder / "a.csv").write_text(" Flow Bytes/s,Length.1, Label\n1.5,2,BENIGN\nInfinity,3,DoS Hulk\n")
    df = tables.read_labelled_flows(spark, str(folder))
    assert df.columns == ["Flow Bytes/s", "Length_1", "Label"]
    assert isinstance(df.schema["Length_1"].dataType, T.IntegerType)
    schema = tables.flow_schema(["Length_1", "Flow Bytes/s"], "Label")
    given = tables.read_labelled_flows(spark, str(folder), schema)
    assert given.columns == ["Length_1", "Flow Bytes/s", "Label"]
    assert [tuple(r) for r in given.collect()] == [(2.0, 1.5, "BENIGN"), (3.0, float("inf"), "DoS Hulk")]
    narrow = tables.read_features(spark, str(folder), ["Length_1"])
    assert [r[0] for r in narrow.collect()] == [2.0, 3.0]
    with pytest.raises(Exception, match="Missing"):
        tables.read_features(spark, str(folder), ["Missing"])


def test_work_folder_uses_the_shared_setting():
    def session(master, shared):
        conf = SimpleNamespace(get=lambda name, default: shared if name == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    first, second = (work_folder(session("yarn", "hdfs:///shared/"), "x") for _ in range(2))
    assert first.startswith("hdfs:///shared/x-") and first != second
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(session("yarn", None), "x")


def test_message_schema():
    assert MESSAGE_SCHEMA.fieldNames() == ["device_id", "csv_data", "timestamp"]


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    from flowguard.sources.tables import read_features, read_labelled_flows

    (tmp_path / "a.csv").write_text("x,y,Label\n3,30,p\n")
    (tmp_path / "b.csv").write_text("y, x,Label\n40,4,q\n")
    (tmp_path / "c.csv").write_text("y, x,Label\n50,5,q\n")
    rows = read_features(spark, str(tmp_path), ["x", "y"]).collect()
    assert sorted(map(tuple, rows)) == [(3.0, 30.0), (4.0, 40.0), (5.0, 50.0)]
    typed = read_labelled_flows(spark, str(tmp_path))
    assert sorted((r.x, r.y, r.Label) for r in typed.collect()) == [(3, 30, "p"), (4, 40, "q"), (5, 50, "q")]


def test_rows_are_named_by_their_content(spark):
    """Two differently partitioned inputs are split alike."""
    from pyspark.sql import functions as F

    from flowguard.operators.sampling import stratified_split

    rows = spark.range(400).select((F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("Label"))

    def parts(n):
        named = rows.repartition(n).withColumn("row_id", F.md5(F.to_json(F.struct("Label", "a"))))
        return {(r.a, r.split) for r in stratified_split(named, "Label", ["row_id"]).collect()}

    assert parts(2) == parts(7)


def test_output_of_another_run_is_refused(spark, tmp_path):
    from flowguard.streaming.cascade import Tier1, start_cascade

    (tmp_path / "out" / "results").mkdir(parents=True)
    with pytest.raises(ValueError, match="checkpoint"):
        start_cascade(spark.range(1), Tier1(["a"], lambda d: d), None, output=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))


class MapStore(dict):
    """What SortedRuns needs of a map state."""

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


@pytest.mark.parametrize("n, chunk, block, fan", [(1, 3, 2, 2), (50, 7, 3, 2), (400, 9, 4, 3), (400, 50, 100, 32)])
def test_sorted_runs_merge_in_order_and_in_bounded_parts(n, chunk, block, fan):
    r = np.random.default_rng(n + fan)
    rows = pd.DataFrame({"t": r.integers(0, 12, n), "i": r.permutation(n), "v": [[float(x)] for x in range(n)]})
    store = MapStore()
    runs = rolling.SortedRuns(store, ["t", "i"], block, fan)
    for start in range(0, n, chunk):
        runs.add(rows.iloc[start : start + chunk])
    parts = list(runs.merged())
    got = pd.concat(parts, ignore_index=True)
    want = rows.sort_values(["t", "i"], ignore_index=True)
    assert got[["t", "i"]].equals(want[["t", "i"]]) and [list(v) for v in got["v"]] == [list(v) for v in want["v"]]
    assert not store and max(map(len, parts)) <= block * max(fan, sum(map(len, runs.levels)))


def test_rolling_state_of_a_key_in_many_chunks(spark, tmp_path):
    """One key has all rows, which reach the state in chunks of seven."""
    confs = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    }
    before = {c: spark.conf.get(c) for c in confs}
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    schema = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    order = np.random.default_rng(5).permutation(300)
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        for part in (order[:180], order[180:]):
            rows = [("hot", int(i) + (0 if i in order[:180] else 1000), [float(i)]) for i in part] + [("d", int(part[0]) , [0.5])]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(schema).parquet(inbox)
            rolling.rolling_sequence_stream(stream, order_by=["n"], length=4).writeStream.format("parquet").option(
                "checkpointLocation", f"{out}/checkpoint"
            ).trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = spark.read.parquet(f"{out}/rows").where("device_id = 'hot'").orderBy("device_sample_no").collect()
    arrival = [float(i) for i in sorted(order[:180])] + [float(i) for i in sorted(order[180:])]
    assert [r.device_sample_no for r in got] == list(range(1, 301))
    for i, r in enumerate(got):
        window = arrival[max(0, i - 3) : i + 1]
        assert [v[0] for v in r.sequence] == [arrival[i]] * (4 - len(window)) + window


def test_monitor_settings():
    args = monitor.arguments(["--brokers", "b", "--topic", "t", "--classifier", "c", "--output", "o"])
    assert (args.stats_interval, args.expire_after) == (25, None)
    args = monitor.arguments(["--brokers", "b", "--topic", "t", "--classifier", "c", "--output", "o", "--stats-interval", "7"])
    assert args.stats_interval == 7


def test_final_statistics_are_written_when_the_job_is_stopped(spark, tmp_path):
    class Stopped:
        stopped = False

        def awaitTermination(self):
            raise KeyboardInterrupt

        def stop(self):
            self.stopped = True

    query = Stopped()
    final = monitor.until_stopped(query, spark, str(tmp_path))
    assert query.stopped and final["devices"].collect() == [] and path_exists(spark, f"{tmp_path}/final/overall/_SUCCESS")


def test_headers_of_many_files_take_no_job_each(spark, tmp_path):
    import gzip

    from flowguard.sources.paths import first_line

    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(40):
        names = ["x", "y", "Label"] if i % 2 else ["Label", "y", "x"]
        values = {"x": str(i), "y": "1.5", "Label": '"a,b"'}
        (folder / f"{i}.csv").write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    (folder / "empty.csv").write_text("")
    with gzip.open(folder / "z.csv.gz", "wt") as f:
        f.write("y,x,Label\n2.5,99,c\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    got = tables.read_labelled_flows(spark, str(folder), T.StructType([*tables.flow_schema(["x", "y"]).fields, T.StructField("Label", T.StringType())]))
    assert len(tracker.getJobIdsForGroup("headers")) <= 2  # Spark lists the folder
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(float(i), 1.5, "a,b") for i in range(40)] + [(99.0, 2.5, "c")]
    assert first_line(spark, str(folder / "1.csv"), block=1) == "x,y,Label" and first_line(spark, str(folder / "empty.csv")) is None
    assert tables.header_names('a,"b,c",,a,D') == ("a0", "b,c", "_c2", "a3", "D")
    with pytest.raises(ValueError, match="no file"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "e.csv").write_text("")
        tables.read_labelled_flows(spark, str(tmp_path / "none"))
