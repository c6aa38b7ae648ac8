import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.functions.vectors import rebuild_by_mean
from flowguard.operators import anomaly, diagnostics, sequences

NAN = float("nan")


def rows(spark, sizes):
    data = [(k, i, [float(i), float(-i)]) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "k string, i long, v array<double>").repartition(7)


# One key holds most rows; slices of several widths, some holding a single row.
SLICES = {
    "none": None,
    "single": "i",
    "pairs": "i div 2",
    "uneven": "CASE WHEN i < 57 THEN 0 ELSE i div 4 END",
    "wide": "i div 40",
}


def slices(name):
    return None if SLICES[name] is None else F.expr(SLICES[name])


@pytest.mark.parametrize("name", SLICES)
def test_strided_sequences_do_not_depend_on_slices(spark, name):
    df = rows(spark, {"hot": 200, "ten": 10, "nine": 9})
    got = sequences.strided_sequences(df, ["k"], ["i"], "v", length=10, stride=3, slice_by=slices(name)).collect()
    want = {("hot", w): w * 3 for w in range((200 - 10) // 3 + 1)} | {("ten", 0): 0}
    assert {(r.k, r.window_no) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        start = want[r.k, r.window_no]
        assert [v[0] for v in r.sequence] == [float(i) for i in range(start, start + 10)]


@pytest.mark.parametrize("name", SLICES)
def test_rolling_sequences_pad_with_the_current_sample(spark, name):
    df = rows(spark, {"hot": 100, "few": 4})
    got = sequences.rolling_sequences(df, ["k"], ["i"], "v", length=10, slice_by=slices(name)).collect()
    assert len(got) == 104
    for r in got:
        seen = list(range(max(0, r.i - 9), r.i + 1))
        assert [v[0] for v in r.sequence] == [float(x) for x in [r.i] * (10 - len(seen)) + seen]


def test_global_order_and_length_one(spark):
    df = rows(spark, {"a": 30})
    got = sequences.strided_sequences(df, [], ["i"], "v", length=4, slice_by=slices("pairs")).collect()
    assert len(got) == 27
    one = sequences.rolling_sequences(df, ["k"], ["i"], "v", length=1, slice_by=slices("pairs")).collect()
    assert all(r.sequence == [r.v] for r in one)


def test_short_key_can_be_an_error(spark):
    with pytest.raises(ValueError, match="not enough rows"):
        sequences.strided_sequences(rows(spark, {"nine": 9}), ["k"], ["i"], "v", on_short="error")


def test_missing_values_keep_their_place(spark):
    df = spark.createDataFrame([("a", i, None if i == 2 else float(i)) for i in range(5)], "k string, i long, v double")
    got = sequences.strided_sequences(df, ["k"], ["i"], "v", length=5, slice_by=slices("single")).first()
    assert got.sequence == [0.0, 1.0, None, 3.0, 4.0]


def test_newest_rows(spark):
    got = sequences.newest_rows(rows(spark, {"a": 20, "b": 2}), ["k"], ["i"], 3).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 17), ("a", 18), ("a", 19), ("b", 0), ("b", 1)]


def errors(spark, values, split="validation"):
    return spark.createDataFrame([(i, float(v), float(v) / 2, split) for i, v in enumerate(values)], "window_no long, mse double, mae double, split string")


def test_threshold_is_the_middle_candidate(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=500)
    found = anomaly.threshold_candidates(errors(spark, x), contamination=0.1)
    q1, q3, p90 = np.percentile(x, [25, 75, 90])
    want = [x.mean() + 2.5 * x.std(), p90, q3 + 1.5 * (q3 - q1)]
    assert [found["statistical"], found["percentile"], found["iqr"]] == pytest.approx(want)
    assert found["threshold"] == pytest.approx(np.median(want))
    with pytest.raises(ValueError):
        anomaly.threshold_candidates(errors(spark, x).limit(0))


def test_an_error_equal_to_the_threshold_is_normal(spark):
    got = anomaly.detect_anomalies(errors(spark, [1.0, 2.0, 3.0]), anomaly.AnomalyParams(2.0, 2.0, 0.5))
    assert [r.is_anomaly for r in got.orderBy("window_no").collect()] == [False, False, True]
    assert [r.anomaly_confidence for r in got.orderBy("window_no").collect()] == [2.0, 0.0, 2.0]
    flat = anomaly.detect_anomalies(errors(spark, [1.0]), anomaly.AnomalyParams(2.0, 2.0, 0.0)).first()
    assert flat.anomaly_confidence is None


def test_anomaly_score_bends_at_ten_and_stops_at_a_hundred(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 10.0, 19.0, 1e200)], "v double")
    got = [r[0] for r in df.select(anomaly.anomaly_score(F.col("v"), F.lit(1.0))).collect()]
    assert got == [0.5, 10.0, 11.0, 100.0]


def test_verdicts(spark):
    seqs = [[[0.0], [2.0]], [[0.0], [0.2]], [[0.0], [NAN]], [[0.0], None], [[1e200], [-1e200]]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, sequence array<array<double>>")
    df = df.withColumn("rebuilt", rebuild_by_mean(F.col("sequence")))
    got = anomaly.add_verdict(df, anomaly.AnomalyParams(0.5, 0, 1)).orderBy("i").collect()
    assert [r.tier2_status for r in got] == ["ANOMALY", "BENIGN", "ERROR", "ERROR", "ERROR"]
    assert got[0].tier2_detail.reconstruction_error == 1.0 and got[0].tier2_detail.anomaly_score == 2.0
    assert got[2].tier2_detail is None
    off = anomaly.add_verdict(df, None).first()
    assert off.tier2_status == "DISABLED" and off.tier2_detail is None
    bad = anomaly.add_verdict(df, anomaly.AnomalyParams(-1.0, 0, 1)).orderBy("i").first()
    assert bad.tier2_detail.threshold == 0.01


def test_exact_reconstruction_gets_the_smallest_error(spark):
    df = spark.createDataFrame([([[1.0], [1.0]],)], "sequence array<array<double>>")
    got = anomaly.add_verdict(df.withColumn("rebuilt", F.col("sequence")), anomaly.AnomalyParams(0.5, 0, 1)).first()
    assert got.tier2_detail.reconstruction_error == 1e-10


def test_reconstruction_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4, 2)) * np.array([5.0, 1.0]) + 100
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "i int, sequence array<array<double>>").repartition(4)
    model = anomaly.fit_reconstruction(df, 3)
    got = anomaly.add_errors(anomaly.reconstruct(df, model)).orderBy("i").collect()
    flat = x.reshape(300, 8)
    centred = flat - flat.mean(axis=0)
    basis = np.linalg.svd(centred, full_matrices=False)[2][:3].T
    want = ((centred - centred @ basis @ basis.T) ** 2).mean(axis=1)
    assert np.allclose([r.mse for r in got], want)
    odd = spark.createDataFrame([(0, None), (1, [[1.0, 2.0]]), (2, [[1.0, 2.0], None])], "i int, sequence array<array<double>>")
    assert [r.rebuilt for r in anomaly.reconstruct(odd, model).orderBy("i").collect()] == [None, None, None]


def test_histogram_counts_everything_once(spark):
    x = [0.0, 1.0, 1.0, 50.0, 49.99, 25.0]
    got = diagnostics.histogram(errors(spark, x), "mse").orderBy("bin").collect()
    want, edges = np.histogram(x, bins=50)
    assert [r.n for r in got] == list(want) and got[0].low == 0.0 and got[-1].high == pytest.approx(50.0)
    flat = diagnostics.histogram(errors(spark, [3.0, 3.0]), "mse")
    assert flat.agg(F.sum("n")).first()[0] == 2
    assert diagnostics.histogram(errors(spark, [1.0]).limit(0), "mse").count() == 0


def test_qq_points(spark):
    got = diagnostics.normal_qq(errors(spark, range(101)), "mse").orderBy("point").collect()
    assert len(got) == 99 and got[49].theoretical == pytest.approx(0.0) and got[49].observed == 50.0


def test_boxes_need_both_classes(spark):
    e = errors(spark, [1.0, 2.0, 3.0, 4.0, 100.0, 50.0])
    both = anomaly.detect_anomalies(e, anomaly.AnomalyParams(10.0, 0, 1))
    boxes = {r.is_anomaly: r for r in diagnostics.box_summary(both).collect()}
    assert (boxes[False].median, boxes[False].n, boxes[False].outliers) == (2.5, 4, 0)
    assert boxes[True].high_whisker == 100.0
    one = anomaly.detect_anomalies(e, anomaly.AnomalyParams(1000.0, 0, 1))
    assert diagnostics.box_summary(one).count() == 0


def test_overfit_ratio(spark):
    both = errors(spark, [1.0, 3.0], "train").unionByName(errors(spark, [4.0]))
    row = anomaly.overfit_ratio(both).first()
    assert row.train_mse == 2.0 and row.overfit_ratio == 0.5
    assert math.isclose(anomaly.split_errors(both).where("split='train'").first().mae, 1.0)


def test_boxes_of_any_grouping_in_one_set_of_passes(spark):
    rng = np.random.default_rng(8)
    rows = [(["p", "q", "r", None][i % 4], float(v)) for i, v in enumerate(rng.normal(size=400) ** 3)] + [("r", None)]
    df = spark.createDataFrame(rows, "part string, mse double")
    boxes = {r.part: r for r in diagnostics.box_summary(df, "mse", "part").collect()}
    assert set(boxes) == {"p", "q", "r"}
    for name, box in boxes.items():
        v = np.array([x for p, x in rows if p == name and x is not None])
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([box.q1, box.median, box.q3, box.low_whisker, box.high_whisker], [q1, median, q3, inside.min(), inside.max()])
        assert box.outliers == len(v) - len(inside)
    assert diagnostics.box_summary(df.where("part = 'p'"), "mse", "part").count() == 0
    assert diagnostics.box_summary(df.where("part = 'p'"), "mse", "part", least_groups=1).count() == 1
    with pytest.raises(ValueError, match="more than"):
        diagnostics.box_summary(df.withColumn("part", F.monotonically_increasing_id()), "mse", "part")


def test_reconstruction_of_odd_windows(spark):
    """Missing windows, missing rows, other widths and NULL cells, among good windows of one batch."""
    rng = np.random.default_rng(9)
    good = rng.normal(size=(60, 3, 2)).tolist()
    model = anomaly.fit_reconstruction(spark.createDataFrame([(w,) for w in good], "sequence array<array<double>>"), 2)
    odd = [None, [], [[1.0, 2.0]], [[1.0, 2.0], None, [3.0, 4.0]], [[1.0], [2.0], [3.0]], [[1.0, None], [2.0, 3.0], [4.0, 5.0]]]
    rows = [(i, w) for i, w in enumerate([good[0], *odd[:3], good[1], *odd[3:], good[2]])]
    df = spark.createDataFrame(rows, "i int, sequence array<array<double>>").coalesce(1)
    got = {r.i: r.rebuilt for r in anomaly.reconstruct(df, model).collect()}
    mean, basis = model.stages[0].mean.toArray(), model.stages[1].pc.toArray()
    for i, w in rows:
        if w in good:
            x = np.array(w).ravel()
            assert np.allclose(np.array(got[i]).ravel(), mean + (x - mean) @ basis @ basis.T)
    assert [got[i] for i, w in rows if w is None or w == [] or None in w or len(w) < 3 or len(w[0]) < 2] == [None] * 5
    assert np.isnan(np.array(got[7])).any()


@pytest.mark.parametrize("number", [True, False])
def test_global_order_over_many_slices_in_several_ranges(spark, number):
    """Slices of one or two rows: windows reach over several slices and ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(200).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v")).repartition(5)
        rows = sequences.recent_values(df, [], ["i"], "v", length=7, slice_by=F.expr("(i * 2) div 3"), number=number).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 200
    for r in rows:
        assert r.recent == [float(x) for x in range(max(0, r.i - 6), r.i + 1)]
        assert not number or r.row_no == r.i + 1
