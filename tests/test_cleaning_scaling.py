import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import cleaning, scaling

NAN, INF = float("nan"), float("inf")


def test_classifier_recipe(spark):
    rows = [
        (1.0, 2.0, 5.0, None, "t", True, "BENIGN"),
        (2.0, 4.1, 5.0, None, "u", False, "BENIGN"),
        (INF, 6.0, 5.0, None, "v", True, "Bot"),
        (4.0, 8.0, 5.0, NAN, "w", True, "Bot"),
        (4.0, 8.0, 5.0, NAN, "w", True, "Bot"),
    ]
    df = spark.createDataFrame(
        rows, "a double, twice double, flat double, empty double, text string, flag boolean, Label string"
    )
    grouped = cleaning.prepare_labelled_flows(df)
    assert grouped.count() == 4
    params = cleaning.fit_classifier_cleaning(grouped)
    assert params.feature_columns == ["a", "flag"] or params.feature_columns == ["a", "twice", "flag"]
    assert params.dropped["flat"] == "constant" and params.dropped["empty"] == "constant"
    assert params.dropped["text"] == "not numeric"
    clean = cleaning.apply_classifier_cleaning(grouped, params)
    assert clean.where(F.col("a").isNull()).count() == 0
    assert {r.Label for r in clean.collect()} == {"BENIGN", "Malware"}
    assert sorted(r.a for r in clean.collect()) == [1.0, 2.0, 2.0, 4.0]


def test_duplicate_count_treats_nan_as_equal(spark):
    df = spark.createDataFrame([(NAN, "x"), (NAN, "x"), (INF, "x"), (None, "x")], "a double, b string")
    assert tuple(cleaning.duplicates_removed(df).first()) == (4, 3, 1)
    assert cleaning.duplicates_removed(df.limit(0)).first().rows_removed == 0


def test_correlation_rule_is_not_greedy(spark):
    # b follows a, c follows b, but c does not follow a: both b and c go.
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    b = a + rng.normal(size=4000) * 0.25
    c = b + rng.normal(size=4000) * 0.25
    df = spark.createDataFrame(np.column_stack([a, b, c]).tolist(), "a double, b double, c double")
    matrix = cleaning.correlation_matrix(df, ["a", "b", "c"])
    assert matrix[0, 1] > 0.95 and matrix[1, 2] > 0.95 and matrix[0, 2] < 0.95
    assert cleaning.correlated_columns(matrix, ["a", "b", "c"], 0.95) == ["b", "c"]
    assert matrix[0, 2] == pytest.approx(np.corrcoef(a, c)[0, 1])


def test_wide_correlation_survives_large_offsets_and_constants(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 30)) + 1e9
    x[:, 7] = 4.0
    x[:, 9] = -x[:, 3]
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names))
    matrix = cleaning.correlation_matrix(df, names)
    assert np.isnan(matrix[7]).all()
    assert matrix[3, 9] == pytest.approx(-1.0)
    assert matrix[0, 1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=1e-6)
    assert cleaning.correlated_columns(matrix, names, 0.95) == ["c9"]


def test_anomaly_recipe(spark):
    rng = np.random.default_rng(5)
    n = 400
    a = rng.normal(size=n) * 10
    spike = np.where(np.arange(n) % 100 == 0, 1e5, rng.normal(size=n))
    rare = (np.arange(n) % 50 == 0).astype(float)
    small = rng.normal(size=n) * 0.01
    near = 5 + rng.normal(size=n) * 1e-8
    rows = [
        [float(v) for v in r] + [None if i % 10 == 0 else float(a[i] * 3)] for i, r in enumerate(zip(a, spike, rare, small, near))
    ]
    df = spark.createDataFrame(rows, "a double, spike double, rare double, small double, near double, gap double")
    params = cleaning.fit_anomaly_cleaning(df)
    assert params.dropped["near"] == "near constant"
    assert params.dropped["rare"] == "low variance"  # constant once clipped
    assert params.dropped["small"] == "low variance"
    assert params.feature_columns[:2] == ["a", "spike"]
    clean = cleaning.apply_anomaly_cleaning(df, params)
    assert clean.agg(F.max("spike")).first()[0] < 100
    for c in params.feature_columns:
        assert clean.where(F.col(c).isNull()).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(1.0, -2.0), (5.0, None)], "a double, b double")
    assert tuple(cleaning.table_profile(df, ["a", "b"]).first()) == (2, 2, -2.0, 5.0)


def test_standard_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 0.1) for i in range(1, 6)], "a double, flat double")
    params = scaling.fit_standard(df, ["a", "flat"])
    assert params.spread == [pytest.approx(2**0.5), 1.0]
    got = scaling.scale_columns(df, params).orderBy("a").collect()
    assert got[0].a == pytest.approx(-2 / 2**0.5) and got[0].flat == pytest.approx(0.0, abs=1e-12)


def test_scaling_chain_matches_on_columns_and_arrays(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=200), rng.exponential(size=200), np.full(200, 3.0)])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    params = scaling.fit_robust_min_max(df, ["a", "b", "c"])
    by_column = scaling.scale_columns(df, params).toPandas().to_numpy()
    arrays = df.select(scaling.scale_features(F.array("a", "b", "c"), params).alias("v")).collect()
    assert np.allclose(by_column, np.array([r.v for r in arrays]))
    assert by_column[:, :2].min() == pytest.approx(-1) and by_column[:, :2].max() == pytest.approx(1)
    assert (by_column[:, 2] == -1).all()  # no spread: the low end
    plain = scaling.scale_columns(df, scaling.fit_min_max(df, ["a", "b", "c"])).toPandas().to_numpy()
    assert np.allclose(plain, by_column)


def test_sample_scaling_sanitises_clips_and_reports_failure(spark):
    params = scaling.ScaleParams(["a", "b"], [1.0, 0.0], [2.0, 1.0])
    df = spark.createDataFrame([([3.0, NAN],), ([INF, -100.0],), ([1.0],), (None,)], "f array<double>")
    got = [r[0] for r in df.select(scaling.scale_features(F.col("f"), params)).collect()]
    assert got == [[1.0, 0.0], [5.0, -5.0], None, None]
