import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.functions import numbers, vectors
from flowguard.functions.bounded import settle, small_table
from flowguard.functions.probabilities import attack_probability, max_confidence, predicted_class
from flowguard.functions.quantiles import quantiles

NAN, INF = float("nan"), float("inf")


def evaluate(spark, values, expression, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_not_finite_becomes_missing(spark):
    assert evaluate(spark, [1.0, NAN, INF, -INF, None], numbers.missing_if_not_finite) == [1.0, None, None, None, None]


def test_sanitise(spark):
    assert evaluate(spark, [1.0, NAN, INF, -INF, None], numbers.sanitise) == [1.0, 0.0, 1e6, -1e6, 0.0]


def test_clip_keeps_missing(spark):
    got = evaluate(spark, [-9.0, 9.0, 0.5, None, NAN], lambda v: numbers.clip(v, -5.0, 5.0))
    assert got[:4] == [-5.0, 5.0, 0.5, None] and math.isnan(got[4])


def test_threshold_guard(spark):
    assert evaluate(spark, [0.0, -1.0, NAN, None, 0.5], numbers.usable_threshold) == [0.01, 0.01, 0.01, 0.01, 0.5]


@pytest.mark.parametrize(
    "text",
    [" 3 ", "inf", "-Infinity", "NaN", "+nan", "1e3", "1E-3", ".5", "5.", "+7", "1_000", "\t2\n", "1d", "2f", "",
     " ", "x", "1__0", "_1", "1_", "0x10", "1e", "--1", "1 2", "infinit", "1,5"],
)
def test_numbers_parse_as_python_does(spark, text):
    try:
        want = float(text)
    except ValueError:
        want = None
    got = evaluate(spark, [text], numbers.parse_number, "string")[0]
    if want is None:
        assert got is None
    elif math.isnan(want):
        assert math.isnan(got)
    else:
        assert got == want


def test_class_expressions(spark):
    classes = ["BENIGN", "DOUBT", "DoS"]
    rows = spark.createDataFrame([([0.4, 0.2, 0.4],), ([0.1, 0.3, 0.6],)], "p array<double>")
    got = rows.select(
        predicted_class(F.col("p"), classes), max_confidence(F.col("p")), attack_probability(F.col("p"), classes)
    ).collect()
    assert [tuple(r) for r in got] == [("BENIGN", 0.4, 0.4), ("DoS", 0.6, 0.6)]


def test_sequence_errors_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10, 3))
    row = spark.createDataFrame([(x.tolist(),)], "s array<array<double>>").select(
        "s", vectors.rebuild_by_mean(F.col("s")).alias("r")
    )
    got = row.select(
        vectors.mean_squared_error(F.col("s"), F.col("r")), vectors.mean_absolute_error(F.col("s"), F.col("r"))
    ).first()
    gap = x - x.mean(axis=0)
    assert got[0] == pytest.approx((gap**2).mean()) and got[1] == pytest.approx(np.abs(gap).mean())


def test_all_finite(spark):
    rows = spark.createDataFrame(
        [([[1.0], [2.0]],), ([[1.0], [NAN]],), ([[INF]],), ([[1.0], None],), (None,)], "s array<array<double>>"
    )
    assert [r[0] for r in rows.select(vectors.all_finite(F.col("s"))).collect()] == [True, False, False, False, False]


def test_settle_only_small_tables(spark):
    assert settle(spark.range(5)).count() == 5
    big = spark.range(50)
    assert settle(big, max_rows=10) is big
    assert small_table(spark, [], "a long, b string").columns == ["a", "b"]


def awkward(spark, n=20_000):
    rng = np.random.default_rng(7)
    columns = {
        "even": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.exponential(size=n)),
        "few": rng.integers(0, 3, n).astype(float),
        "wild": rng.standard_cauchy(n) * 1e6,
        "flat": np.full(n, 2.5),
    }
    rows = list(zip(*[c.tolist() for c in columns.values()]))
    rows = [(*r, None if i % 3 else float(i), None) for i, r in enumerate(rows)]
    kinds = ", ".join(f"{c} double" for c in [*columns, "gaps", "nothing"])
    return spark.createDataFrame(rows, kinds).repartition(6)


def test_quantiles_are_exact(spark):
    df = awkward(spark).cache()
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    pdf = df.toPandas()
    for limit, accuracy in ((20, 50), (3000, 200), (60_000, 1000), (10**9, 10_000)):
        got = quantiles(df, df.columns, probabilities, picked=limit, accuracy=accuracy)
        for c in df.columns:
            known = pdf[c].dropna().to_numpy(dtype=float)
            want = np.quantile(known, probabilities) if len(known) else [None] * len(probabilities)
            assert got[c] == pytest.approx(list(want)), (limit, c)


def test_approximate_quantiles_and_no_columns(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles(df, ["v"], [0.5], exact=False)["v"][0] == pytest.approx(500, abs=2)
    assert quantiles(df, [], [0.5]) == {}
