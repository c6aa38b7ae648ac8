import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import ordering, sampling
from flowguard.sources.paths import write_and_read


def classes(spark, sizes):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, name, float(i % 17), float(i % 5)))
            i += 1
    return spark.createDataFrame(rows, "id long, Label string, x double, y double").repartition(5)


def test_apportion_is_exact():
    for total in (0, 1, 7, 50, 99):
        got = sampling.apportion({"a": 33, "b": 33, "c": 33, "d": 1}, total)
        assert sum(got.values()) == total
        assert all(abs(got[c] - total * n / 100) < 1 for c, n in {"a": 33, "b": 33, "c": 33, "d": 1}.items())
    assert sampling.apportion({}, 0) == {}
    huge = {"a": 10**12, "b": 3 * 10**11}
    assert sum(sampling.apportion(huge, 5 * 10**10).values()) == 5 * 10**10


def test_stratified_split_is_a_partition_with_exact_quotas(spark):
    sizes = {"BENIGN": 700, "Bot": 120, "one": 1, "tiny": 3}
    df = classes(spark, sizes)
    got = sampling.stratified_split(df, "Label", ["id"]).collect()
    assert sorted(r.id for r in got) == list(range(sum(sizes.values())))
    n = sum(sizes.values())
    parts = Counter(r.split for r in got)
    assert parts["test"] == math.ceil(0.05 * n)
    assert parts["validation"] == math.ceil(0.263 * (n - parts["test"]))
    test = Counter(r.Label for r in got if r.split == "test")
    assert dict(test) == {c: k for c, k in sampling.apportion(sizes, parts["test"]).items() if k}
    again = sampling.stratified_split(df.repartition(3), "Label", ["id"]).collect()
    assert {(r.id, r.split) for r in got} == {(r.id, r.split) for r in again}


@pytest.mark.parametrize("prefix", [1, 2, 6])
def test_rank_cuts_match_brute_force_on_a_hot_class(spark, prefix):
    df = classes(spark, {"hot": 900, "cold": 40}).withColumn("k", ordering.hash_order(["id"], 1))
    takes = {"first": {"hot": 333, "cold": 0}, "second": {"hot": 900, "cold": 40}}
    cuts = {r.Label: r for r in ordering.rank_cuts(df, "Label", "k", takes, prefix=prefix).collect()}
    keys = {c: sorted(r.k for r in df.where(F.col("Label") == c).collect()) for c in ("hot", "cold")}
    assert cuts["hot"].first == keys["hot"][332] and cuts["hot"].second == keys["hot"][-1]
    assert cuts["cold"].first is None and cuts["cold"].second == keys["cold"][-1]


def test_doubt_class(spark):
    df = classes(spark, {"BENIGN": 505, "Bot": 50})
    got = sampling.create_doubt_class(df, "Label", ["id"])
    counts = Counter(r.Label for r in got.collect())
    assert counts == {"BENIGN": 455, "DOUBT": 50, "Bot": 50}
    none = sampling.create_doubt_class(df.where("Label = 'Bot'"), "Label", ["id"])
    assert none.count() == 50


def test_undersampling_touches_only_capped_classes(spark):
    df = classes(spark, {"BENIGN": 300, "Bot": 50})
    got = Counter(r.Label for r in sampling.undersample(df, "Label", ["id"], caps={"BENIGN": 100}).collect())
    assert got == {"BENIGN": 100, "Bot": 50}
    assert sampling.undersample(df, "Label", ["id"]).count() == 350
    assert sampling.undersample(df, "Label", ["id"], caps={"BENIGN": 0}).count() == 50


def test_oversampling_plan_and_neighbour_count(spark):
    df = classes(spark, {"BENIGN": 10, "DOUBT": 5, "full": 1000, "most": 999, "few": 4})
    plan = sampling.oversampling_plan(df, "Label")
    assert {(r.Label, r.n, r.target) for r in plan.collect()} == {("most", 999, 2000), ("few", 4, 12)}
    assert sampling.neighbour_count(plan).first().k_neighbours == 3
    single = sampling.oversampling_plan(classes(spark, {"one": 1}), "Label")
    assert sampling.neighbour_count(single).first().k_neighbours == 1
    assert sampling.neighbour_count(plan.limit(0)).first().k_neighbours is None


def test_synthetic_rows_lie_between_same_class_neighbours(spark):
    df = classes(spark, {"BENIGN": 30, "few": 12, "one": 1})
    packed = df.select("id", "Label", F.array("x", "y").alias("f"))
    points = {r.id: (r.Label, np.array(r.f)) for r in packed.collect()}
    plan = sampling.oversampling_plan(df, "Label")
    made = sampling.smote(packed, "Label", "id", "f", plan, 3).collect()
    assert Counter(r.Label for r in made) == {"few": 24}
    for r in made:
        (la, a), (lb, b) = points[r.base_id], points[r.neighbour_id]
        assert la == lb == r.Label and r.base_id != r.neighbour_id
        gap, step = b - a, np.array(r.f) - a
        u = step[np.abs(gap) > 0] / gap[np.abs(gap) > 0]
        assert np.allclose(u, u[0]) if len(u) else True
        assert all(0 <= v < 1 for v in u)


def test_balance(spark):
    df = classes(spark, {"BENIGN": 60, "few": 12})
    got = sampling.balance(df, "Label", "id", ["x", "y"], caps={"BENIGN": 40})
    assert Counter(r.Label for r in got.collect()) == {"BENIGN": 40, "few": 36}
    assert got.where("id IS NULL").count() == 24
    untouched = sampling.balance(df.where("Label = 'BENIGN'"), "Label", "id", ["x", "y"])
    assert untouched.count() == 60


def test_random_split_sizes_and_key_split(spark):
    df = spark.range(101)
    parts = Counter(r.split for r in sampling.random_split(df, ["id"]).collect())
    assert parts == {"test": 21, "validation": 15, "train": 65}
    keyed = df.select((F.col("id") % 20).alias("k"), "id")
    got = sampling.split_by_key(keyed, ["k"]).groupBy("k").agg(F.count_distinct("split").alias("n"))
    assert got.where("n > 1").count() == 0


def test_number_rows_is_the_global_order(spark):
    df = spark.range(500).select(
        (F.col("id") * 7919 % 500).alias("v"), F.timestamp_seconds(F.col("id") * 7919 % 500 * 60).alias("ts")
    )
    slices = F.when(F.col("v") < 300, F.lit(0)).otherwise(F.floor(F.col("v") / 10)).cast("long")
    for by in (slices, ordering.time_slice(F.col("ts"), 3600)):
        got = ordering.number_rows(df, ["v"], by).collect()
        assert all(r.row_no == r.v + 1 for r in got) and len(got) == 500


def test_running_totals_cross_blocks(spark):
    df = spark.createDataFrame([(k, p, 1 + p % 3) for k in "ab" for p in range(1, 40)], "k string, p long, v long")
    for block in (1, 7, 1000):
        got = ordering.running_totals(df, ["k"], "p", ["v"], block=block).collect()
        assert len(got) == 78
        assert all(r.v == sum(1 + q % 3 for q in range(1, r.p + 1)) for r in got)


def test_number_ranges_goes_on_from_a_start(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.lit("x").alias("k")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else there is one range
    try:
        ranged = write_and_read(ordering.in_ranges(df, ["v"]), str(tmp_path / "ranged"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = dict(ranged.groupBy("_range").count().collect())
    got = ordering.number_ranges(ranged, ["v"], "no", sizes, start=1000)
    assert got.columns == ["v", "k", "no"] and len(sizes) > 1
    assert all(r.no == r.v + 1001 for r in got.collect())


def test_following_crosses_blocks(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 5, 6, 40)] + [("b", 7)], "k string, p long")
    for block in (1, 3, 1000):
        got = {(r.k, r.p): r.n for r in ordering.following(df, ["k"], "p", "n", block=block).collect()}
        assert got == {("a", 1): 5, ("a", 5): 6, ("a", 6): 40, ("a", 40): None, ("b", 7): None}


def test_totals_and_following_at_once(spark):
    at = {"a": (1, 5, 6, 40, 41), "b": (7,), "c": tuple(range(2, 60, 3))}
    df = spark.createDataFrame([(k, p, p % 4) for k, ps in at.items() for p in ps], "k string, p long, v long")
    for block in (1, 3, 10, 1000):
        rows = ordering.totals_and_following(df, ["k"], "p", ["v"], "n", block=block).collect()
        assert {(r.k, r.p): (r.n, r.v) for r in rows} == {
            (k, p): (min((q for q in ps if q > p), default=None), sum(q % 4 for q in ps if q <= p))
            for k, ps in at.items() for p in ps
        }
        assert len(rows) == df.count()
    assert ordering.totals_and_following(df.limit(0), ["k"], "p", ["v"], "n").collect() == []


def test_blocks_per_key_do_not_grow_with_the_positions():
    assert ordering.block_length(0) == ordering.block_length(24_000) == 1000
    for n in (24_001, 144_000, 8_640_000):
        assert n / ordering.block_length(n) <= 24


def test_small_takes_of_large_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    cuts = ordering.rank_cuts(df, "g", "k", {"cut": {"g": 3}}, prefix=1)
    assert cuts.first()["cut"] == sorted(r.k for r in df.collect())[2]
