from pyspark.sql import functions as F

from flowguard.operators import labels, messages


def parse(spark, rows, width=None):
    df = spark.createDataFrame(rows, "device_id string, csv_data string")
    return messages.parse_messages(df, width)


def test_one_bad_message_does_not_stop_the_others(spark):
    parsed = parse(spark, [("a", "1,2"), ("a", "1,x"), ("b", None), ("b", "1,2,3"), ("c", "inf,nan"), ("c", "")], 2)
    assert [r.is_valid for r in parsed.collect()] == [True, False, False, False, True, False]
    assert messages.valid_messages(parsed).count() == 2
    bad = messages.rejected_messages(parsed)
    assert bad.count() == 4 and "csv_data" in bad.columns


def test_width_is_optional(spark):
    assert [r.is_valid for r in parse(spark, [("a", "1"), ("a", "1,2,3")]).collect()] == [True, True]


def test_empty_or_missing_device_is_unknown(spark):
    parsed = parse(spark, [("", "1"), (None, "1"), ("d", "1")])
    assert [r.device_id for r in parsed.collect()] == ["unknown", "unknown", "d"]


def test_empty_batch(spark):
    assert parse(spark, [], 3).count() == 0


def test_bus_projection(spark):
    df = spark.createDataFrame([(b"k", b"1,2", 7, 9)], "key binary, value binary, partition int, offset long")
    df = df.withColumn("timestamp", F.current_timestamp())
    assert messages.bus_messages(df).columns == ["device_id", "csv_data", "timestamp"]
    row = messages.bus_messages(df, position=True).first()
    assert (row.device_id, row.csv_data, row.partition, row.offset) == ("k", "1,2", 7, 9)


def test_every_label_is_grouped(spark):
    raw = [r for group in labels.ATTACK_GROUPS.values() for r in group]
    assert len(raw) == 17 and len(set(raw)) == 17
    df = spark.createDataFrame([(r,) for r in [*raw, "BENIGN", "Something new", None]], "Label string")
    got = {r[0]: r[1] for r in df.select("Label", labels.group_label(F.col("Label"))).collect()}
    for group, members in labels.ATTACK_GROUPS.items():
        assert {got[m] for m in members} == {group}
    assert got["BENIGN"] == "BENIGN" and got["Something new"] == "Something new" and got[None] is None


def test_vocabulary_is_sorted_over_all_parts(spark):
    a = spark.createDataFrame([("N",), ("A",)], "Label string")
    b = spark.createDataFrame([("R",), ("A",), (None,)], "Label string")
    assert labels.vocabulary([a, b]) == ["A", "N", "R"]


def test_encode_and_decode(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "Label string")
    classes = ["A", "B"]
    code = labels.encode(F.col("Label"), classes)
    rows = df.select(code.alias("c"), labels.decode(code, classes).alias("back")).collect()
    assert [tuple(r) for r in rows] == [(0, "A"), (None, None), (None, None)]
