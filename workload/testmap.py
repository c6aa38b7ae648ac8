"""The test tables seen as network flows.

Every input is one SELECT list that Spark and DuckDB both understand, so a query
and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.bounded import compute_once

CLASSES = ["BENIGN", "DOUBT", "DoS", "Malware"]

_INF = "CAST('inf' AS DOUBLE)"

LINE_KEY = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
]

FLOWS = (
    "lineitem",
    [
        "CAST(l_quantity AS DOUBLE) AS f_qty",
        f"CASE WHEN l_partkey % 97 = 0 THEN {_INF} "
        "WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS f_price",
        "100 * l_discount AS f_disc",
        "100 * l_tax AS f_tax",
        "2 * l_quantity + 1 AS f_qty2",
        "CAST(3.0 AS DOUBLE) AS f_const",
        "CAST(5 AS DOUBLE) + l_tax * CAST(0.0000001 AS DOUBLE) AS f_near",
        "CAST(CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS f_rare",
        "CASE WHEN l_orderkey % 1000 = 0 THEN CAST(100000 AS DOUBLE) ELSE l_tax END AS f_tail",
        "l_returnflag AS f_text",
        "CAST(l_suppkey AS VARCHAR(20)) AS device",
        "CASE l_linenumber WHEN 1 THEN 'BENIGN' WHEN 2 THEN 'DoS Hulk' WHEN 3 THEN 'DDoS' "
        "WHEN 4 THEN 'PortScan' WHEN 5 THEN 'FTP-Patator' WHEN 6 THEN 'Bot' ELSE 'Heartbleed' END AS Label",
    ],
)
FLOW_FEATURES = [
    "f_qty", "f_price", "f_disc", "f_tax", "f_qty2", "f_const", "f_near", "f_rare", "f_tail",
]

_RAW = [
    "pow(l_quantity / 50, 4)",
    "0.5 * pow(l_discount / CAST(0.1 AS DOUBLE), 4)",
    "0.5 * pow(l_tax / CAST(0.08 AS DOUBLE), 4)",
    "CAST(0.5 AS DOUBLE) * pow(CAST(l_linenumber AS DOUBLE) / 7, 4)",
]
_SUM = "(" + " + ".join(_RAW) + ")"
SCORES = (
    "lineitem",
    [f"{r} / {_SUM} AS p{i}" for i, r in enumerate(_RAW)]
    + ["CAST(l_suppkey AS VARCHAR(20)) AS device_id", *LINE_KEY, "l_returnflag"],
)

MESSAGES = (
    "events",
    [
        "CASE WHEN user_id % 40 = 1 THEN NULL WHEN user_id % 25 = 0 THEN '' "
        "ELSE CAST(user_id AS VARCHAR(20)) END AS device_id",
        "CASE WHEN event_id % 77 = 0 THEN NULL "
        "WHEN event_id % 73 = 0 THEN concat_ws(',', CAST(event_id AS VARCHAR(20)), '1.5') "
        "ELSE concat_ws(',', CASE WHEN event_id % 61 = 0 THEN 'inf' ELSE CAST(event_id AS VARCHAR(20)) END, "
        "CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR(20)) END, '1.5') END AS csv_data",
        "ts AS timestamp",
        "event_id",
    ],
)
MESSAGE_WIDTH = 3

SEQUENCES = (
    "events",
    ["CAST(user_id AS VARCHAR(20)) AS device_id", "ts", "event_id", "value"],
)
WEEK = 7 * 24 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, spec: tuple[str, list[str]]) -> DataFrame:
    name, columns = spec
    return table(spark, sf_dir, name).selectExpr(*columns)


def sql(spec: tuple[str, list[str]]) -> str:
    name, columns = spec
    return f"SELECT {', '.join(columns)} FROM {name}"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: ``probability`` in the order of CLASSES."""
    rows = view(spark, sf_dir, SCORES)
    probability = compute_once(F.array("p0", "p1", "p2", "p3"))
    return rows.withColumn("probability", probability).drop("p0", "p1", "p2", "p3")


def flows_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.selectExpr(*FLOWS[1])
    return rows.unionByName(line.where("l_partkey % 10 = 0").selectExpr(*FLOWS[1]))


FLOWS_WITH_COPIES_SQL = f"({sql(FLOWS)}) UNION ALL ({sql(FLOWS)} WHERE l_partkey % 10 = 0)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison (adding 0.0 turns a negative zero positive)."""
    return df.select(
        *[
            (F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )
