"""Small summary tables, proven small before they are broadcast, and single evaluation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 20_000


def settle(summary: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Run a summary once. At most ``max_rows`` rows: a broadcastable local table.

    A larger summary is handed back unchanged, so that joins to it are planned
    as ordinary shuffled joins under adaptive execution.
    """
    rows = summary.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return summary
    return F.broadcast(summary.sparkSession.createDataFrame(rows, schema=summary.schema))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A local table from fitted values that already live on the driver."""
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    if not rows:
        return empty
    columns = {n: [r[n] for r in rows] for n in names}
    return spark.createDataFrame(pa.table(columns), schema=empty.schema)


def compute_once(value: Column) -> Column:
    """Keeps an expensive column from being recomputed inside later filters.

    The optimiser moves a filter below a projection by copying the projected
    expressions into it, so a model's score used three times in a triage rule
    would run three more times per row. An expression it takes for
    non-deterministic is left in place; the value itself does not change.
    Filters on input columns belong before such a column.
    """
    return F.when(F.spark_partition_id() >= 0, value)
