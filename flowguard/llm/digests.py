"""Exact duplicates against a persistent digest index.

The index is a table bucketed and sorted by digest with one row per distinct
text: the digest, the document that stays, and the arrival that brought it. An
arrival is reduced to one row per digest by map-side aggregation, anti-joined
with the index bucket by bucket (the index side never shuffles), and what is new
is appended. What the index holds of an arrival is told by the arrival's name,
so one that failed after the append is run again with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import SPACE, whole, written

BUCKETS = 64
# Texts per bucket that ``bucket_count`` aims at: some 250 MB of digests.
BUCKET_TEXTS = 5_000_000


def bucket_count(expected_texts: int) -> int:
    """Buckets for an index that is to hold so many texts: they are its parallelism for good."""
    return max(BUCKETS, 1 << math.ceil(math.log2(max(1, expected_texts / BUCKET_TEXTS))))


def normalised(text: str) -> Column:
    """The text with each run of white space replaced by one space; NULL is empty."""
    return F.regexp_replace(whole(text), SPACE, " ")


def open_index(spark: SparkSession, table: str, path: str, id_type: str, buckets: int = BUCKETS) -> DataFrame:
    """The index at ``path``, registered as ``table``; created empty where it doesn't exist.

    The files and their bucketing outlive the session: a later session opens the
    same path with the same number of buckets.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, id {id_type}, arrival STRING) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def close_index(spark: SparkSession, table: str) -> None:
    """Takes the index out of the session's catalog; its files stay, to be opened again."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def add_arrival(digests: DataFrame, table: str, arrival: str, buckets: int = BUCKETS) -> None:
    """Appends the digests that the index doesn't have, with their smallest id and the arrival's name.

    ``digests`` has the columns digest and id. Repeating an arrival changes
    nothing, so a failed run is simply run again.
    """
    spark = digests.sparkSession
    index = spark.table(table)
    new = (
        digests.groupBy("digest").agg(F.min("id").alias("id"))
        .hint("merge")
        .join(index.select("digest"), "digest", "left_anti")
        .withColumn("arrival", F.lit(arrival))
    )
    # One task per bucket writes one sorted file per bucket.
    (
        new.repartition(buckets, "digest").write.format("parquet").mode("append")
        .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
    )
    spark.catalog.refreshTable(table)


def exact_duplicates(
    docs: DataFrame,
    table: str,
    path: str,
    *,
    arrival: str,
    id_col: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    folder: str | None = None,
) -> DataFrame:
    """Adds ``docs`` to the index and tells for each row which document stays.

    Gives one row per input row: the id column, keep_id, group_size (rows of this
    arrival with the text), kept and text_sha256 (lower-case hex of the
    normalised text in UTF-8). The result is a written table.

    keep_id is the document the index holds: the smallest id of the arrival that
    brought the text first. Exactly one row of a text that this ``arrival``
    brought is kept; where rows repeat the smallest id, the first read stays.
    Running an arrival again, after whatever failure, keeps the same documents;
    another set of rows needs another name. NULL texts equal empty ones. NULL
    ids come last: keep_id is NULL if a text has no other id. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    # The row number of the written table tells repeated rows apart.
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests", folder,
    )
    open_index(spark, table, path, id_type, buckets)
    add_arrival(rows.select("digest", "id"), table, arrival, buckets)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))
    groups = (
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .join(spark.table(table).withColumnRenamed("id", "keep_id"), "digest")
        .select("digest", "group_size", "keep_id", F.when(F.col("arrival") == arrival, F.col("first.row")).alias("kept_row"))
    )
    # Narrow rows on both sides; adaptive execution splits a digest that many rows share.
    outcome = rows.join(groups.hint("merge"), "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return written(outcome, "exact-duplicates", folder)
