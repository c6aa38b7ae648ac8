"""Connected components of a link table, by alternating large and small stars.

Each round is two grouped minima and two joins over the links; nothing but two
numbers per round reaches the driver, and the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import remove_path, work_folder


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.join(least, "a").where(F.col("b") > F.col("a"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m"))
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows (node, root) for every node that has a link; root is the smallest node reachable.

    ``links`` has two columns of one orderable type, named a and b; NULLs and
    self-links are ignored. Each round is written below ``folder`` (by default
    the shared working folder) and removed when the next one is there.
    """
    spark = links.sparkSession
    base = folder or work_folder(spark, "components")
    now = (
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def settled(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def mark(df: DataFrame) -> tuple:
        # Two sums over independent hashes, as exact decimals.
        hashed = [F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)")) for seed in (1, 2)]
        return tuple(df.agg(F.count(F.lit(1)), *hashed).first())

    now, path = settled(now, "round-0")
    seen, number = mark(now), 0
    while seen[0]:
        number += 1
        after, next_path = settled(_small_star(_large_star(now)), f"round-{number}")
        found = mark(after)
        remove_path(spark, path)
        now, path = after, next_path
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
