"""Exact global order, counts and cuts without sorting anything in one task.

The common idea: a *slice* is any expression that grows with the wanted order
(the day of a timestamp, the first characters of a hash). Counting rows per
slice is a cheap map-side aggregate; the running total of that small table
tells how many rows precede each slice, and only rows of the same slice have to
be compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import settle, small_table
from ..sources.paths import stage

# Rows taken of a group per slice of its hash order, about.
TAKEN_PER_SLICE = 200
# Positions per block of two-level totals, at least, and blocks of all positions, about.
BLOCK = 1000
BLOCKS = 24


def time_slice(ts: Column, seconds: int) -> Column:
    """Number of the fixed-length period a timestamp falls in; NULLs come before all others."""
    period = F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds)).cast("long")
    return F.coalesce(period, F.lit(-(2**62)))


def hash_order(ids: Sequence[str], seed: int | str) -> Column:
    """Repeatable random order key: 32 hexadecimal characters of md5 over ``seed:id:...``."""
    parts = [F.col(c).cast("string") for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def in_ranges(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows in ranges of ``order_by``, numbered in ``_range``.

    Write the result before reading it: ranges are cut anew each time it is computed.
    """
    return df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id())


def offsets(ranged: DataFrame, sizes: Mapping[int, int], start: int = 0) -> DataFrame:
    """(_range, _earlier): the rows of all earlier ranges, from one number per range."""
    rows, total = [], start
    for number, n in sorted(sizes.items()):
        rows.append({"_range": number, "_earlier": total})
        total += n
    return F.broadcast(small_table(ranged.sparkSession, rows, "_range int, _earlier long"))


def number_ranges(
    ranged: DataFrame, order_by: Sequence[str], name: str, sizes: Mapping[int, int], *, start: int = 0
) -> DataFrame:
    """Positions ``start + 1``, ... along ``order_by`` of a written ``in_ranges`` table.

    ``sizes`` has the number of rows of each range.
    """
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    return (
        ranged.join(offsets(ranged, sizes, start), "_range")
        .withColumn(name, F.col("_earlier") + within.cast("long"))
        .drop("_range", "_earlier")
    )


def number_rows(
    df: DataFrame, order_by: Sequence[str], slice_by: Column, name: str = "row_no"
) -> DataFrame:
    """1-based position of every row in the total order ``order_by``.

    ``slice_by`` must never be NULL nor decrease along the order. Rows shuffle
    once, by slice. Slices are summed in ranges and ranges on top of them, so
    there is no window over all slices either.
    """
    data = df.withColumn("_slice", slice_by)
    counts = data.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # One narrow row per slice.
    ranged = stage(in_ranges(counts, ["_slice"]), "slices")
    sizes = dict(ranged.groupBy("_range").agg(F.sum("_n")).collect())
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("_slice"))
    before = ranged.join(offsets(ranged, sizes), "_range").select(
        "_slice", (F.col("_earlier") + upto - F.col("_n")).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order_by))
    return (
        data.join(settle(before), "_slice")
        .withColumn(name, F.col("_before") + within.cast("long"))
        .drop("_slice", "_before")
    )


def rank_cuts(
    df: DataFrame,
    group: str,
    key: str,
    takes: Mapping[str, Mapping[str, int]],
    *,
    prefix: int | None = None,
) -> DataFrame:
    """For each group, the key value below or at which exactly ``take`` rows lie.

    ``takes`` maps a cut's name to ``{group value: take}``; ``key`` is a
    ``hash_order`` value, unique in its group. Gives one row per group with one
    column per cut name, NULL where the take is zero. A group of any size is
    spread over ``16 ** prefix`` slices, and only its edge slices are ranked.
    Without ``prefix``, the slices grow with the rows taken.
    """
    if prefix is None:
        most = max((int(n) for per_group in takes.values() for n in per_group.values()), default=0)
        prefix = min(8, max(2, math.ceil(math.log(max(most, 1) / TAKEN_PER_SLICE + 1, 16))))
    wanted = [
        {"_name": name, "_group": g, "_take": int(n)}
        for name, per_group in takes.items()
        for g, n in per_group.items()
        if n > 0
    ]
    spark = df.sparkSession
    takes_df = F.broadcast(small_table(spark, wanted, "_name string, _group string, _take long"))
    keyed = df.select(
        F.col(group).alias("_group"),
        F.col(key).alias("_key"),
        F.substring(key, 1, prefix).alias("_slice"),
    )
    runs = keyed.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_slice"))
    edges = settle(
        runs.withColumn("_upto", upto)
        .join(takes_df, "_group")
        .where((F.col("_take") <= F.col("_upto")) & (F.col("_take") > F.col("_upto") - F.col("_n")))
        .select("_name", "_group", "_slice", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    near = keyed.join(edges.select("_group", "_slice").distinct(), ["_group", "_slice"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_group", "_slice").orderBy("_key"))
    # A limit known beforehand lets each task drop the rest of its slice before the shuffle.
    furthest = edges.agg(F.max("_nth")).first()[0] or 0
    ranked = near.withColumn("_nth", nth).where(F.col("_nth") <= F.lit(furthest))
    cuts = ranked.join(edges, ["_group", "_slice", "_nth"])
    names = list(takes)
    wide = cuts.groupBy(F.col("_group").alias(group)).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_key"))).alias(n) for n in names]
    )
    return settle(wide)


def block_length(positions: int) -> int:
    """Positions per block where so many are spanned: a key's blocks don't grow with them.

    Blocks of fixed length come to be as many as a key's rows when the keys grow
    with the positions, and their totals then cost as much as the rows.
    """
    return max(BLOCK, math.ceil(positions / BLOCKS))


def running_totals(
    df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], *, block: int = BLOCK
) -> DataFrame:
    """Running sums along an integer ``position`` within ``keys``, in two levels.

    Block totals are summed first, so a key with any number of positions is
    spread over its blocks.
    """
    keys = list(keys)
    data = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    totals = data.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values]
    )
    upto = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0
    )
    inner = [F.sum(v).over(upto).alias(v) for v in values]
    kept = [c for c in df.columns if c not in values]
    summed = data.select(*kept, "_block", *inner)
    return summed.join(offsets, [*keys, "_block"]).select(
        *kept, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]
    )


def following(
    df: DataFrame, keys: Sequence[str], position: str, name: str, *, block: int = BLOCK
) -> DataFrame:
    """Adds the next larger ``position`` within ``keys``, NULL at the last, in two levels like ``running_totals``."""
    keys = list(keys)
    data = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    firsts = data.groupBy(*keys, "_block").agg(F.min(position).alias("_first"))
    later = firsts.select(
        *keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_later")
    )
    near = F.lead(position).over(Window.partitionBy(*keys, "_block").orderBy(position))
    return (
        data.withColumn(name, near).join(later, [*keys, "_block"])
        .withColumn(name, F.coalesce(name, "_later")).drop("_block", "_later")
    )


def totals_and_following(
    df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], name: str, *, block: int = BLOCK
) -> DataFrame:
    """``running_totals`` and ``following`` at once: the rows shuffle a single time.

    Keys and positions must not be NULL. Blocks are summed where their rows are,
    so only one row per key and block is shuffled besides.
    """
    keys = list(keys)
    number = F.coalesce(F.floor(F.col(position) / block).cast("long"), F.lit(0))
    # Both branches read all columns, so the shuffle is done once and used by both.
    data = df.select(*keys, position, *values, number.alias("_block")).repartition(*keys, "_block")
    blocks = data.groupBy(*keys, "_block").agg(F.min(position).alias("_first"), *[F.sum(v).alias(v) for v in values])
    along = Window.partitionBy(*keys).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    around = blocks.select(
        *keys, "_block", F.lead("_first").over(along).alias("_later"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values],
    ).repartition(*keys, "_block")
    within = Window.partitionBy(*keys, "_block").orderBy(position)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    near = data.select(
        *keys, position, "_block", F.lead(position).over(within).alias("_next"), *[F.sum(v).over(upto).alias(v) for v in values]
    )
    return near.join(around, [*keys, "_block"]).select(
        *keys, position, F.coalesce("_next", "_later").alias(name), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]
    )
