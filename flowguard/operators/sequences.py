"""Sequences of the last rows of each key, safe for keys of any size.

A window over a whole key would put a hot key into one task. Here a key is cut
into slices of its order (say, hours). The last rows of the earlier slices, at
most ``length - 1`` of them, are carried into each slice as extra rows, so every
slice can be windowed on its own. Input rows shuffle once, by (key, slice); the
carried rows come from a top-few ranking that Spark limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import settle
from ..functions.vectors import last_items
from ..sources.paths import stage
from .ordering import in_ranges, offsets

# Rows per sequence, and the step between training sequences.
SEQUENCE_LENGTH = 10
TRAINING_STRIDE = 3


def recent_values(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    *,
    length: int = SEQUENCE_LENGTH,
    slice_by: Column | None = None,
    number: bool = False,
) -> DataFrame:
    """Adds ``recent``: the last ``length`` values up to and including each row, oldest first.

    ``order_by`` must be unique within a key. ``slice_by`` must never decrease
    along it and never be NULL; without it, each key is one slice. ``number=True``
    also adds ``row_no``, the 1-based position within the key. No keys means one
    global order.
    """
    keys, order_by = list(keys), list(order_by)
    data = df.withColumn("_slice", slice_by if slice_by is not None else F.lit(0))
    place = [*keys, "_slice"]
    own = data.withColumns({"_own": F.lit(True), "_row_no": F.lit(None).cast("long")})
    if slice_by is not None and length > 1:
        own = own.unionByName(
            _carried(data, keys, order_by, value, length, number), allowMissingColumns=True
        )
    run = Window.partitionBy(*place).orderBy(*order_by)
    boxed = F.collect_list(F.struct(F.col(value).alias("v"))).over(run.rowsBetween(-(length - 1), 0))
    out = own.withColumn("recent", boxed["v"])
    if number:
        first = F.first("_row_no").over(run.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(
            "row_no", F.row_number().over(run) - 1 + F.coalesce(first, F.lit(1).cast("long"))
        )
    return out.where("_own").drop("_slice", "_own", "_row_no")


def _carried(
    data: DataFrame,
    keys: list[str],
    order_by: list[str],
    value: str,
    length: int,
    number: bool,
) -> DataFrame:
    """Rows of earlier slices that the first rows of a slice look back to."""
    place = [*keys, "_slice"]
    columns = list(dict.fromkeys([*order_by, value]))
    columns = [c for c in columns if c not in keys]
    narrow = data.select(*place, *columns)
    newest_first = Window.partitionBy(*place).orderBy(*[F.desc(c) for c in order_by])
    tails = (
        narrow.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= length - 1)
        .groupBy(*place)
        .agg(
            F.transform(
                # At most length - 1 rows; the rank alone decides their order.
                F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("_r"), *columns))),
                lambda r: F.struct(*[r[c].alias(c) for c in columns]),
            ).alias("_tail")
        )
    )
    if number:
        sizes = data.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
        tails = tails.join(sizes, place)
    else:
        tails = tails.withColumn("_n", F.lit(0).cast("long"))
    per_slice = _look_back(tails, keys, length) if keys else _look_back_in_ranges(tails, length)
    if not number:
        per_slice = per_slice.withColumn("_before", F.lit(None).cast("long"))
    return per_slice.select(
        *place, "_before", F.size("_carry").alias("_size"), F.posexplode("_carry").alias("_at", "_row")
    ).select(
        *place,
        "_row.*",
        F.lit(False).alias("_own"),
        (F.col("_before") - F.col("_size") + F.col("_at") + 1).alias("_row_no"),
    )


def _look_back(tails: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, _slice, _carry, _before): the last rows of the earlier slices, and how many rows those have."""
    # Every slice present has a row, so the last length - 1 slices hold enough.
    back = Window.partitionBy(*keys).orderBy("_slice")
    carry = last_items(
        F.flatten(F.collect_list("_tail").over(back.rowsBetween(-(length - 1), -1))), length - 1
    )
    before = F.coalesce(F.sum("_n").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tails.select(*keys, "_slice", carry.alias("_carry"), before.alias("_before"))


def _look_back_in_ranges(tails: DataFrame, length: int) -> DataFrame:
    """The same for one global order: slices look back within ranges of slices, and ranges at each other.

    Neither the slices nor the ranges meet in one task.
    """
    ranged = stage(in_ranges(tails, ["_slice"]), "slice-tails")
    sizes = dict(ranged.groupBy("_range").agg(F.sum("_n")).collect())
    # Each range holds a row, so the length - 1 ranges before one hold enough.
    newest = Window.partitionBy("_range").orderBy(F.desc("_slice"))
    ends = (
        ranged.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") < length)
        .groupBy("_range")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_place")).alias("place"), F.col("_tail").alias("tail")))).alias("_ends"))
        .select("_range", last_items(F.flatten(F.transform("_ends", lambda e: e["tail"])), length - 1).alias("_end"))
    )
    numbers = sorted(sizes)
    # Ranges without a slice have no number: the next ones are counted by place.
    place = F.array_position(F.array(*[F.lit(n) for n in numbers]), F.col("_range")).cast("int") if numbers else F.lit(0)
    given = ends.select(place.alias("_from"), "_end").withColumn(
        "_to", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + (length - 1)))
    )
    earlier = given.groupBy("_to").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_from").alias("from"), F.col("_end").alias("end")))).alias("_parts")
    ).select("_to", F.flatten(F.transform("_parts", lambda e: e["end"])).alias("_outer"))
    inner = _look_back(ranged.withColumnRenamed("_range", "_r"), ["_r"], length).withColumnRenamed("_r", "_range")
    joined = inner.withColumn("_to", place).join(settle(earlier), "_to", "left").join(offsets(ranged, sizes), "_range")
    nothing = F.slice("_carry", 1, 0)
    return joined.select(
        "_slice",
        last_items(F.concat(F.coalesce("_outer", nothing), "_carry"), length - 1).alias("_carry"),
        (F.col("_before") + F.col("_earlier")).alias("_before"),
    )


def strided_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    *,
    length: int = SEQUENCE_LENGTH,
    stride: int = 1,
    slice_by: Column | None = None,
    on_short: str = "skip",
) -> DataFrame:
    """Overlapping full windows starting at rows 0, stride, 2*stride, ... of each key.

    Gives the keys, ``window_no`` from 0, the order columns of the window's last
    row, and ``sequence``. A tail that fills no window is dropped. A key with
    fewer than ``length`` rows has no window; ``on_short="error"`` raises instead.
    """
    if on_short == "error":
        short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < length)
        found = short.first()
        if found is not None:
            raise ValueError(f"not enough rows for a sequence of {length}: {found.asDict()}")
    numbered = recent_values(
        df, keys, order_by, value, length=length, slice_by=slice_by, number=True
    )
    start = F.col("row_no") - length
    return numbered.where((start >= 0) & (start % stride == 0)).select(
        *keys,
        (start / stride).cast("long").alias("window_no"),
        *[c for c in order_by if c not in keys],
        F.col("recent").alias("sequence"),
    )


def rolling_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    *,
    length: int = SEQUENCE_LENGTH,
    slice_by: Column | None = None,
) -> DataFrame:
    """Adds ``sequence``: the last ``length`` values, padded in front with the current value."""
    rows = recent_values(df, keys, order_by, value, length=length, slice_by=slice_by)
    missing = F.lit(length) - F.size("recent")
    padded = F.concat(F.array_repeat(F.col(value), missing), F.col("recent"))
    return rows.withColumn("sequence", padded).drop("recent")


def newest_rows(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], count: int
) -> DataFrame:
    """The last ``count`` rows of each key; limited per task before the shuffle."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order_by])
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= count)
        .drop("_rank")
    )
