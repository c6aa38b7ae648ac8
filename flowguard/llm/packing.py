"""Packing documents into padded batches of a token budget.

The words of a document are its tokens. The global histogram of lengths has at
most ``longest`` entries, so the bucket boundaries that pad least are found
exactly by dynamic programming; batches are then numbered inside each bucket in
two levels, without ordering a bucket in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import count_words, unit, whole, written

#: Words of a sequence: longer documents are cut into pieces of this length and a remainder.
LONGEST = 4_096
#: Words of a batch, padding included.
BUDGET = 65_536
BUCKETS = 16

#: Pieces that are numbered in one task.
NUMBERED = 500


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """At most ``buckets`` boundaries that minimise padding, and that padding.

    Each length is padded to the smallest boundary not below it. Lengths are
    rising. ``best[j]`` is the least padding of the first j lengths with the
    buckets so far; the last bucket runs from some i to j - 1.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64), 0
    number = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0], lengths * number[1:] - words[1:]])
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        more, since = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            padded = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (words[j] - words[:j])
            i = int(np.argmin(padded))
            more[j], since[j] = padded[i], i
        back.append(since)
        best = more
    ends, j = [], n
    for since in reversed(back):
        if j:
            ends.append(int(lengths[j - 1]))
            j = int(since[j])
    return np.array(ends[::-1], np.int64), int(best[n])


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, piece, start, length): each document cut into runs of at most ``longest`` words.

    A document without words gives one piece of length 0.
    """
    counted = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(whole(text)).alias("text_hash"), count_words(F.col(text)).alias("words")
    )
    last = F.greatest(F.ceil(F.col("words") / longest) - 1, F.lit(0))
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * longest
    return cut.select(
        "id", "text_hash", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(longest)).alias("length")
    )


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    longest: int = LONGEST,
    budget: int = BUDGET,
    buckets: int = BUCKETS,
    seed: int = 42,
    folder: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start (word), length, bucket_length, batch and slot.

    A batch holds budget // bucket_length sequences of one bucket, the last of
    a bucket maybe fewer; (bucket_length, batch) names it and slot counts from
    0. NULL and empty texts give one piece of length 0 in no batch (NULLs).
    Repeated rows are packed as often as they occur. NULL ids are passed on; an
    empty table gives no rows; other columns are ignored. The order inside a
    bucket is a hash of seed, id, text and the row's place in the table.
    """
    if budget < longest:
        raise ValueError("a batch must hold the longest sequence")
    spark = docs.sparkSession
    rows = written(
        pieces(docs, id_col=id_col, text=text, longest=longest).withColumn("row", F.monotonically_increasing_id()),
        "pieces", folder,
    )
    # At most ``longest`` rows, whatever the input.
    histogram = rows.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()
    lengths, counts = histogram.column("length").to_numpy(), histogram.column("n").to_numpy()
    ends, _ = bucket_lengths(lengths, counts, buckets)
    bucket = np.searchsorted(ends, lengths)
    sizes = np.bincount(bucket, weights=counts, minlength=len(ends)).astype(np.int64)
    plan = spark.createDataFrame(
        [(int(e), max(1, -(-int(n) // NUMBERED)), budget // int(e)) for e, n in zip(ends, sizes, strict=True)],
        "bucket_length int, slices long, capacity long",
    )
    end_of = F.lit(None).cast("int")
    for e in ends[::-1].tolist():
        end_of = F.when(F.col("length") <= e, F.lit(e)).otherwise(end_of)
    placed = rows.withColumn("bucket_length", F.when(F.col("length") > 0, end_of))
    # One row per bucket: bounded by ``buckets``.
    order = unit(F.lit(seed), F.col("id"), F.col("text_hash"), F.col("piece"), F.col("row"))
    placed = (
        placed.join(F.broadcast(plan), "bucket_length", "left").withColumn("order", order)
        .withColumn("slice", F.coalesce(F.floor(F.col("order") * F.col("slices")), F.pmod("row", F.lit(997))))
    )
    counted = placed.groupBy("bucket_length", "slice").agg(F.count(F.lit(1)).alias("in_slice")).where("bucket_length IS NOT NULL")
    earlier = Window.partitionBy("bucket_length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))).drop("in_slice")
    within = F.row_number().over(Window.partitionBy("bucket_length", "slice").orderBy("order", "row")) - 1
    numbered = placed.withColumn("within", within).join(before, ["bucket_length", "slice"], "left")
    position = F.col("before") + F.col("within")
    return numbered.select(
        F.col("id").alias(id_col), "piece", "start", "length", "bucket_length",
        F.floor(position / F.col("capacity")).alias("batch"), (position % F.col("capacity")).alias("slot"),
    )
