"""Mixing sources to target weights by fitting word budgets exactly.

Targets come from the source totals. What a source's target leaves after whole
repeats is fitted over its histogram of document sizes: a proportional part of
every size first, then a bounded knapsack for the remaining words. Documents of
a size are chosen by a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .texts import count_words, one_per_key, row_key, unit, whole, written

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2

#: Words that the knapsack fits exactly; its tables are of this length.
EXACT = 1 << 18
#: Documents of one source and size that are ranked in one task.
RANKED = 500


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come closest below ``budget``.

    Sizes are positive and distinct. Every size gives its proportional part.
    While more than ``EXACT`` words remain, one more document of a size is
    added, by the largest remainders; the rest is an exact bounded knapsack
    over the documents left. Up to ``EXACT`` words of remainder the result is
    the best that contains the proportional part.
    """
    total = int((sizes * counts).sum())
    budget = min(max(budget, 0), total)
    if not total:
        return np.zeros(len(sizes), np.int64)
    # Integers throughout: a product of two word totals may pass 64 bits.
    shares = [divmod(int(n) * budget, total) for n in counts]
    take = np.array([q for q, _ in shares], np.int64)
    rest = budget - int((sizes * take).sum())
    for k in sorted(range(len(sizes)), key=lambda k: (-shares[k][1], -int(sizes[k]))):
        if rest <= EXACT:
            break
        if shares[k][1] and sizes[k] <= rest:
            take[k] += 1
            rest -= int(sizes[k])
    return take + _knapsack(sizes, counts - take, rest)


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts whose words are the largest reachable sum up to ``budget``."""
    first = np.full(budget + 1, -1, np.int64)  # the item that first reached a sum
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        left, part = min(int(counts[k]), budget // int(sizes[k])), 1
        while left > 0 and not reached[budget]:
            # Powers of two and a remainder make every count up to the bound.
            part = min(part, left)
            step = part * int(sizes[k])
            new = np.flatnonzero(reached[: budget + 1 - step] & ~reached[step:]) + step
            reached[new], first[new] = True, len(items)
            items.append((k, part))
            left, part = left - part, part * 2
    take = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, part = items[first[at]]
        take[k] += part
        at -= part * int(sizes[k])
    return take


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS,
    folder: str | None = None,
) -> DataFrame:
    """(source, number, source_size, target) from a table (source, size).

    Sources are numbered from 1 by code point, NULL last, and weigh ``weights``
    in turn. They share ``share`` of all words by weight; a target stops at
    ``most`` times its source, and the excess goes to the others by weight
    until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    first = F.struct("none", F.substring("source", 1, 3).alias("start"))
    numbered = number_rows(totals, ["none", "source"], first, "number").drop("none")
    turn = F.array(*[F.lit(w) for w in weights])
    table = written(
        numbered.withColumn("weight", F.element_at(turn, ((F.col("number") - 1) % len(weights) + 1).cast("int"))),
        "sources", folder,
    )
    words = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    # Each pass stops more sources; a few passes settle it, each one small aggregate.
    while True:
        above = F.lit(level) * F.col("weight") > F.lit(float(most)) * F.col("source_size")
        n, full, open_weight = table.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (words - full) / open_weight
    limit = F.lit(float(most)) * F.col("source_size")
    return table.select("source", "number", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _fit_source(histogram: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = histogram["size"].to_numpy(), histogram["n"].to_numpy()
    order = np.argsort(sizes)
    take = fit_budget(sizes[order], counts[order], int(histogram["rest"].iloc[0]))
    return pd.DataFrame({"number": histogram["number"].iloc[0], "size": sizes[order], "n": counts[order], "take": take})


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    seed: int = 42,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: id, key, size, source_size, target, copies and taken.

    size is the number of words (NULL text: 0), taken = copies * size. NULL is a
    source like any other. Documents without words are never taken. Rows with
    the same id are ranked by a hash of their texts; rows equal in both are
    interchangeable. An empty table gives no rows; other columns are ignored.
    ``key`` is the row's ``row_key`` as text.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"),
            F.xxhash64(whole(text)).alias("text_hash"), F.to_json(row_key(id_col, text)).alias("key"),
        ),
        "sizes", folder,
    )
    targets = source_targets(rows, weights=weights, share=share, most=most, folder=folder)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = written(
        targets.withColumn("repeats", repeats).withColumn(
            "rest", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")
        ),
        "targets", folder,
    )
    # One row per source and size: as many as there are different sizes, not documents.
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    joined = histogram.join(targets, histogram["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    fitted = (
        joined.where("size > 0").select("number", "size", "n", "rest").groupBy("number")
        .applyInPandas(_fit_source, "number bigint, size bigint, n bigint, take bigint")
    )
    quota = (
        joined.select("source", "number", "size", "source_size", "target", "repeats", F.col("n").alias("all"))
        .join(fitted.select("number", "size", "take"), ["number", "size"], "left")
        .withColumn("take", F.coalesce("take", F.lit(0)))
        .withColumnRenamed("source", "from").withColumnRenamed("size", "of_size")
    )
    quota = written(quota, "quota", folder)
    # A size that very many documents share is cut into slices of the hash order.
    cut = rows.join(quota.hint("merge"), (rows["size"] == quota["of_size"]) & rows["source"].eqNullSafe(quota["from"]))
    place = unit(F.lit(seed), F.col("id"), F.col("text_hash"))
    cut = written(
        cut.withColumn("place", place).withColumn("slice", F.floor(F.col("place") * F.ceil(F.col("all") / RANKED)))
        .drop("from", "of_size"),
        "slices", folder,
    )
    group = ["number", "size"]
    counts = cut.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("in_slice"))
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))).drop("in_slice")
    rank = F.row_number().over(Window.partitionBy(*group, "slice").orderBy("place", "id", "text_hash"))
    ranked = cut.withColumn("rank", rank).join(before, [*group, "slice"])
    chosen = (F.col("before") + F.col("rank") <= F.col("take")).cast("long")
    copies = F.when(F.col("size") > 0, F.col("repeats") + chosen).otherwise(0).cast("long")
    return ranked.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "key", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with their columns.

    Rows equal in id and text come from the first of them, as often as all of
    them together are taken.
    """
    decided = mix(docs, id_col=id_col, text=text, **options)
    copies = decided.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    taken = one_per_key(docs, id_col, text).join(copies.hint("merge"), "_key")
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return taken.select("_row", again.alias("_copy")).select("_row.*")
