"""Splits, class creation and resampling with exact sizes and repeatable choices.

Random choices rank rows by a hash of their identifier instead of drawing from a
generator, so a retried task chooses the same rows. ``ids`` must identify a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import settle, small_table
from ..functions.probabilities import BENIGN, DOUBT
from .ordering import hash_order, rank_cuts

# Split shares, class-creation and resampling limits.
TEST_SHARE = 0.05
VALIDATION_SHARE = 0.263
DOUBT_RATIO = 0.1
BENIGN_CAP = 500_000
SMALL_CLASS = 1000
OVERSAMPLE_TARGET = 2000
OVERSAMPLE_FACTOR = 3
MAX_NEIGHBOURS = 5
SEQUENCE_TEST_SHARE = 0.2
SEQUENCE_VALIDATION_SHARE = 0.15
SEED = 42


def count_per_class(df: DataFrame, label: str) -> dict[str, int]:
    """Class sizes; as many entries as the model will have outputs."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}


def apportion(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """Share ``total`` over classes in proportion: floors, then the largest remainders."""
    n = sum(counts.values())
    if n == 0:
        return {}
    share = {c: divmod(k * total, n) for c, k in counts.items()}
    left = total - sum(q for q, _ in share.values())
    first = sorted(share, key=lambda c: (-share[c][1], c))[:left]
    return {c: q + (c in first) for c, (q, _) in share.items()}


def stratified_split(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    *,
    test: float = TEST_SHARE,
    validation: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``split``: test, then validation from the rest, then train.

    Class proportions hold in each part and part sizes are exact. Rows are not
    shuffled: each is compared with its class's two cut values.
    """
    counts = count_per_class(df, label)
    n_test = math.ceil(test * sum(counts.values()))
    test_take = apportion(counts, n_test)
    rest = {c: n - test_take[c] for c, n in counts.items()}
    validation_take = apportion(rest, math.ceil(validation * sum(rest.values())))
    upto = {c: test_take[c] + validation_take[c] for c in counts}
    keyed = df.withColumn("_key", hash_order(ids, seed))
    cuts = rank_cuts(keyed, label, "_key", {"_test": test_take, "_validation": upto})
    return (
        keyed.join(cuts, label, "left")
        .withColumn(
            "split",
            F.when(F.col("_key") <= F.col("_test"), F.lit("test"))
            .when(F.col("_key") <= F.col("_validation"), F.lit("validation"))
            .otherwise(F.lit("train")),
        )
        .select(*df.columns, "split")
    )


def random_split(
    df: DataFrame,
    ids: Sequence[str],
    *,
    test: float = SEQUENCE_TEST_SHARE,
    validation: float = SEQUENCE_VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``split`` with exact overall sizes and no regard to classes."""
    n = df.count()
    n_test = math.ceil(test * n)
    n_validation = math.ceil(validation / (1 - test) * (n - n_test))
    keyed = df.withColumn("_key", hash_order(ids, seed)).withColumn("_all", F.lit("all"))
    cuts = rank_cuts(
        keyed, "_all", "_key", {"_test": {"all": n_test}, "_validation": {"all": n_test + n_validation}}
    )
    return (
        keyed.join(cuts, "_all", "left")
        .withColumn(
            "split",
            F.when(F.col("_key") <= F.col("_test"), F.lit("test"))
            .when(F.col("_key") <= F.col("_validation"), F.lit("validation"))
            .otherwise(F.lit("train")),
        )
        .select(*df.columns, "split")
    )


def split_by_key(
    df: DataFrame,
    keys: Sequence[str],
    *,
    test: float = SEQUENCE_TEST_SHARE,
    validation: float = SEQUENCE_VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``split`` so that all rows of a key share it (overlapping windows cannot leak).

    Shares are approximate and over keys. Map-only.
    """
    spot = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn(
        "split",
        F.when(spot < test, F.lit("test"))
        .when(spot < test + validation, F.lit("validation"))
        .otherwise(F.lit("train")),
    )


def create_doubt_class(
    train: DataFrame,
    label: str,
    ids: Sequence[str],
    *,
    ratio: float = DOUBT_RATIO,
    seed: int = SEED,
) -> DataFrame:
    """Relabels floor(ratio * n) of the benign training rows as DOUBT."""
    benign = train.where(F.col(label) == BENIGN)
    take = int(benign.count() * ratio)
    order = hash_order(ids, f"{seed}:doubt")
    cuts = rank_cuts(benign.withColumn("_key", order), label, "_key", {"_cut": {BENIGN: take}})
    keyed = train.withColumn("_key", order)
    return (
        keyed.join(cuts, label, "left")
        .withColumn(label, F.when(F.col("_key") <= F.col("_cut"), F.lit(DOUBT)).otherwise(F.col(label)))
        .select(*train.columns)
    )


def undersample(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    *,
    caps: Mapping[str, int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Keeps a random ``cap`` rows of each capped class and all rows of the others."""
    caps = {BENIGN: BENIGN_CAP} if caps is None else caps
    counts = count_per_class(df.where(F.col(label).isin(list(caps))), label)
    over = {c: caps[c] for c, n in counts.items() if n > caps[c]}
    if not over:
        return df
    keyed = df.withColumn("_key", hash_order(ids, f"{seed}:under"))
    cuts = rank_cuts(
        keyed.where(F.col(label).isin(list(over))), label, "_key", {"_cut": over}
    )
    emptied = [c for c, cap in over.items() if cap <= 0]
    return (
        keyed.join(cuts, label, "left")
        .where(F.col("_cut").isNull() | (F.col("_key") <= F.col("_cut")))
        .where(F.col(label).isNull() | ~F.col(label).isin(emptied) if emptied else F.lit(True))
        .select(*df.columns)
    )


def oversampling_plan(
    df: DataFrame,
    label: str,
    *,
    below: int = SMALL_CLASS,
    target: int = OVERSAMPLE_TARGET,
    factor: int = OVERSAMPLE_FACTOR,
) -> DataFrame:
    """(label, n, target) for every class with fewer than ``below`` rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") < below) & ~F.col(label).isin(BENIGN, DOUBT)).withColumn(
        "target", F.least(F.lit(target).cast("long"), F.col("n") * factor)
    )


def neighbour_count(plan: DataFrame) -> DataFrame:
    """One row: how many neighbours the smallest planned class allows."""
    smallest = plan.agg(F.min("n").alias("smallest"))
    k = F.when(F.col("smallest") > 1, F.least(F.lit(MAX_NEIGHBOURS), F.col("smallest") - 1)).when(
        F.col("smallest") == 1, F.lit(1)
    )
    return smallest.withColumn("k_neighbours", k.cast("long"))


def nearest_rows(points: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows (fewer when there are fewer)."""
    n = len(points)
    k = min(k, n - 1)
    nearest = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        distance = ((points - points[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        nearest[i] = np.argsort(distance, kind="stable")[:k]
    return nearest


def minority_neighbours(
    df: DataFrame, label: str, row_id: str, features: str, plan: DataFrame, k: int
) -> DataFrame:
    """(label, row_id, rank, neighbour_id) within each planned class.

    A planned class has fewer rows than the plan's limit, so one class is one
    small group; no pairs are materialised, only the k kept per row.
    """
    rows = _planned_rows(df, label, row_id, features, plan)
    schema = T.StructType(
        [
            df.schema[label],
            df.schema[row_id],
            T.StructField("rank", T.LongType()),
            T.StructField("neighbour_id", df.schema[row_id].dataType),
        ]
    )

    def neighbours(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(row_id, ignore_index=True)
        near = nearest_rows(np.stack(group[features].to_list()), k)
        size = near.shape[1]
        return pd.DataFrame(
            {
                label: np.repeat(group[label].to_numpy(), size),
                row_id: np.repeat(group[row_id].to_numpy(), size),
                "rank": np.tile(np.arange(1, size + 1), len(group)),
                "neighbour_id": group[row_id].to_numpy()[near.ravel()],
            }
        )

    return rows.groupBy(label).applyInPandas(neighbours, schema)


def _planned_rows(
    df: DataFrame, label: str, row_id: str, features: str, plan: DataFrame
) -> DataFrame:
    return df.select(label, row_id, F.col(features).cast("array<double>").alias(features)).join(
        settle(plan.select(label, "n", "target")), label
    )


def smote(
    df: DataFrame,
    label: str,
    row_id: str,
    features: str,
    plan: DataFrame,
    k: int,
    *,
    seed: int = SEED,
) -> DataFrame:
    """Synthetic minority rows: (label, synthetic_no, base_id, neighbour_id, features).

    Row j of a class takes its base row, its neighbour and its place between the
    two from md5 of ``seed:label:j``. A class of one row has no neighbour and
    yields nothing.
    """
    rows = _planned_rows(df, label, row_id, features, plan)
    id_type = df.schema[row_id].dataType
    schema = T.StructType(
        [
            df.schema[label],
            T.StructField("synthetic_no", T.LongType()),
            T.StructField("base_id", id_type),
            T.StructField("neighbour_id", id_type),
            T.StructField(features, T.ArrayType(T.DoubleType())),
        ]
    )

    def synthesise(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(row_id, ignore_index=True)
        points = np.stack(group[features].to_list())
        near = nearest_rows(points, k)
        n, width = near.shape
        name = group[label].iloc[0]
        wanted = int(group["target"].iloc[0]) - n
        out = []
        for j in range(wanted if width else 0):
            digest = hashlib.md5(f"{seed}:{name}:{j}".encode()).hexdigest()
            base = int(digest[:8], 16) % n
            other = near[base, int(digest[8:16], 16) % width]
            place = int(digest[16:24], 16) / 2**32
            mixed = points[base] + place * (points[other] - points[base])
            out.append((name, j, group[row_id].iloc[base], group[row_id].iloc[other], mixed.tolist()))
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(label).applyInPandas(synthesise, schema)


def balance(
    train: DataFrame,
    label: str,
    row_id: str,
    feature_columns: Sequence[str],
    *,
    caps: Mapping[str, int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Undersampled training rows plus synthetic minority rows (those have a NULL id).

    The plan is made from the class sizes before undersampling.
    """
    plan = settle(oversampling_plan(train, label))
    kept = undersample(train, label, [row_id], caps=caps, seed=seed)
    k = neighbour_count(plan).first()["k_neighbours"]
    if k is None:
        return kept
    packed = kept.select(label, row_id, F.array(*feature_columns).alias("_features"))
    made = smote(packed, label, row_id, "_features", plan, k, seed=seed)
    columns = [F.col("_features")[i].alias(c) for i, c in enumerate(feature_columns)]
    return kept.unionByName(made.select(label, *columns), allowMissingColumns=True)
