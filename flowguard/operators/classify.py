"""Multiclass tree-ensemble training and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import compute_once, small_table
from ..sources.paths import remove_path, work_folder, write_and_read
from .boosting import BoostedModel, fit_boosted, losses_by_round
from .ensembles import EnsemblesModel, ensemble_edges, fit_ensembles
from .forest import ForestModel, entry_blocks, fit_forest
from .labels import encode
from .scaling import ScaleParams, scale_features
from .trees import ensemble_probabilities

# Training settings.
TREES = 250
DEPTH = 6
STEP = 0.1
ROW_SHARE = 0.8
COLUMN_SHARE = 0.8
SEED = 42
TOP_FEATURES = 20


@dataclass
class ClassifierPackage:
    """Everything scoring needs: model, scaler, class order, feature order."""

    #: A forest or boosted ensembles saved by an earlier version are MLlib's.
    model: PipelineModel | BoostedModel | EnsemblesModel | ForestModel
    scaler: ScaleParams
    classes: list[str]
    feature_columns: list[str] = field(default_factory=list)
    method: str = "forest"
    model_classes: list[int] = field(default_factory=list)


def train_classifier(
    train: DataFrame,
    scaler: ScaleParams,
    classes: Sequence[str],
    *,
    label: str = "Label",
    method: str = "forest",
    trees: int = TREES,
    depth: int = DEPTH,
    step: float = STEP,
    row_share: float = ROW_SHARE,
    column_share: float = COLUMN_SHARE,
    seed: int = SEED,
) -> ClassifierPackage:
    """Trains on unscaled rows, scaling them with the fitted scaler.

    ``forest`` is one multiclass random forest: see ``forest``. ``joint`` boosts
    one sequence of trees for all classes together: see ``boosting``. ``boosted``
    is one binary gradient-boosted ensemble per class, whose probabilities are
    normalised: see ``ensembles``.
    """
    columns = list(scaler.columns)
    scaled = _scaled(F.array(*[F.col(c).cast("double") for c in columns]), scaler)
    if method in ("forest", "joint"):
        inputs = (train, scaled, encode(F.col(label), classes), len(classes), columns)
        settings = dict(depth=depth, row_share=row_share, column_share=column_share, seed=seed)
        model = fit_forest(*inputs, trees=trees, **settings) if method == "forest" else fit_boosted(*inputs, rounds=trees, step=step, **settings)
        return ClassifierPackage(model, scaler, list(classes), columns, method, list(range(len(classes))))
    if method != "boosted":
        raise ValueError(f"unknown method {method!r}")
    rows = train.select(scaled.alias("features"), encode(F.col(label), classes).cast("int").alias("y")).where("y IS NOT NULL")
    edges = ensemble_edges(rows, len(columns))
    # Every class's ensemble is grown on the same rows: they are scaled, binned and dealt once.
    path = work_folder(train.sparkSession, "boosted")
    blocks = write_and_read(entry_blocks(rows, edges), path)
    settings = dict(rounds=trees, depth=depth, step=step, row_share=row_share, column_share=column_share, seed=seed)
    model = fit_ensembles(blocks, edges, len(classes), **settings)
    remove_path(train.sparkSession, path)
    return ClassifierPackage(model, scaler, list(classes), columns, method, model.seen)


def _scaled(features: Column, scaler: ScaleParams) -> Column:
    return scale_features(features, scaler, limit=None)


def score(df: DataFrame, package: ClassifierPackage, features: Column | None = None) -> DataFrame:
    """Adds ``probability``, an array in class order that sums to 1.

    ``features`` defaults to the package's columns; a stream passes its array.
    """
    if features is None:
        features = F.array(*[F.col(c).cast("double") for c in package.feature_columns])
    if not isinstance(package.model, PipelineModel):
        scaled = _scaled(features, package.scaler)
        share = ensemble_probabilities(package.model, scaled, len(package.feature_columns))
        return df.select("*", compute_once(share).alias("probability"))
    rows = df.withColumn("vector", array_to_vector(_scaled(features, package.scaler)))
    scored = package.model.transform(rows)
    n = len(package.classes)
    if package.method == "forest":
        p = vector_to_array("probability")
        known = len(package.model_classes)
        parts = p if known == n else F.concat(p, F.array_repeat(F.lit(0.0), n - known))
        return scored.select(*df.columns, compute_once(parts).alias("probability"))
    each = [
        vector_to_array(f"_probability{i}")[1] if i in package.model_classes else F.lit(0.0)
        for i in range(n)
    ]
    raw = scored.select(*df.columns, compute_once(F.array(*each)).alias("_each"))
    total = F.aggregate("_each", F.lit(0.0), lambda s, v: s + v)
    share = compute_once(F.transform("_each", lambda v: v / total))
    return raw.withColumn("probability", share).drop("_each")


def feature_importances(package: ClassifierPackage, df: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """(feature, importance), the most important first."""
    if not isinstance(package.model, PipelineModel):
        values = package.model.importances()
    else:
        values = np.mean([m.featureImportances.toArray() for m in package.model.stages], axis=0)
    rows = [
        {"feature": c, "importance": float(v)} for c, v in zip(package.feature_columns, values)
    ]
    table = small_table(df.sparkSession, rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), F.asc("feature")).limit(top)


def loss_by_round(
    df: DataFrame, package: ClassifierPackage, *, label: str = "Label", part: Column | None = None
) -> DataFrame:
    """(part, round, log_loss, n) of a jointly boosted package: the loss after each of its rounds."""
    if package.method != "joint":
        raise ValueError(f"a {package.method!r} package has no rounds")
    features = _scaled(F.array(*[F.col(c).cast("double") for c in package.feature_columns]), package.scaler)
    index = encode(F.col(label), package.classes)
    return losses_by_round(
        df, package.model, features, index, len(package.feature_columns), F.lit("all") if part is None else part
    )
