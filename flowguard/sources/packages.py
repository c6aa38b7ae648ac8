"""Saved models: trees as a table, or an MLlib model, next to a one-row parameter table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import small_table
from ..functions.numbers import DEFAULT_THRESHOLD
from ..operators.anomaly import AnomalyParams
from ..operators.boosting import BoostedModel
from ..operators.classify import ClassifierPackage
from ..operators.ensembles import EnsemblesModel
from ..operators.forest import ForestModel
from ..operators.scaling import ScaleParams
from ..operators.sequences import SEQUENCE_LENGTH
from ..operators.trees import Tree
from .paths import path_exists, remove_path

_SCALER = (
    "scaler_columns array<string>, centre array<double>, spread array<double>, "
    "low array<double>, high array<double>, target array<double>"
)
_CLASSIFIER = (
    "feature_columns array<string>, classes array<string>, method string, "
    "model_classes array<int>, " + _SCALER
)
_ANOMALY = (
    "feature_columns array<string>, sequence_length int, contamination double, threshold double, "
    "mse_mean double, mse_std double, model_type string, " + _SCALER
)
CLASSIFIER_PARTS = ("feature_columns", "classes", "scaler_columns", "centre", "spread")


@dataclass
class AnomalyPackage:
    model: PipelineModel
    scaler: ScaleParams
    params: AnomalyParams
    feature_columns: list[str]
    sequence_length: int = SEQUENCE_LENGTH


def _scaler_row(s: ScaleParams) -> dict:
    return {
        "scaler_columns": s.columns,
        "centre": s.centre,
        "spread": s.spread,
        "low": s.low,
        "high": s.high,
        "target": list(s.target),
    }


def _scaler(row) -> ScaleParams:
    return ScaleParams(
        list(row["scaler_columns"]),
        list(row["centre"]),
        list(row["spread"]),
        list(row["low"]) if row["low"] is not None else None,
        list(row["high"]) if row["high"] is not None else None,
        tuple(row["target"] or (-1.0, 1.0)),
    )


def _write_row(spark: SparkSession, row: dict, schema: str, path: str) -> None:
    small_table(spark, [row], schema).write.mode("overwrite").parquet(f"{path}/params")


def save_classifier(spark: SparkSession, package: ClassifierPackage, path: str) -> None:
    if isinstance(package.model, PipelineModel):
        package.model.write().overwrite().save(f"{path}/model")
    else:
        remove_path(spark, f"{path}/model")
        _save_trees(spark, package.model, f"{path}/model")
    row = {
        "feature_columns": package.feature_columns,
        "classes": package.classes,
        "method": package.method,
        "model_classes": package.model_classes,
    } | _scaler_row(package.scaler)
    _write_row(spark, row, _CLASSIFIER, path)


_TREES = "round long, feature array<int>, bin array<int>, gain array<double>, value array<array<double>>"


def _save_trees(spark: SparkSession, model: BoostedModel | EnsemblesModel | ForestModel, path: str) -> None:
    """Trees as rows, and the edges and what the rows start from as one row."""
    trees = [
        {"round": i, "feature": t.feature.tolist(), "bin": t.bin.tolist(), "gain": t.gain.tolist(), "value": t.value.tolist()}
        for i, t in enumerate(model.trees)
    ]
    small_table(spark, trees, _TREES).write.mode("overwrite").parquet(f"{path}/trees")
    start = [{"edges": model.edges, "start": model.start}]
    small_table(spark, start, "edges array<array<double>>, start array<double>").write.mode("overwrite").parquet(f"{path}/start")


def _load_trees(spark: SparkSession, path: str, kind: type) -> BoostedModel | EnsemblesModel | ForestModel:
    row = spark.read.parquet(f"{path}/start").first()
    trees = spark.read.parquet(f"{path}/trees").orderBy("round").collect()
    return kind(
        [list(e) for e in row["edges"]],
        list(row["start"]),
        [Tree(np.array(t.feature, np.int32), np.array(t.bin, np.int32), np.array(t.gain), np.array(t.value)) for t in trees],
    )


def load_classifier(spark: SparkSession, path: str) -> ClassifierPackage:
    """Fails when the package is absent or one of its parts is missing."""
    for part in ("model", "params"):
        if not path_exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"{path}: no {part}")
    row = spark.read.parquet(f"{path}/params").first()
    found = row.asDict() if row is not None else {}
    for part in CLASSIFIER_PARTS:
        if not found.get(part):
            raise KeyError(f"{path}: missing {part}")
    kind = {"joint": BoostedModel, "boosted": EnsemblesModel, "forest": ForestModel}.get(row["method"])
    own = kind is not None and path_exists(spark, f"{path}/model/trees")
    return ClassifierPackage(
        _load_trees(spark, f"{path}/model", kind) if own else PipelineModel.load(f"{path}/model"),
        _scaler(row),
        list(row["classes"]),
        list(row["feature_columns"]),
        row["method"],
        list(row["model_classes"]),
    )


def save_anomaly_model(spark: SparkSession, package: AnomalyPackage, path: str) -> None:
    package.model.write().overwrite().save(f"{path}/model")
    p = package.params
    row = {
        "feature_columns": package.feature_columns,
        "sequence_length": package.sequence_length,
        "contamination": p.contamination,
        "threshold": p.threshold,
        "mse_mean": p.mse_mean,
        "mse_std": p.mse_std,
        "model_type": p.model_type,
    } | _scaler_row(package.scaler)
    _write_row(spark, row, _ANOMALY, path)


def load_anomaly_model(spark: SparkSession, path: str | None) -> AnomalyPackage | None:
    """The saved second tier with a usable threshold, or ``None``, which switches the tier off."""
    if not path or not all(path_exists(spark, f"{path}/{p}") for p in ("model", "params")):
        return None
    row = spark.read.parquet(f"{path}/params").first()
    if row is None:
        return None
    t = row["threshold"]
    threshold = DEFAULT_THRESHOLD if t is None or math.isnan(t) or t <= 0 else t
    return AnomalyPackage(
        PipelineModel.load(f"{path}/model"),
        _scaler(row),
        AnomalyParams(threshold, row["mse_mean"], row["mse_std"], row["contamination"], row["model_type"]),
        list(row["feature_columns"]),
        row["sequence_length"],
    )


def package_summary(spark: SparkSession, path: str) -> DataFrame:
    """The parameter row of a saved package, without its arrays' contents."""
    row = spark.read.parquet(f"{path}/params")
    return row.select(F.size("feature_columns").alias("features"), *[c for c in row.columns if "array" not in dict(row.dtypes)[c]])
