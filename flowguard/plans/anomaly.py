"""Anomaly models end to end: extract, clean, scale, sequence, fit, threshold, detect, save; and judging new tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, cleaning, diagnostics, sampling, scaling, sequences
from ..sources.packages import AnomalyPackage, load_anomaly_model, load_classifier, save_anomaly_model
from ..sources.paths import spread_for_training, write_and_read
from ..sources.tables import load_or_extract
from .classifier import uncertain_extractor


@dataclass
class AnomalyRun:
    package: AnomalyPackage
    cleaning: cleaning.CleanParams
    thresholds: dict[str, float]
    tables: dict[str, DataFrame] = field(default_factory=dict)


def train_anomaly_model(
    uncertain: DataFrame,
    work: str,
    *,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    slice_by: Column | None = None,
    length: int = sequences.SEQUENCE_LENGTH,
    stride: int = sequences.TRAINING_STRIDE,
    components: int = 8,
    contamination: float = anomaly.CONTAMINATION,
    split_by_key: bool = False,
    seed: int = sampling.SEED,
) -> AnomalyRun:
    """Trains on uncertain rows and leaves tables and the package under ``work``.

    ``order_by`` (unique within a key) gives the row order that sequences follow;
    no keys means one global order. ``split_by_key`` keeps all windows of a key
    in one part, so that overlapping windows do not meet across parts.
    """
    carried = list(dict.fromkeys([*keys, *order_by]))
    params = cleaning.fit_anomaly_cleaning(uncertain, exclude=carried)
    columns = params.feature_columns
    if not columns:
        raise ValueError("no feature column survived cleaning")
    clean = write_and_read(
        cleaning.apply_anomaly_cleaning(uncertain, params, keep=carried), f"{work}/clean"
    )
    scaler = scaling.fit_robust_min_max(clean, columns)
    vectors = clean.select(
        *carried, scaling.scale_features(F.array(*columns), scaler, limit=None).alias("vector")
    )
    windows = sequences.strided_sequences(
        vectors, keys, order_by, "vector", length=length, stride=stride, slice_by=slice_by,
        on_short="skip" if keys else "error",
    )
    # The split reads the windows several times.
    windows = write_and_read(windows, f"{work}/all_windows")
    if split_by_key:
        parts = sampling.split_by_key(windows, keys, seed=seed)
    else:
        parts = sampling.random_split(windows, [*keys, "window_no"], seed=seed)
    parts = write_and_read(parts, f"{work}/windows")
    model = anomaly.fit_reconstruction(
        spread_for_training(parts.where("split = 'train'")), min(components, length * len(columns))
    )
    errors = write_and_read(
        anomaly.add_errors(anomaly.reconstruct(parts, model)).drop("sequence", "rebuilt"),
        f"{work}/errors",
    )
    validation = errors.where("split = 'validation'")
    thresholds = anomaly.threshold_candidates(validation, contamination=contamination)
    fitted = anomaly.AnomalyParams(
        thresholds["threshold"], thresholds["mse_mean"], thresholds["mse_std"], contamination
    )
    package = AnomalyPackage(model, scaler, fitted, columns, length)
    save_anomaly_model(uncertain.sparkSession, package, f"{work}/package")
    detected = anomaly.detect_anomalies(errors.where("split = 'test'"), fitted)
    judged = anomaly.detect_anomalies(validation, fitted)
    index = [*keys, "window_no"]
    tables = {
        "overfit": anomaly.overfit_ratio(errors),
        "expected_rate": anomaly.expected_anomaly_rate(validation, fitted.threshold),
        "detected": detected,
        "summary": anomaly.detection_summary(detected),
        "mse_histogram": diagnostics.histogram(validation, "mse"),
        "mae_histogram": diagnostics.histogram(validation, "mae"),
        "timeline": diagnostics.error_timeline(validation, index, fitted.threshold),
        "qq": diagnostics.normal_qq(validation, "mse"),
        "scatter": diagnostics.error_scatter(judged, index),
        "boxes": diagnostics.box_summary(judged),
    }
    return AnomalyRun(package, params, thresholds, tables)


def train_from_flows(
    spark: SparkSession,
    work: str,
    *,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    saved: str | None = None,
    flows: DataFrame | None = None,
    classifier: str | None = None,
    **options,
) -> AnomalyRun:
    """``train_anomaly_model`` on the uncertain rows saved at ``saved``, or extracted now and saved there.

    Extraction takes ``flows`` and the path of a saved ``classifier``: of all
    columns, the classifier's features, the keys and the order stay. A rerun
    finds the saved rows and does not score again. Without saved rows and
    without both sources it fails. ``saved`` is ``uncertain`` below ``work`` by
    default.
    """
    extract = None
    if flows is not None and classifier is not None:
        package = load_classifier(spark, classifier)
        names = list(dict.fromkeys([*keys, *order_by, *package.feature_columns]))
        extract = uncertain_extractor(flows.select(*[F.col(f"`{c}`") for c in names]), package)
    uncertain = load_or_extract(spark, saved or f"{work}/uncertain", extract)
    return train_anomaly_model(uncertain, work, order_by=order_by, keys=keys, **options)


def judge_flows(
    flows: DataFrame,
    package: AnomalyPackage | str,
    work: str,
    *,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    slice_by: Column | None = None,
    stride: int = 1,
) -> dict[str, DataFrame]:
    """Judges a new table with a fitted or saved package.

    The package's columns are taken by name and go through the scaling that live
    messages go through: missing and infinite values become numbers, and no row
    is left out. Windows are those of training, one at every ``stride``-th row
    of a key.

    Tables: ``judged`` (written below ``work``: keys, window_no, order of the
    window's last row, mse, mae, is_anomaly, anomaly_confidence), ``summary``
    (one row), ``by_key`` (windows, anomalies, their share and the largest
    error; without keys one row) and ``expected_rate`` (share above the
    package's threshold). A key of fewer rows than a window is not judged; with
    no keys, too few rows are an error. A package that is not there fails, too.
    """
    if isinstance(package, str):
        path, package = package, load_anomaly_model(flows.sparkSession, package)
        if package is None:
            raise FileNotFoundError(f"{path}: no anomaly package")
    absent = [c for c in package.feature_columns if c not in flows.columns]
    if absent:
        raise ValueError(f"columns the model needs are missing: {absent}")
    carried = list(dict.fromkeys([*keys, *order_by]))
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in package.feature_columns])
    vectors = flows.select(
        *[F.col(f"`{c}`") for c in carried], scaling.scale_features(features, package.scaler).alias("vector")
    )
    windows = sequences.strided_sequences(
        vectors, keys, order_by, "vector", length=package.sequence_length, stride=stride, slice_by=slice_by,
        on_short="skip" if keys else "error",
    )
    errors = anomaly.add_errors(anomaly.reconstruct(windows, package.model)).drop("sequence", "rebuilt")
    judged = write_and_read(anomaly.detect_anomalies(errors, package.params), f"{work}/judged")
    by_key = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.max("mse").alias("highest_mse"),
    )
    return {
        "judged": judged,
        "summary": anomaly.detection_summary(judged),
        "by_key": by_key.withColumn("anomaly_share", F.try_divide(F.col("anomalies"), F.col("windows"))),
        "expected_rate": anomaly.expected_anomaly_rate(judged, package.params.threshold),
    }
