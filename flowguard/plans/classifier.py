"""Classifier training end to end: clean, split, balance, train, evaluate, triage, score, save."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, cleaning, labels, metrics, sampling, scaling, triage
from ..sources.packages import save_classifier
from ..sources.paths import spread_for_training, write_and_read
from ..sources.tables import write_csv

ROW_ID = "row_id"


@dataclass
class ClassifierRun:
    package: classify.ClassifierPackage
    cleaning: cleaning.CleanParams
    tables: dict[str, DataFrame] = field(default_factory=dict)


def train_flow_classifier(
    flows: DataFrame,
    work: str,
    *,
    label: str = "Label",
    row_id: str | None = None,
    exclude: Sequence[str] = (),
    doubt_ratio: float = sampling.DOUBT_RATIO,
    confidence: float = triage.CONFIDENCE_LIMIT,
    seed: int = sampling.SEED,
    **settings,
) -> ClassifierRun:
    """Trains on labelled flows and leaves every output under the shared folder ``work``.

    Tables: ``clean``, ``split``, ``balanced``, ``scored`` (validation),
    ``uncertain``; CSV: ``test_features``, ``test_labels``,
    ``test_predictions``; and the ``package``. Stages used more than once are
    written tables, which also cut the lineage. Without ``row_id``, a hash of
    the de-duplicated row stands in.
    """
    rows = cleaning.prepare_labelled_flows(flows, label)
    if row_id is None:
        row_id = ROW_ID
        # The rows are distinct, so their content names them: a rerun splits them alike.
        content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
        rows = rows.withColumn(row_id, F.md5(content))
    distinct = write_and_read(rows, f"{work}/distinct")
    params = cleaning.fit_classifier_cleaning(distinct, label, exclude=[row_id, *exclude])
    columns = params.feature_columns
    clean = write_and_read(
        cleaning.apply_classifier_cleaning(distinct, params, keep=[label, row_id]), f"{work}/clean"
    )
    split = write_and_read(
        sampling.stratified_split(clean, label, [row_id], seed=seed), f"{work}/split"
    )
    part = {name: split.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
    train = sampling.create_doubt_class(part["train"], label, [row_id], ratio=doubt_ratio, seed=seed)
    write_csv(part["test"].select(*columns), f"{work}/test_features")
    write_csv(cleaning.label_occurrences(part["test"], label), f"{work}/test_labels")

    balanced = write_and_read(
        sampling.balance(train, label, row_id, columns, seed=seed), f"{work}/balanced"
    )
    scaler = scaling.fit_standard(balanced, columns)
    classes = labels.vocabulary([balanced, part["validation"], part["test"]], label)
    package = classify.train_classifier(spread_for_training(balanced), scaler, classes, label=label, seed=seed, **settings)
    save_classifier(flows.sparkSession, package, f"{work}/package")

    scored = write_and_read(classify.score(part["validation"], package), f"{work}/scored")
    triaged = triage.training_triage(scored, classes, limit=confidence)
    pairs = triaged.select(F.col(label).alias("actual"), F.col("predicted_class").alias("predicted"))
    counts = metrics.confusion_counts(pairs)
    uncertain = scaling.scale_columns(triage.uncertain_rows(triaged).select(*columns), scaler)
    uncertain = write_and_read(uncertain, f"{work}/uncertain")
    predictions = triage.prediction_table(classify.score(part["test"], package), classes)
    write_csv(predictions, f"{work}/test_predictions")
    tables = {
        "class_counts": cleaning.class_counts(balanced, label),
        "metrics": metrics.overall_metrics(counts, classes),
        "report": metrics.classification_report(counts, classes),
        "confusion": metrics.confusion_matrix(counts, classes),
        "importances": classify.feature_importances(package, flows),
        "losses": _losses(balanced, part["validation"], package, label),
        "triage": triage.training_triage_summary(triaged),
        **({"loss_by_round": _loss_by_round(balanced, part["validation"], package, label)} if package.method == "joint" else {}),
        "uncertain": uncertain,
    }
    return ClassifierRun(package, params, tables)


def _losses(
    train: DataFrame, validation: DataFrame, package: classify.ClassifierPackage, label: str
) -> DataFrame:
    """(part, log_loss, n) for training and validation rows."""
    scored = classify.score(_parts(train, validation, package, label), package)
    return metrics.log_loss(scored, package.classes, actual=label, by=["part"])


def _loss_by_round(
    train: DataFrame, validation: DataFrame, package: classify.ClassifierPackage, label: str
) -> DataFrame:
    """(part, round, log_loss, n) for training and validation rows, from one pass."""
    return classify.loss_by_round(_parts(train, validation, package, label), package, label=label, part=F.col("part"))


def _parts(
    train: DataFrame, validation: DataFrame, package: classify.ClassifierPackage, label: str
) -> DataFrame:
    columns = [*package.feature_columns, label]
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        validation.select(*columns, F.lit("validation").alias("part"))
    )


def score_features(
    features: DataFrame, package: classify.ClassifierPackage, keep: Sequence[str] = ()
) -> DataFrame:
    """Prediction table of new, unlabelled rows."""
    return triage.prediction_table(classify.score(features, package), package.classes, keep)


def uncertain_extractor(
    features: DataFrame, package: classify.ClassifierPackage
) -> Callable[[], DataFrame]:
    """What ``load_or_extract`` calls when no uncertain rows were saved: raw rows, third policy."""
    return lambda: triage.extract_uncertain(classify.score(features, package), package.classes)
