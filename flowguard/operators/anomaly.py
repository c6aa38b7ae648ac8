"""Reconstruction anomalies: model, errors, threshold, verdicts.

The reconstruction model is a principal-component projection of whole windows,
the linear form of an autoencoder: fitting is a distributed aggregate, and the
fitted matrix is small enough to travel with each scoring task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import INF, clip_error, usable_threshold
from ..functions.quantiles import quantiles
from ..functions.vectors import all_finite, mean_absolute_error, mean_squared_error

# Threshold rule and score compression.
STD_FACTOR = 2.5
CONTAMINATION = 0.10
IQR_FACTOR = 1.5
LINEAR_SCORE = 10.0
TOP_SCORE = 100.0
MODEL_TYPE = "standard"


@dataclass
class AnomalyParams:
    """What scoring needs to know about the error distribution."""

    threshold: float
    mse_mean: float
    mse_std: float
    contamination: float = CONTAMINATION
    model_type: str = MODEL_TYPE


def fit_reconstruction(sequences: DataFrame, components: int, column: str = "sequence") -> PipelineModel:
    """Centres flattened windows and keeps their leading components."""
    flat = sequences.select(array_to_vector(F.flatten(column)).alias("window"))
    centre = StandardScaler(inputCol="window", outputCol="centred", withMean=True, withStd=False)
    project = PCA(k=components, inputCol="centred", outputCol="projected")
    return Pipeline(stages=[centre, project]).fit(flat)


def reconstruct(
    sequences: DataFrame, model: PipelineModel, column: str = "sequence", output: str = "rebuilt"
) -> DataFrame:
    """Adds the reconstruction: mean + P P'(window - mean), in Arrow batches."""
    mean = model.stages[0].mean.toArray()
    basis = model.stages[1].pc.toArray()

    @F.arrow_udf("array<array<double>>")
    def rebuild(windows: pa.Array) -> pa.Array:
        """All windows of a batch at once, over their flat cells."""
        rows = windows.flatten()
        sizes = pc.fill_null(pc.list_value_length(windows), 0).to_numpy(zero_copy_only=False)
        widths = pc.list_value_length(rows)
        cells = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
        # A window's cells lie between two row edges; a missing row has none.
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(widths, 0).to_numpy(zero_copy_only=False))])
        missing = np.concatenate([[0], np.cumsum(widths.is_null().to_numpy(zero_copy_only=False))])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        fits = windows.is_valid().to_numpy(zero_copy_only=False)
        fits &= (edges[ends] - edges[starts] == mean.size) & (missing[ends] == missing[starts])
        chosen = np.flatnonzero(fits)
        at = edges[starts[chosen]][:, None] + np.arange(mean.size)[None, :]
        x = cells[at] if len(chosen) else np.empty((0, mean.size))
        y = mean + (x - mean) @ basis @ basis.T
        kept = np.concatenate([np.arange(s, e) for s, e in zip(starts[chosen], ends[chosen])]) if len(chosen) else np.empty(0, int)
        lengths = (edges[1:] - edges[:-1])[kept]
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(y.ravel()))
        counts = np.where(fits, sizes, 0)
        outer = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.concatenate([~fits, [False]]))
        return pa.ListArray.from_arrays(outer, inner)

    return sequences.withColumn(output, rebuild(F.col(column)))


def add_errors(df: DataFrame, actual: str = "sequence", rebuilt: str = "rebuilt") -> DataFrame:
    """Adds ``mse`` and ``mae`` per sequence."""
    return df.withColumns(
        {
            "mse": mean_squared_error(F.col(actual), F.col(rebuilt)),
            "mae": mean_absolute_error(F.col(actual), F.col(rebuilt)),
        }
    )


def split_errors(errors: DataFrame, split: str = "split") -> DataFrame:
    """(split, mse, mae): mean errors per part; equally long windows make it the global mean."""
    return errors.groupBy(split).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def overfit_ratio(errors: DataFrame, split: str = "split") -> DataFrame:
    """One row: train and validation errors, and train mse over validation mse."""
    def part(metric: str, name: str) -> Column:
        return F.avg(F.when(F.col(split) == name, F.col(metric)))

    return errors.agg(
        part("mse", "train").alias("train_mse"),
        part("mse", "validation").alias("validation_mse"),
        part("mae", "train").alias("train_mae"),
        part("mae", "validation").alias("validation_mae"),
    ).withColumn("overfit_ratio", F.try_divide("train_mse", "validation_mse"))


def error_distribution(errors: DataFrame, *, exact: bool = True) -> dict[str, float]:
    """Mean, population std, quartiles of ``mse``."""
    row = errors.agg(F.count("mse").alias("n"), F.avg("mse").alias("mean"), F.stddev_pop("mse").alias("std")).first()
    q1, median, q3 = quantiles(errors, ["mse"], [0.25, 0.5, 0.75], exact=exact, counts={"mse": row["n"]})["mse"]
    return {"mean": row["mean"], "std": row["std"], "median": median, "q1": q1, "q3": q3}


def threshold_candidates(
    errors: DataFrame, *, contamination: float = CONTAMINATION, exact: bool = True
) -> dict[str, float]:
    """The three candidate thresholds, their median, and the mean and std behind them."""
    row = errors.agg(F.count("mse").alias("n"), F.avg("mse").alias("mean"), F.stddev_pop("mse").alias("std")).first()
    if not row["n"]:
        raise ValueError("no errors to derive a threshold from")
    q1, q3, tail = quantiles(
        errors, ["mse"], [0.25, 0.75, 1 - contamination], exact=exact, counts={"mse": row["n"]}
    )["mse"]
    found = {
        "statistical": row["mean"] + STD_FACTOR * row["std"],
        "percentile": tail,
        "iqr": q3 + IQR_FACTOR * (q3 - q1),
    }
    found["threshold"] = sorted(found.values())[1]
    return found | {"mse_mean": row["mean"], "mse_std": row["std"]}


def fit_threshold(
    errors: DataFrame,
    *,
    contamination: float = CONTAMINATION,
    model_type: str = MODEL_TYPE,
    exact: bool = True,
) -> AnomalyParams:
    found = threshold_candidates(errors, contamination=contamination, exact=exact)
    return AnomalyParams(
        found["threshold"], found["mse_mean"], found["mse_std"], contamination, model_type
    )


def expected_anomaly_rate(errors: DataFrame, threshold: float) -> DataFrame:
    return errors.agg(
        F.avg((F.col("mse") > F.lit(threshold)).cast("double")).alias("expected_rate")
    )


def detect_anomalies(errors: DataFrame, params: AnomalyParams) -> DataFrame:
    """Adds ``is_anomaly`` (strictly above) and ``anomaly_confidence``, the distance in std units."""
    t = F.lit(params.threshold)
    return errors.withColumns(
        {
            "is_anomaly": F.col("mse") > t,
            "anomaly_confidence": F.try_divide(F.abs(F.col("mse") - t), F.lit(params.mse_std)),
        }
    )


def detection_summary(detected: DataFrame) -> DataFrame:
    """One row: totals, percentages, error range and mean confidence."""
    return detected.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        F.min("mse").alias("lowest_mse"),
        F.max("mse").alias("highest_mse"),
        F.avg("anomaly_confidence").alias("mean_confidence"),
    ).withColumns(
        {
            "anomaly_percent": F.try_divide(100.0 * F.col("anomalies"), F.col("total")),
            "normal_percent": F.try_divide(100.0 * F.col("normal"), F.col("total")),
        }
    )


def anomaly_score(error: Column, threshold: Column) -> Column:
    """error / threshold, compressed logarithmically above 10 and capped at 100."""
    ratio = error / threshold
    compressed = F.least(F.lit(TOP_SCORE), LINEAR_SCORE + F.log10(ratio - (LINEAR_SCORE - 1)))
    return F.when(ratio > LINEAR_SCORE, compressed).otherwise(ratio)


def add_verdict(
    rows: DataFrame,
    params: AnomalyParams | None,
    *,
    sequence: str = "sequence",
    rebuilt: str = "rebuilt",
) -> DataFrame:
    """Adds ``tier2_status`` (ANOMALY, BENIGN, ERROR, DISABLED) and ``tier2_detail``.

    No parameters means no second tier: DISABLED, which counts as neither
    analysed nor failed. A sequence, reconstruction or error that is not finite
    is an ERROR without detail.
    """
    if params is None:
        return rows.withColumns(
            {"tier2_status": F.lit("DISABLED"), "tier2_detail": F.lit(None).cast(_DETAIL)}
        )
    mse = mean_squared_error(F.col(sequence), F.col(rebuilt))
    usable = all_finite(F.col(sequence)) & all_finite(F.col(rebuilt))
    rows = rows.withColumn("_mse", F.when(usable, mse))
    rows = rows.withColumn(
        "_mse", F.when(~F.isnan("_mse") & (F.col("_mse") < INF) & (F.col("_mse") >= 0), clip_error(F.col("_mse")))
    )
    threshold = usable_threshold(F.lit(params.threshold).cast("double"))
    anomalous = F.col("_mse") > threshold
    detail = F.struct(
        F.col("_mse").alias("reconstruction_error"),
        threshold.alias("threshold"),
        anomaly_score(F.col("_mse"), threshold).alias("anomaly_score"),
        anomalous.alias("is_anomaly"),
        F.lit(params.model_type).alias("model_type"),
    ).cast(_DETAIL)
    return rows.withColumns(
        {
            "tier2_status": F.when(F.col("_mse").isNull(), F.lit("ERROR"))
            .when(anomalous, F.lit("ANOMALY"))
            .otherwise(F.lit("BENIGN")),
            "tier2_detail": F.when(F.col("_mse").isNotNull(), detail),
        }
    ).drop("_mse")


_DETAIL = (
    "struct<reconstruction_error:double,threshold:double,anomaly_score:double,"
    "is_anomaly:boolean,model_type:string>"
)
