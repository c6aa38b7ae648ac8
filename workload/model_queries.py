"""Trained models, saved packages and file sources.

Fitted numbers have no SQL counterpart; what SQL can say about them is compared:
row counts, probability sums, losses against the class shares, variances, round
trips.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.bounded import small_table
from flowguard.operators import anomaly, classify, cleaning, labels, metrics, sequences, triage
from flowguard.operators.ordering import time_slice
from flowguard.operators.scaling import ScaleParams, fit_standard, scale_features
from flowguard.plans.anomaly import judge_flows, train_from_flows
from flowguard.sources import packages, tables
from flowguard.sources.paths import spread_for_training, stage, work_folder

from .testmap import FLOWS, MESSAGES, SEQUENCES, WEEK, rounded, sql, view

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


COLUMNS = ["f_qty", "f_price", "f_disc", "f_tax", "f_rare"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "f_qty", "f_price", "f_disc"]
_KEYS_SQL = ", ".join(KEY)
_FLOWS = (FLOWS[0], [*FLOWS[1], "l_orderkey", "l_partkey", "l_suppkey"])


FLOW_PARTS = 48


def flows(spark, sf):
    rows = view(spark, sf, _FLOWS).withColumn("Label", labels.group_label(F.col("Label")))
    rows = cleaning.missing_for_not_finite(rows, COLUMNS)
    # The test tables are single files, whose parts may be few: all that follows reads the written rows.
    return stage(spread_for_training(cleaning.fill_missing(rows, cleaning.medians(rows, COLUMNS)), FLOW_PARTS), "flows")


def trained(rows, **settings):
    return classify.train_classifier(
        spread_for_training(rows), fit_standard(rows, COLUMNS), labels.vocabulary([rows]), **settings
    )


#: Less than the defaults, for queries whose point isn't the model, and for the timings.
SMALL = dict(trees=10, depth=4)

_GROUPED = f"""flows AS ({sql(_FLOWS)}), grouped AS (SELECT *, CASE WHEN Label IN ('DoS Hulk', 'DDoS') THEN 'DoS'
  WHEN Label = 'PortScan' THEN 'Reconnaissance' WHEN Label = 'FTP-Patator' THEN 'Brute Force' WHEN Label = 'Bot' THEN 'Malware'
  WHEN Label = 'Heartbleed' THEN 'Advanced Attack' ELSE Label END AS class FROM flows),
shares AS (SELECT class, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM grouped GROUP BY class)"""
# The loss of a model that always answers with the class shares.
_BY_CLASS = f"""WITH {_GROUPED} SELECT class AS "Label", n, true AS better_than_shares FROM shares"""


def by_class(rows, package):
    """Rows of each class, and whether the model's loss is below that of the class shares."""
    scored = stage(classify.score(rows, package).select("Label", "probability"), "scored")
    loss = metrics.log_loss(scored, package.classes, actual="Label").first()["log_loss"]
    counts = scored.groupBy("Label").agg(F.count(F.lit(1)).alias("n"))
    shares = [r.n for r in counts.collect()]
    entropy = -sum(n / sum(shares) * math.log(n / sum(shares)) for n in shares)
    return counts.withColumn("better_than_shares", F.lit(loss < entropy))


@query("M1_train_forest", _BY_CLASS)
def train_forest(spark, sf):
    """A small multiclass forest against the class shares."""
    rows = flows(spark, sf)
    return by_class(rows, trained(rows, **SMALL))


@query("M1_train_forest_default", _BY_CLASS)
def train_default_forest(spark, sf):
    """The same with the default settings: 250 trees of depth 6."""
    rows = flows(spark, sf)
    return by_class(rows, trained(rows))


@query("M1_train_boosted", _BY_CLASS)
def train_boosted(spark, sf):
    """One boosted ensemble per class, normalised."""
    rows = flows(spark, sf)
    return by_class(rows, trained(rows, method="boosted", trees=3, depth=3))


#: Rounds of the registered queries; the default is 250.
ROUNDS = 30


@query(
    "M1_joint_boosting",
    f"WITH {_GROUPED} SELECT sum(n)::BIGINT AS n, round(-sum(share * ln(share)), 6) AS loss_of_shares, true AS below_shares, "
    "true AS below_forest FROM shares",
)
def joint_boosting(spark, sf):
    """Boosting over all classes together ends below the class shares and below the default forest."""
    rows = flows(spark, sf)
    package = trained(rows, method="joint", trees=ROUNDS)
    scored = stage(classify.score(rows, package).select("Label", "probability"), "scored")
    forest = metrics.log_loss(classify.score(rows, trained(rows)), package.classes, actual="Label").first()["log_loss"]
    first = classify.loss_by_round(rows, package).where("round = 0").first()["log_loss"]
    return metrics.log_loss(scored, package.classes, actual="Label").select(
        "n",
        F.lit(round(first, 6)).alias("loss_of_shares"),
        (F.col("log_loss") < first).alias("below_shares"),
        (F.col("log_loss") < forest).alias("below_forest"),
    )


@query(
    "M15_loss_by_round",
    f"""WITH {_GROUPED}, parts AS (SELECT class, CASE WHEN l_orderkey % 5 = 0 THEN 'validation' ELSE 'train' END AS part FROM grouped),
    prior AS (SELECT class, ln(count(*) / sum(count(*)) OVER ()) AS l FROM parts WHERE part = 'train' GROUP BY class),
    r AS (SELECT unnest(range(0, {ROUNDS + 1})) AS round)
    SELECT part, round, count(*) AS n, CASE WHEN round = 0 THEN round(-avg(l), 6) END AS loss_of_shares, true AS falls,
      true AS last_is_log_loss FROM parts JOIN prior USING (class), r GROUP BY part, round""",
)
def loss_by_round(spark, sf):
    """Training and validation loss after each round, from one pass; the last is that of the whole model."""
    rows = flows(spark, sf).withColumn("part", F.when(F.col("l_orderkey") % 5 == 0, "validation").otherwise("train"))
    package = trained(rows.where("part = 'train'"), method="joint", trees=ROUNDS)
    losses = stage(classify.loss_by_round(rows, package, part=F.col("part")), "losses")
    whole = metrics.log_loss(classify.score(rows, package), package.classes, actual="Label", by=["part"])
    whole = {r.part: r.log_loss for r in whole.collect()}
    # Rounds of the training part never go up by more than a subsample's noise, and end lower than they began.
    first = {r.part: r.log_loss for r in losses.where("round = 0").collect()}
    start = F.when(F.col("part") == "train", first["train"]).otherwise(first["validation"])
    end = F.when(F.col("part") == "train", whole["train"]).otherwise(whole["validation"])
    return losses.select(
        "part",
        "round",
        "n",
        F.when(F.col("round") == 0, F.round("log_loss", 6)).alias("loss_of_shares"),
        ((F.col("part") != "train") | (F.col("round") == 0) | (F.col("log_loss") < start)).alias("falls"),
        ((F.col("round") < ROUNDS) | (F.abs(F.col("log_loss") - end) < 1e-9)).alias("last_is_log_loss"),
    )


@query(
    "M2_probabilities_sum",
    "SELECT count(*) AS n, CAST(6 AS BIGINT) AS classes, count(*) AS sums_to_one, count(*) AS in_range FROM lineitem",
)
def probabilities(spark, sf):
    """Every row gets six probabilities between 0 and 1 that sum to 1."""
    rows = flows(spark, sf)
    package = trained(rows)
    scored = classify.score(rows, package)
    total = F.aggregate("probability", F.lit(0.0), lambda s, v: s + v)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("probability")).cast("long").alias("classes"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.forall("probability", lambda v: (v >= 0) & (v <= 1))).alias("in_range"),
    )


@query(
    "M2_batch_scoring",
    "SELECT count(*) AS n, CAST(6 AS BIGINT) AS probabilities, true AS known_classes, true AS largest_wins FROM lineitem",
)
def scoring(spark, sf):
    """The prediction table: the predicted class is the one of the largest probability."""
    rows = flows(spark, sf)
    package = trained(rows)
    table = triage.prediction_table(classify.score(rows, package), package.classes)
    names = [f"prob_{c}" for c in package.classes]
    own = F.coalesce(*[F.when(F.col("prediction") == c, F.col(f"`prob_{c}`")) for c in package.classes])
    most = F.greatest(*[F.col(f"`{n}`") for n in names])
    return table.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(len(names)).cast("long").alias("probabilities"),
        F.bool_and(F.col("prediction").isin(package.classes)).alias("known_classes"),
        F.bool_and((own == most) & (most == F.col("max_probability"))).alias("largest_wins"),
    )


@query(
    "M14_feature_importances",
    f"SELECT unnest({COLUMNS}) AS feature, true AS in_range, true AS falling, 1.0::DOUBLE AS total",
)
def importances(spark, sf):
    """Importances of all features fall, lie between 0 and 1 and sum to 1."""
    rows = flows(spark, sf)
    table = classify.feature_importances(trained(rows), rows).collect()
    values = [r.importance for r in table]
    return small_table(
        spark,
        [
            {"feature": r.feature, "in_range": 0 <= r.importance <= 1, "falling": values == sorted(values, reverse=True), "total": round(sum(values), 9)}
            for r in table
        ],
        "feature string, in_range boolean, falling boolean, total double",
    )


@query(
    "S8_S9_classifier_round_trip",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM lineitem",
)
def classifier_round_trip(spark, sf):
    """Scores of a saved and reloaded package equal those of the original."""
    rows = flows(spark, sf)
    package = trained(rows)
    path = work_folder(spark, "classifier")
    packages.save_classifier(spark, package, path)
    loaded = packages.load_classifier(spark, path)
    once = classify.score(rows, package).withColumnRenamed("probability", "before")
    both = classify.score(once, loaded)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("probability")).alias("differing")
    )


def sequence_windows(spark, sf):
    rows = view(spark, sf, SEQUENCES).withColumn("x", F.array("value", F.sqrt("value")))
    made = sequences.strided_sequences(
        rows, ["device_id"], ["ts", "event_id"], "x", stride=3, slice_by=time_slice(F.col("ts"), WEEK)
    )
    return stage(made, "windows")


# All cells of all windows, and the sum of their variances per place in the window.
_CELLS = f"""WITH s AS ({sql(SEQUENCES)}), n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS n FROM s),
cells AS (SELECT n AS row_no, device_id, i, j, CASE j WHEN 0 THEN v ELSE sqrt(v) END AS x FROM (
  SELECT n, device_id, unnest(range(10)) AS i, unnest(list(value) OVER (PARTITION BY device_id ORDER BY ts, event_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS v FROM n QUALIFY n >= 10 AND (n - 10) % 3 = 0), (VALUES (0), (1)) AS t(j)),
spread AS (SELECT sum(s) AS total FROM (SELECT var_pop(x) AS s FROM cells GROUP BY i, j)),
wins AS (SELECT count(*) AS n FROM n WHERE n >= 10 AND (n - 10) % 3 = 0)"""


def variance_of(errors, shares):
    """The windows' whole variance, by what the components leave of it: their errors."""
    cells = 20
    return errors.agg(F.avg("mse")).first()[0] * cells / (1 - sum(shares))


@query(
    "W3_fit_reconstruction",
    f"{_CELLS} SELECT CAST(component AS BIGINT) AS component, true AS falling, round(total, 4) AS variance "
    "FROM spread, (SELECT unnest(range(1, 5)) AS component)",
)
def fit_reconstruction(spark, sf):
    """Components explain falling shares, and what they leave unexplained is the reconstruction error."""
    windows = sequence_windows(spark, sf)
    model = anomaly.fit_reconstruction(windows, 4)
    shares = [float(v) for v in model.stages[1].explainedVariance.toArray()]
    total = variance_of(anomaly.add_errors(anomaly.reconstruct(windows, model)), shares)
    return small_table(
        spark,
        [
            {"component": i, "falling": i == 1 or share <= shares[i - 2], "variance": round(total, 4)}
            for i, share in enumerate(shares, start=1)
        ],
        "component long, falling boolean, variance double",
    )


@query(
    "W4_full_reconstruction",
    f"""WITH s AS ({sql(SEQUENCES)}), n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS n FROM s)
    SELECT count(*) AS n, count(*) AS exact FROM n WHERE n >= 10 AND (n - 10) % 3 = 0""",
)
def full_reconstruction(spark, sf):
    """With as many components as cells, the projection gives every window back."""
    windows = sequence_windows(spark, sf)
    model = anomaly.fit_reconstruction(windows, 20)
    errors = anomaly.add_errors(anomaly.reconstruct(windows, model))
    return errors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mse") < 1e-12).alias("exact"))


@query(
    "W4_pca_errors",
    f"{_CELLS} SELECT n, n AS judged, round(total, 4) AS variance, true AS split_by_threshold, true AS more_components_fit_better "
    "FROM wins, spread",
)
def pca_errors(spark, sf):
    """Errors of eight components: their mean is the variance left, and the threshold splits them."""
    windows = sequence_windows(spark, sf)
    model = anomaly.fit_reconstruction(windows, 8)
    errors = stage(anomaly.add_errors(anomaly.reconstruct(windows, model)).drop("sequence", "rebuilt"), "errors")
    fitted = anomaly.fit_threshold(errors)
    row = anomaly.detection_summary(anomaly.detect_anomalies(errors, fitted)).first()
    above = errors.where(F.col("mse") > fitted.threshold).count()
    shares = [float(v) for v in model.stages[1].explainedVariance.toArray()]
    fewer = anomaly.add_errors(anomaly.reconstruct(windows, anomaly.fit_reconstruction(windows, 4)))
    better = errors.agg(F.avg("mse")).first()[0] < fewer.agg(F.avg("mse")).first()[0]
    return small_table(
        spark,
        [{
            "n": row.total, "judged": row.anomalies + row.normal, "variance": round(variance_of(errors, shares), 4),
            "split_by_threshold": row.anomalies == above > 0, "more_components_fit_better": better,
        }],
        "n long, judged long, variance double, split_by_threshold boolean, more_components_fit_better boolean",
    )


@query(
    "S10_S11_anomaly_round_trip",
    f"""WITH s AS ({sql(SEQUENCES)}), n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS n FROM s)
    SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing, true AS absent_is_off FROM n WHERE n >= 10 AND (n - 10) % 3 = 0""",
)
def anomaly_round_trip(spark, sf):
    windows = sequence_windows(spark, sf)
    model = anomaly.fit_reconstruction(windows, 4)
    path = work_folder(spark, "anomaly")
    package = packages.AnomalyPackage(
        model, fit_standard(view(spark, sf, SEQUENCES), ["value"]), anomaly.AnomalyParams(100.0, 1.0, 1.0), ["value"]
    )
    packages.save_anomaly_model(spark, package, path)
    loaded = packages.load_anomaly_model(spark, path)
    both = anomaly.reconstruct(anomaly.reconstruct(windows, model), loaded.model, output="again")
    absent = packages.load_anomaly_model(spark, f"{path}/nothing-here") is None
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rebuilt") != F.col("again")).alias("differing")
    ).withColumn("absent_is_off", F.lit(absent))


@query(
    "W11_judge_saved_package",
    f"""WITH s AS ({sql(SEQUENCES)}),
    v AS (SELECT *, least(greatest((coalesce(value, 0) - 50) / 25, -5), 5) AS y FROM s),
    w AS (SELECT device_id, y, lag(y) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS x FROM v QUALIFY x IS NOT NULL),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS angle FROM w),
    e AS (SELECT device_id, pow((y - my) * cos(angle) - (x - mx) * sin(angle), 2) / 2 AS mse FROM w, m)
    SELECT device_id, count(*) AS windows, count(*) FILTER (mse > 0.5) AS anomalies, round(max(mse), 6) AS highest_mse,
           round(count(*) FILTER (mse > 0.5) / count(*), 6) AS anomaly_share
    FROM e GROUP BY device_id""",
)
def judge_saved_package(spark, sf):
    """A saved model of pairs of rows judges the table: what one axis of two leaves is known in closed form."""
    rows = view(spark, sf, SEQUENCES)
    scaler = ScaleParams(["value"], [50.0], [25.0])
    vectors = rows.withColumn("vector", scale_features(F.array("value"), scaler))
    pairs = sequences.strided_sequences(
        vectors, ["device_id"], ["ts", "event_id"], "vector", length=2, slice_by=time_slice(F.col("ts"), WEEK)
    )
    path = work_folder(spark, "judging")
    model = anomaly.fit_reconstruction(stage(pairs, "pairs"), 1)
    package = packages.AnomalyPackage(model, scaler, anomaly.AnomalyParams(0.5, 0.25, 0.25), ["value"], 2)
    packages.save_anomaly_model(spark, package, f"{path}/package")
    judged = judge_flows(
        rows, f"{path}/package", f"{path}/judging", keys=["device_id"], order_by=["ts", "event_id"],
        slice_by=time_slice(F.col("ts"), WEEK),
    )
    return rounded(judged["by_key"])


_MARKED = (FLOWS[0], [*FLOWS[1], "l_orderkey", "l_linenumber"])


@query(
    "S3_M8_train_from_flows",
    f"""SELECT device, count(*) AS uncertain, count(*) - 4 AS windows FROM ({sql(_MARKED)}) WHERE f_rare = 1
    GROUP BY device HAVING count(*) > 4""",
)
def chain_from_flows(spark, sf):
    """A classifier that knows one column to mean DOUBT; its rows are extracted, trained on and judged."""
    rows = stage(view(spark, sf, _MARKED).withColumn("Label", F.when(F.col("f_rare") == 1, "DOUBT").otherwise("BENIGN")), "marked")
    columns = ["f_rare", "f_qty", "f_disc", "f_tax"]
    classifier = classify.train_classifier(
        spread_for_training(rows), fit_standard(rows, columns), ["BENIGN", "DOUBT"], method="joint", trees=10, depth=2
    )
    path = work_folder(spark, "chain")
    packages.save_classifier(spark, classifier, f"{path}/classifier")
    by_device = dict(keys=["device"], order_by=["l_orderkey", "l_linenumber"])
    train_from_flows(
        spark, f"{path}/anomaly", flows=rows, classifier=f"{path}/classifier", length=5, components=4, **by_device
    )
    uncertain = spark.read.parquet(f"{path}/anomaly/uncertain")
    judged = judge_flows(uncertain, f"{path}/anomaly/package", f"{path}/judging", **by_device)["by_key"]
    return uncertain.groupBy("device").agg(F.count(F.lit(1)).alias("uncertain")).join(judged, "device").select(
        "device", "uncertain", "windows"
    )


# --- files ---

_CSV = "f_qty, f_disc, f_tax, f_rare, device, Label"


@query("S1_csv_labelled", f"SELECT Label, count(*) AS n, round(sum(f_qty), 3) AS qty, round(sum(f_disc), 3) AS disc FROM ({sql(FLOWS)}) GROUP BY Label")
def csv_labelled(spark, sf):
    """CSV with a header and discovered types."""
    path = work_folder(spark, "flows")
    tables.write_csv(view(spark, sf, FLOWS), path)
    rows = tables.read_labelled_flows(spark, path)
    return rows.groupBy("Label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("f_qty"), 3).alias("qty"), F.round(F.sum("f_disc"), 3).alias("disc")
    )


@query(
    "S2_csv_features",
    f"SELECT f_tax, f_qty, count(*) AS n, round(sum(f_disc), 3) AS disc FROM ({sql(FLOWS)}) GROUP BY f_tax, f_qty",
)
def csv_features(spark, sf):
    """CSV files with their columns in different orders, read in the saved order."""
    path = work_folder(spark, "features")
    columns = ["f_qty", "f_disc", "f_tax"]
    rows = view(spark, sf, FLOWS)
    tables.write_csv(rows.where("f_qty > 25").select(*columns), path)
    rows.where("f_qty <= 25").select(*reversed(columns)).write.mode("append").option("header", True).csv(path)
    rows = tables.read_features(spark, path, columns)
    return rows.groupBy("f_tax", "f_qty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f_disc"), 3).alias("disc"))


@query(
    "S3_load_or_extract",
    f"SELECT device, count(*) AS n FROM ({sql(FLOWS)}) WHERE f_qty > 25 GROUP BY device",
)
def load_or_extract(spark, sf):
    """The second call finds the saved rows and does not extract again."""
    path = work_folder(spark, "uncertain")
    rows = view(spark, sf, FLOWS).where("f_qty > 25")
    tables.load_or_extract(spark, path, lambda: rows)
    return tables.load_or_extract(spark, path, None).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6_csv_sink",
    f"SELECT nullif(device_id, '') AS device_id, count(*) AS n FROM ({sql(MESSAGES)}) GROUP BY 1",
)
def csv_sink(spark, sf):
    """Text with commas survives the sink; empty text comes back as missing, as CSV has it."""
    path = work_folder(spark, "messages")
    rows = view(spark, sf, MESSAGES)
    tables.write_csv(rows.select("device_id", "csv_data", "event_id"), path)
    schema = T.StructType(
        [T.StructField("device_id", T.StringType()), T.StructField("csv_data", T.StringType()), T.StructField("event_id", T.LongType())]
    )
    back = tables.read_labelled_flows(spark, path, schema)
    return back.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
