"""One boosted ensemble per class, all grown together."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowguard.operators import classify, ensembles
from flowguard.operators.scaling import fit_standard, scale_features
from flowguard.operators.trees import Tree
from flowguard.sources import packages

COLUMNS, CLASSES = ["x", "y", "z"], ["a", "b", "c", "never"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    x = np.column_stack([r.integers(0, 9, 1500), r.integers(0, 20, 1500), np.where(r.random(1500) < 0.01, 0, 1)]).astype(float)
    y = np.where(x[:, 2] == 0, 2, (x[:, 0] + r.normal(size=1500) > 4).astype(int))
    named = [(*map(float, v), CLASSES[k]) for v, k in zip(x, y, strict=True)] + [(1.0, 2.0, 1.0, None), (3.0, 1.0, 1.0, "unknown")]
    return spark.createDataFrame(named, "x double, y double, z double, Label string").repartition(4).cache()


def train(rows, **settings):
    return classify.train_classifier(rows, fit_standard(rows, COLUMNS), CLASSES, method="boosted", **(dict(trees=3, depth=2) | settings))


def scored(rows, package):
    return {tuple(r[:3]): r.probability for r in classify.score(rows, package).select(*COLUMNS, "probability").collect()}


def test_ensembles_are_those_of_mllib(rows):
    package = train(rows, row_share=1.0, column_share=1.0)
    assert package.model_classes == [0, 1, 2] and [len(s) for s in package.model.stages] == [3, 3, 3]
    found, importances = scored(rows, package), []
    known = rows.where(F.col("Label").isin(CLASSES))
    vectors = known.withColumn("vector", array_to_vector(scale_features(F.array(*COLUMNS), package.scaler, limit=None)))
    each = vectors
    for k in range(3):
        settings = dict(featuresCol="vector", labelCol="own", predictionCol=f"q{k}", maxIter=3, maxDepth=2, stepSize=0.1, seed=42)
        mllib = GBTClassifier(**settings).setProbabilityCol(f"p{k}").setRawPredictionCol(f"r{k}")
        model = mllib.fit(vectors.withColumn("own", (F.col("Label") == CLASSES[k]).cast("double")))
        importances.append(model.featureImportances.toArray())
        each = model.transform(each)
    for r in each.select(*COLUMNS, F.array(*[vector_to_array(f"p{k}")[1] for k in range(3)]).alias("p")).distinct().collect():
        assert np.allclose(found[tuple(r[:3])], [*(np.array(r.p) / sum(r.p)), 0.0], atol=1e-6)
    table = {r.feature: r.importance for r in classify.feature_importances(package, rows).collect()}
    assert np.allclose([table[c] for c in COLUMNS], np.mean(importances, axis=0), atol=1e-6)


def test_jobs_do_not_grow_with_the_classes(spark, rows):
    def jobs(labels, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            of = F.element_at(F.array(*map(F.lit, labels)), (F.col("x").cast("int") % len(labels)) + 1)
            data = rows.withColumn("Label", of)
            classify.train_classifier(data, fit_standard(data, COLUMNS), labels, method="boosted", trees=2, depth=1, column_share=1.0)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(list("abcd"), "four") == jobs(list("ab"), "two")


def test_rare_values_have_a_bin_of_their_own(spark):
    values = [0.0] * 980 + [1.0] * 2 + [2.0] * 1018
    data = spark.createDataFrame([([v, float(i)],) for i, v in enumerate(values)], "features array<double>").repartition(3)
    few, many = ensembles.ensemble_edges(data, 2)
    assert few == [0.0, 1.0, 2.0] and len(many) == ensembles.BINS - 1


def test_rounds_take_repeatable_samples(rows, monkeypatch):
    one = train(rows, row_share=0.5)
    monkeypatch.setattr(ensembles, "WRITE_EVERY", 1)
    other = train(rows, row_share=0.5)
    for a, b in zip(one.model.trees, other.model.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    single = ensembles._taken(3, np.zeros(0, np.int64), 5000, 1, 0.5, 42)
    assert 2300 < single.sum() < 2700 and set(single) == {0.0, 1.0}
    several = ensembles._taken(3, np.full(5000, 4), 5000, 1, 0.5, 42)
    assert 9500 < several.sum() < 10500 and several.max() <= 4
    assert (ensembles._taken(3, np.full(9, 4), 9, 1, 1.0, 42) == 4).all()


def test_saved_ensembles_score_alike(spark, rows, tmp_path):
    package = train(rows)
    packages.save_classifier(spark, package, str(tmp_path))
    loaded = packages.load_classifier(spark, str(tmp_path))
    assert loaded.model.start == [0.0, 0.0, 0.0, None] and loaded.method == "boosted"
    want = scored(rows, package)
    for key, p in scored(rows, loaded).items():
        assert np.allclose(p, want[key]) and p[3] == 0.0 and sum(p) == pytest.approx(1.0)


def test_rows_of_nodes_without_a_split_stay_above(spark):
    bins = np.array([[0, 0, 1, 1, 1, 1]], np.uint8)
    y, n = np.array([0, 0, 0, 1, 1, 1], np.int32), np.array([3, 1, 1, 1, 1, 2])
    state = spark.sparkContext.parallelize([(0, y.tobytes(), bins.tobytes(), n.tobytes(), b"")], 1)
    tree = Tree.empty(2, 1)
    ((k, node, feature, last, gain, left, right),) = ensembles._best_splits(state, [(0, tree)], [0, 1], 0, 0, 1, 1.0, 1, 42)
    assert (k, node, feature, last) == (0, 0, 0, 0) and left.tolist() == [4, 4] and right.tolist() == [5, -3]
    assert gain == pytest.approx(4 + 9 / 5 - 1 / 9)
    tree.feature[0], tree.bin[0] = 0, 0
    below = ensembles._best_splits(state, [(0, tree)], [0, 1], 0, 1, 1, 1.0, 1, 42)
    assert sorted((b[1], b[2]) for b in below) == [(1, -1), (2, -1)]
    # Margins after the first round: the gradients of the logistic loss.
    assert np.allclose(ensembles._residuals(np.array([True, False]), np.float32([0.5, 0.5])), [4 / (1 + np.e), -4 / (1 + np.exp(-1))])
