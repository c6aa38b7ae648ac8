"""Joint boosting against a plain program on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import boosting, classify, metrics
from flowguard.operators.scaling import fit_standard
from flowguard.sources import packages
from workload import model_queries

CLASSES = ["a", "b", "c"]
COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    data = []
    for i, name in enumerate(CLASSES):
        for x in r.normal(size=(150 - 40 * i, 3)) + [i, -i, 0]:
            data.append((*map(float, np.round(x, 2)), name))
    data += [(float("nan"), None, 0.5, "a"), (None, None, None, "c"), (1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "x double, y double, z double, Label string").repartition(4).cache()


def fitted(rows, **options):
    features = F.array(*[F.col(c) for c in COLUMNS])
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("Label"))
    settings = {"rounds": 4, "depth": 3, "row_share": 1.1, "column_share": 1.0} | options
    return boosting.fit_boosted(rows, features, F.when(index > 0, index - 1), len(CLASSES), COLUMNS, **settings)


def plain(model, x, y, rounds, depth, step=0.1):
    """Values of all rows after each round, by trying every split of every node."""
    bins = model.binned(x)
    margins = np.tile(np.array(model.start), (len(x), 1))
    out = [margins.copy()]
    score = lambda g, h: (g**2 / (h + 1)).sum()
    for _ in range(rounds):
        e = np.exp(margins)
        p = e / e.sum(axis=1, keepdims=True)
        g, h = p - np.eye(3)[y], p * (1 - p)
        todo, values = [(np.arange(len(x)), 0)], np.zeros_like(margins)
        for rows_, level in todo:
            best = (1e-9, None)
            for f in range(x.shape[1] if level < depth else 0):
                for b in range(boosting.BINS):
                    left = rows_[bins[rows_, f] <= b]
                    right = rows_[bins[rows_, f] > b]
                    if min(h[left].sum(), h[right].sum()) < 1:
                        continue
                    gain = score(g[left].sum(0), h[left].sum(0)) + score(g[right].sum(0), h[right].sum(0)) - score(g[rows_].sum(0), h[rows_].sum(0))
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            if best[1] is None:
                if level:
                    values[rows_] = -step * g[rows_].sum(0) / (h[rows_].sum(0) + 1)
            else:
                todo += [(part, level + 1) for part in best[1]]
        margins = margins + values
        out.append(margins.copy())
    return out


def test_trees_are_those_of_a_plain_program(rows):
    model = fitted(rows)
    known = rows.where("Label IS NOT NULL").collect()
    x = np.array([[np.nan if v is None else v for v in (r.x, r.y, r.z)] for r in known], float)
    y = np.array([CLASSES.index(r.Label) for r in known])
    assert len(model.trees) == 4 and all(len(e) < boosting.BINS for e in model.edges)
    for got, want in zip(model.margins(x), plain(model, x, y, 4, 3), strict=True):
        assert np.allclose(got, want)
    shares = np.bincount(y) / len(y)
    assert np.allclose(np.exp(model.start), shares)


def test_result_does_not_depend_on_partitions_or_written_states(rows, monkeypatch):
    once = fitted(rows, rounds=5, row_share=0.8, column_share=0.7)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 1)
    again = fitted(rows.repartition(2), rounds=5, row_share=0.8, column_share=0.7)
    for a, b in zip(once.trees, again.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)


def test_package_scores_saves_and_tells_its_losses(spark, rows, tmp_path):
    scaler = fit_standard(rows.na.fill(0.0), COLUMNS)
    package = classify.train_classifier(rows, scaler, CLASSES, method="joint", trees=6, depth=3)
    packages.save_classifier(spark, package, str(tmp_path / "p"))
    loaded = packages.load_classifier(spark, str(tmp_path / "p"))
    known = rows.where("Label IS NOT NULL")
    both = [classify.score(known, p).orderBy(*COLUMNS, "Label").collect() for p in (package, loaded)]
    assert str(both[0]) == str(both[1])
    assert all(sum(r.probability) == pytest.approx(1.0) for r in both[0])
    losses = {r["round"]: r for r in classify.loss_by_round(known, package).collect()}
    whole = metrics.log_loss(classify.score(known, package), CLASSES, actual="Label").first()
    assert sorted(losses) == list(range(7)) and losses[6].n == whole.n == known.count()
    assert losses[6].log_loss == pytest.approx(whole.log_loss) and losses[6].log_loss < losses[3].log_loss < losses[0].log_loss
    table = classify.feature_importances(package, rows).collect()
    assert sum(r.importance for r in table) == pytest.approx(1.0) and table[-1].feature == "z"
    parts = classify.loss_by_round(known, package, part=F.when(F.col("x") > 0, "high")).where("round = 0").collect()
    assert {r.part for r in parts} == {"high", None} and sum(r.n for r in parts) == known.count()
    forest = classify.train_classifier(known.na.fill(0.0), scaler, CLASSES, trees=2, depth=2)
    with pytest.raises(ValueError, match="no rounds"):
        classify.loss_by_round(known, forest)


def test_one_class_and_constant_features(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, "b")] * 20, "x double, y double, z double, Label string")
    model = fitted(rows)
    assert all((t.feature < 0).all() and (t.value == 0).all() for t in model.trees)
    assert model.importances().sum() == 0


def test_a_round_computes_the_probabilities_of_its_rows_once(spark):
    r = np.random.default_rng(2)
    n, margins = 1000, r.normal(size=(3, 1000))
    y, draw, bins = r.integers(0, 3, n).astype(np.int32), r.integers(-(2**63), 2**63 - 1, n), r.integers(0, 9, (2, n)).astype(np.uint8)
    state = spark.sparkContext.parallelize([tuple(v.tobytes() for v in (y, draw, bins, margins))], 1)
    ((some, part, p),) = boosting._drawn(state, 3, 0.5, 2, 3).collect()
    taken = boosting._taken(draw, 3, 0.5)
    assert 400 < taken.sum() < 600 and (np.frombuffer(some, np.int32) == y[taken]).all()
    assert (np.frombuffer(part, np.uint8).reshape(2, -1) == bins[:, taken]).all()
    want = np.exp(margins[:, taken]) / np.exp(margins[:, taken]).sum(axis=0)
    assert np.allclose(np.frombuffer(p, np.float32).reshape(3, -1), want, atol=1e-6)


def test_flows_are_dealt_to_all_cores(spark, sf):
    assert spark.read.parquet(f"{sf}/lineitem.parquet").rdd.getNumPartitions() == 1
    rows = model_queries.flows(spark, sf)
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_boosted_ensembles_read_rows_that_were_written_once(rows, monkeypatch):
    paths, real = [], classify.write_and_read
    monkeypatch.setattr(classify, "write_and_read", lambda df, path: paths.append(path) or real(df, path))
    known = rows.where("Label IS NOT NULL").na.fill(0.0)
    package = classify.train_classifier(known, fit_standard(known, COLUMNS), CLASSES, method="boosted", trees=2, depth=2)
    assert len(paths) == 1 and len(package.model.stages) == 3
    assert all(sum(r.probability) == pytest.approx(1.0) for r in classify.score(known, package).collect())


@pytest.fixture(scope="module")
def repeated(spark):
    """Few different rows, most of them many times, one of them a third of all."""
    r = np.random.default_rng(8)
    x, y = r.integers(0, 3, (600, 3)), r.integers(0, 3, 600)
    x[:200], y[:200] = 1, 0
    return spark.createDataFrame([(*map(float, v), CLASSES[k]) for v, k in zip(x, y, strict=True)], "x double, y double, z double, Label string").repartition(4).cache()


def test_rows_in_the_same_bins_are_one_group(spark, repeated, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(boosting, "remove_path", lambda spark, path: kept.append(path))
    model = fitted(repeated, folder=str(tmp_path))
    known = repeated.collect()
    x, y = np.array([[r.x, r.y, r.z] for r in known]), np.array([CLASSES.index(r.Label) for r in known])
    for got, want in zip(model.margins(x), plain(model, x, y, 4, 3), strict=True):
        assert np.allclose(got, want)
    state = spark.read.parquet(str(tmp_path / "state-0"))
    size = state.agg(F.sum(F.length("y") / 4).alias("rows"), F.sum(F.length("bins") / 3).alias("groups")).first()
    assert size.rows == 600 and size.groups < 300


def test_a_round_takes_the_same_rows_of_groups_as_of_rows(spark):
    r = np.random.default_rng(2)
    owner = np.sort(r.integers(0, 50, 1000)).astype(np.int32)
    y, draw = r.integers(0, 3, 1000).astype(np.int32), r.integers(-(2**63), 2**63 - 1, 1000)
    bins, margins = r.integers(0, 9, (2, 50)).astype(np.uint8), r.normal(size=(3, 50))
    grouped = tuple(v.tobytes() for v in (y, draw, bins, margins, owner))
    single = (*(v.tobytes() for v in (y, draw, bins[:, owner], margins[:, owner])), b"")
    tree = boosting.Tree.empty(2, 3)
    tree.feature[0], tree.bin[0] = 1, 4
    tree.feature[1] = -1
    for level in (0, 1):
        one, other = (
            boosting._best_splits(boosting._drawn(spark.sparkContext.parallelize([block], 1), 3, 0.5, 2, 3), tree, level, [0, 1], 2)
            for block in (grouped, single)
        )
        assert [v[:3] for v in one] == [v[:3] for v in other] and len(one) == level + 1
        assert all(np.allclose(a, b) for v, w in zip(one, other, strict=True) for a, b in zip(v[3:], w[3:], strict=True))
    added = boosting._added(spark.sparkContext.parallelize([grouped], 1), tree, 2).first()
    assert added[4] == grouped[4] and len(added[3]) == len(grouped[3])
