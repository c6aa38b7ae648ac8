"""The forest against a plain program on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import classify, forest
from flowguard.operators.scaling import fit_standard
from flowguard.operators.trees import Tree, block_rdd, blocks
from flowguard.sources import packages

CLASSES = ["a", "b", "c"]
COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    data = []
    for i, name in enumerate(CLASSES):
        for x in r.normal(size=(150 - 40 * i, 3)) + [i, -i, 0]:
            data.append((*map(float, np.round(x, 2)), name))
    data += [(float("nan"), None, 0.5, "a"), (1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "x double, y double, z double, Label string").repartition(4).cache()


def fitted(rows, **options):
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("Label"))
    features = F.array(*[F.col(c) for c in COLUMNS])
    return forest.fit_forest(rows, features, F.when(index > 0, index - 1), 3, COLUMNS, **{"trees": 5, "depth": 3} | options)


def plain(bins, y, depth):
    """Class shares of all rows in one tree over all rows and features, by trying every split of every node."""
    impurity = lambda s: len(s) - (np.bincount(s, minlength=3) ** 2).sum() / len(s) if len(s) else 0.0
    out, todo = np.zeros((len(y), 3)), [(np.arange(len(y)), 0)]
    for part, level in todo:
        best = (1e-9 * len(part), None)
        for f in range(bins.shape[1] if level < depth else 0):
            for b in range(forest.BINS):
                sides = part[bins[part, f] <= b], part[bins[part, f] > b]
                gain = impurity(y[part]) - sum(impurity(y[s]) for s in sides)
                if min(map(len, sides)) and gain > best[0] + 1e-9:
                    best = (gain, sides)
        if best[1] is None:
            out[part] = np.bincount(y[part], minlength=3) / len(part)
        else:
            todo += [(s, level + 1) for s in best[1]]
    return out


def test_trees_over_whole_samples_are_those_of_a_plain_program(rows, monkeypatch):
    monkeypatch.setattr(forest, "_times", lambda share: np.ones(1 << 16))
    model = fitted(rows, column_share=1.0)
    known = rows.where("Label IS NOT NULL").collect()
    x = np.array([[np.nan if v is None else v for v in (r.x, r.y, r.z)] for r in known], float)
    y = np.array([CLASSES.index(r.Label) for r in known])
    assert np.allclose(model.probabilities(x), plain(forest.binned(model.edges, x), y, 3))
    assert np.allclose(model.start, np.bincount(y) / len(y))


def test_bootstrap_takes_rows_by_poisson():
    times = forest._times(0.8)
    assert times.mean() == pytest.approx(0.8, abs=1e-3) and (times == 0).mean() == pytest.approx(np.exp(-0.8), abs=1e-4)
    assert times.max() >= 5


def test_more_passes_give_the_same_trees_and_other_seeds_others(rows, monkeypatch):
    table = rows.coalesce(1)
    once = fitted(table)
    monkeypatch.setattr(forest, "COUNTED", 1)
    again, other = fitted(table), fitted(table, seed=7)
    for a, b in zip(once.trees, again.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all()
    assert any((a.value != b.value).any() for a, b in zip(once.trees, other.trees, strict=True))
    assert len({t.value.tobytes() for t in once.trees}) > 1


def test_a_row_costs_the_same_for_any_number_of_trees(rows, spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(forest, "remove_path", lambda spark, path: kept.append(path))
    for trees in (2, 40):
        fitted(rows, trees=trees, depth=1, folder=str(tmp_path / str(trees)))
    sizes = [spark.read.parquet(p).agg(F.sum(F.length("y") + F.length("bins"))).first()[0] for p in kept]
    assert sizes[0] == sizes[1] == rows.where("Label IS NOT NULL").count() * (4 + len(COLUMNS))


def test_blocks_cut_and_join_batches():
    import pyarrow as pa

    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n))], ["v"])
    assert [t.num_rows for t in blocks([batch(3), batch(0), batch(8), batch(1)], 5)] == [5, 5, 2]
    assert list(blocks([])) == []


def test_package_scores_and_comes_back_the_same(spark, rows, tmp_path):
    known = rows.where("Label IS NOT NULL").na.fill(0.0)
    package = classify.train_classifier(known, fit_standard(known, COLUMNS), CLASSES, trees=6, depth=3)
    packages.save_classifier(spark, package, str(tmp_path / "p"))
    loaded = packages.load_classifier(spark, str(tmp_path / "p"))
    both = [classify.score(known, p).orderBy(*COLUMNS, "Label").collect() for p in (package, loaded)]
    assert str(both[0]) == str(both[1])
    assert all(sum(r.probability) == pytest.approx(1.0) and len(r.probability) == 3 for r in both[0])
    right = sum(CLASSES[int(np.argmax(r.probability))] == r.Label for r in both[0])
    assert right > 0.6 * len(both[0])
    table = classify.feature_importances(package, rows).collect()
    assert sum(r.importance for r in table) == pytest.approx(1.0) and table[-1].feature == "z"
    stream = spark.createDataFrame([([1.0, 1.0, 1.0],), (None,)], "features array<double>")
    assert [r.probability is None for r in classify.score(stream, package, F.col("features")).collect()] == [False, True]


def test_one_class_and_constant_features(spark):
    data = spark.createDataFrame([(1.0, 1.0, 1.0, "b")] * 20, "x double, y double, z double, Label string")
    model = fitted(data)
    assert model.probabilities(np.ones((2, 3))).tolist() == [[0.0, 1.0, 0.0]] * 2 and model.importances().sum() == 0


def test_all_trees_at_once_are_the_trees_walked_one_by_one(monkeypatch):
    r = np.random.default_rng(5)
    edges = [list(map(float, range(n))) for n in (31, 9, 1)]
    trees = [Tree.empty(6, 3) for _ in range(9)]
    for tree in trees:
        tree.value[:] = r.random(tree.value.shape)
        for node in range(63):
            # Some nodes aren't split, and nothing is below them.
            if (node == 0 or tree.feature[(node - 1) // 2] >= 0) and r.random() < 0.9:
                tree.feature[node], tree.bin[node] = r.integers(0, 3), r.integers(0, 31)
    x = np.stack([r.integers(-1, n + 1, 300) + 0.5 for n in (31, 9, 1)], axis=1)
    x[::17] = np.nan
    whole = forest.ForestModel(edges, [0.2, 0.3, 0.5], trees)
    assert whole._ends is not None
    bins = forest.binned(edges, x)
    want = np.zeros((300, 3))
    for tree in trees:
        for i, row in enumerate(bins):
            path = [0]
            while path[-1] < 63 and tree.feature[path[-1]] >= 0:
                path.append(2 * path[-1] + 1 + int(row[tree.feature[path[-1]]] > tree.bin[path[-1]]))
            want[i] += tree.value[path[-1]] / 9
            assert [tree.nodes(bins[i : i + 1].T, k)[0] for k in range(7)] == [path[min(k, len(path) - 1)] for k in range(7)]
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(whole.probabilities(x), want)
    monkeypatch.setattr(forest, "_MASKED_FEATURES", 2)
    walked = forest.ForestModel(edges, [0.2, 0.3, 0.5], trees)
    assert walked._ends is None and np.allclose(walked.probabilities(x), want)
    assert forest.ForestModel(edges, [0.2, 0.3, 0.5], [Tree.empty(2, 3)])._ends[1].shape == (4, 3)


def test_blocks_are_dealt_by_their_number(spark):
    table = spark.range(40).selectExpr("cast(cast(id as string) as binary) AS b").repartition(1)
    cores = spark.sparkContext.defaultParallelism
    assert block_rdd(table, ["b"], 100).getNumPartitions() == cores
    few = block_rdd(table, ["b"], 2)
    assert few.getNumPartitions() == cores * -(-40 // (2 * cores))
    assert sorted(int(v[0]) for v in few.collect()) == list(range(40))


def test_rows_of_one_class_in_the_same_bins_are_one_entry(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(8)
    x, y = r.integers(0, 3, (600, 3)), r.integers(0, 3, 600)
    x[:200], y[:200] = 1, 0
    rows = spark.createDataFrame([(*map(float, v), CLASSES[k]) for v, k in zip(x, y, strict=True)], "x double, y double, z double, Label string")
    kept = []
    monkeypatch.setattr(forest, "remove_path", lambda spark, path: kept.append(path))
    # A sample that takes every row once.
    monkeypatch.setattr(forest, "_drawn_times", lambda generator, draws, n, runs, tables, share: n.astype(float))
    monkeypatch.setattr(forest, "_times", lambda share: np.ones(1 << 16))
    model = fitted(rows.repartition(4), column_share=1.0, folder=str(tmp_path))
    assert np.allclose(model.probabilities(x.astype(float)), plain(forest.binned(model.edges, x.astype(float)), y, 3))
    sizes = spark.read.parquet(*kept).agg(F.sum(F.length("y") / 4), F.sum(F.length("bins") / 3)).first()
    assert sizes[0] == sizes[1] < 300


def test_entries_are_drawn_as_often_as_their_rows():
    n = np.sort(np.random.default_rng(1).integers(1, 60, 20000))
    runs = forest._runs(n)
    assert [v for v, _, _ in runs] == list(range(1, forest._TABLED + 1)) and forest._runs(n[:0]) == []
    tables = {v: forest._times(0.8 * v).astype(np.uint8) for v, _, _ in runs}
    total = np.zeros(len(n))
    squares = np.zeros(len(n))
    for i in range(200):
        generator = np.random.SFC64([42, 3, i])
        draws = generator.random_raw(len(n) // 4).view(np.uint16)
        times = forest._drawn_times(generator, draws, n, runs, tables, 0.8)
        total += times
        squares += times**2
    # A Poisson draw's mean and variance are the same.
    for v in (1, 2, 10, 32, 33, 59):
        mean = total[n == v].mean() / 200
        assert mean == pytest.approx(0.8 * v, rel=0.02)
        assert squares[n == v].mean() / 200 - mean**2 == pytest.approx(0.8 * v, rel=0.04)
