"""Joint multiclass gradient boosting on histograms.

A round adds one tree whose leaves hold a value per class. Its gradients are
those of the softmax loss over all classes together. The rows that a round takes
are chosen, and their probabilities computed, once per round; a level of the tree is one
pass over them: tasks sum gradients per node, feature and bin, the sums meet per node and
feature, where the best split is searched, and only the best split of each node
and feature reaches the driver. Rows keep their bins and running margins in
cached blocks (see ``trees``) that are written anew every few rounds, so a lost
executor costs a few rounds. In a block each feature's bins and each class's
margins lie together. Rows in the same bins have the same margins: rows are
ordered by their bins, and a block where bins repeat holds them, and the sums of a
pass take them, once per group of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import remove_path, work_folder, write_and_read
from .trees import BLOCK_ROWS, Tree, bin_edges, binned, block_rdd, blocks, byte_rows, grouped_sums, matrix

# Bins per feature, and rounds between two written states.
BINS = 64
WRITE_EVERY = 20
# Blocks that a task reads in one pass, about.
BLOCKS_PER_TASK = 16
# Rows that are grouped at once.
GROUPED_ROWS = 4 * BLOCK_ROWS
# Regularisation: added to each sum of second derivatives, and the least such sum of a child.
DAMPING = 1.0
LEAST_WEIGHT = 1.0


@dataclass
class BoostedModel:
    """Bin edges per feature, the margins all rows start from, and the trees."""

    edges: list[list[float]]
    start: list[float]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of feature rows; missing values are in the last bin."""
        return binned(self.edges, x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for last in self.margins(x):
            pass
        return softmax(last)

    def margins(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The margins after no tree, one tree, ... all trees."""
        bins = self.binned(x).T
        total = np.repeat(np.array(self.start)[:, None], len(x), axis=1)
        yield total.T
        for tree in self.trees:
            total = total + tree.value.T.take(tree.nodes(bins), axis=1)
            yield total.T

    def importances(self) -> np.ndarray:
        """Share of the gain that each feature's splits brought."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() > 0 else total


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_STATE = "y binary, draw binary, bins binary, margins binary, owner binary"


def _prepared(rows: DataFrame, model: BoostedModel) -> DataFrame:
    """Label index, a hash that draws subsamples, bins and first margins of the rows, in blocks.

    Where half of a block's rows or more share their bins with another, bins and margins are those of
    groups, and ``owner`` has each row's group; elsewhere it is empty. Rows with equal bins are brought
    together first; if that is cut short, as it is for a very large group, there are more groups.
    """
    width, start = len(model.edges), np.array(model.start)

    def bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = byte_rows(model.binned(matrix(batch.column("features"), width)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("draw"), bins], ["y", "draw", "bins"])

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, GROUPED_ROWS):
            y, draw = table.column("y").to_numpy().astype(np.int32), table.column("draw").to_numpy()
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            first = np.concatenate([[True], (bins[1:] != bins[:-1]).any(axis=1)])
            owner = (np.cumsum(first) - 1).astype(np.int32)
            if 2 * int(owner[-1] + 1) <= len(y):
                cut = [(y, draw, bins[first], owner)]
            else:
                cut = [(*(v[i : i + BLOCK_ROWS] for v in (y, draw, bins)), owner[:0]) for i in range(0, len(y), BLOCK_ROWS)]
            for y, draw, bins, owner in cut:
                margins = np.repeat(start[:, None], len(bins), axis=1)
                parts = [v.tobytes() for v in (y, draw, bins.T, margins, owner)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in parts], ["y", "draw", "bins", "margins", "owner"])

    placed = rows.mapInArrow(bin_rows, "y int, draw bigint, bins binary").hint("rebalance", "bins")
    return placed.sortWithinPartitions("bins", "draw", "y").mapInArrow(prepare, _STATE)


def _arrays(block: tuple, features: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y, draw, bins, margins = block[:4]
    return (
        np.frombuffer(y, np.int32), np.frombuffer(draw, np.int64),
        np.frombuffer(bins, np.uint8).reshape(features, -1), np.frombuffer(margins).reshape(classes, -1),
    )


def _added(state: RDD, tree: Tree, features: int) -> RDD:
    """The state with a tree's values added to the margins."""
    classes = tree.value.shape[1]

    def add(block: tuple) -> tuple:
        _, _, bins, margins = _arrays(block, features, classes)
        return (*block[:3], (margins + tree.value.T.take(tree.nodes(bins), axis=1)).tobytes(), *block[4:])

    return state.map(add)


def _taken(draw: np.ndarray, number: int, share: float) -> np.ndarray:
    """A repeatable subsample of the rows for one round."""
    mixed = (draw.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)) / float(1 << 53) < share


def _drawn(state: RDD, number: int, row_share: float, features: int, classes: int) -> RDD:
    """Label indexes, bins and class probabilities (in four bytes) of the rows that a round takes.

    Of groups: how many rows of each class are taken, bins and probabilities, and True.
    """

    def draw_rows(block: tuple) -> tuple:
        y, draw, bins, margins = _arrays(block, features, classes)
        take = np.flatnonzero(_taken(draw, number, row_share))
        if len(block) > 4 and block[4]:
            owner = np.frombuffer(block[4], np.int32).take(take).astype(np.intp)
            counts = np.bincount(owner * classes + y.take(take), minlength=bins.shape[1] * classes).reshape(-1, classes).T
            some = np.flatnonzero(counts.any(axis=0))
            p = softmax(margins.take(some, axis=1).T).T
            return counts.take(some, axis=1).astype(np.int32).tobytes(), bins.take(some, axis=1).tobytes(), p.astype(np.float32).tobytes(), True
        p = softmax(margins.take(take, axis=1).T).T
        return y.take(take).tobytes(), bins.take(take, axis=1).tobytes(), p.astype(np.float32).tobytes()

    return state.map(draw_rows)


def _best_splits(drawn: RDD, tree: Tree, level: int, columns: Sequence[int], features: int) -> list[tuple]:
    """The best split of each open node of a level: node, feature, bin, gain, sums of both sides."""
    classes, first, width = tree.value.shape[1], 2**level - 1, 2**level
    shape = (BINS, 2 * classes)
    path = Tree(tree.feature, tree.bin, tree.gain[:0], tree.value[:0])

    def sums(held_blocks: Iterable[tuple]) -> Iterator[tuple]:
        held = {c: np.zeros((2 * classes, width * BINS)) for c in columns}
        seen = np.zeros(width, np.int64)
        for block in held_blocks:
            y, bins, p = np.frombuffer(block[0], np.int32), np.frombuffer(block[1], np.uint8), np.frombuffer(block[2], np.float32)
            bins, p, grouped = bins.reshape(features, -1), p.reshape(classes, -1), len(block) > 3
            y = y.reshape(classes, -1) if grouped else y
            at = path.nodes(bins, level) - first
            # Rows whose node wasn't split stay above this level.
            if level and at.min(initial=0) < 0:
                here = np.flatnonzero(at >= 0)
                y, at, bins, p = y.take(here, axis=-1), at.take(here), bins.take(here, axis=1), p.take(here, axis=1)
            if not len(at):
                continue
            seen += np.bincount(at, minlength=width)
            g = p.astype(np.float64)
            h = g * (1 - g)
            if grouped:
                n = y.sum(axis=0)
                g, h = g * n - y, h * n
            for c in columns:
                place = at * BINS + bins[c]
                for k in range(classes):
                    held[c][k] += np.bincount(place, g[k], width * BINS)
                    held[c][classes + k] += np.bincount(place, h[k], width * BINS)
                if not grouped:
                    # A gradient is the probability, less 1 for the row's own class.
                    own = np.bincount(place * classes + y, minlength=width * BINS * classes)
                    held[c][:classes] -= own.reshape(-1, classes).T
        for c in columns:
            for node in np.flatnonzero(seen).tolist():
                yield (node + first, c), held[c][:, node * BINS : (node + 1) * BINS].T.tobytes()

    def search(key: tuple[int, int], total: np.ndarray) -> tuple:
        left = np.cumsum(total.reshape(shape), axis=0)
        right = left[-1] - left
        score = lambda s: (s[..., :classes] ** 2 / (s[..., classes:] + DAMPING)).sum(axis=-1)
        gain = score(left) + score(right) - score(left[-1])
        weight = np.minimum(left[:, classes:].sum(axis=1), right[:, classes:].sum(axis=1))
        gain = np.where(weight >= LEAST_WEIGHT, gain, -1.0)
        best = int(np.argmax(gain))
        return (*key, best, float(gain[best]), left[best], right[best])

    best: dict[int, tuple] = {}
    # Ties go to the first feature, so that a rerun grows the same tree.
    for found in sorted(grouped_sums(drawn, sums, search, np.float64, width * len(columns)), key=lambda s: s[:2]):
        if found[0] not in best or found[3] > best[found[0]][3]:
            best[found[0]] = found
    return list(best.values())


def fit_boosted(
    train: DataFrame,
    features: Column,
    label_index: Column,
    classes: int,
    columns: Sequence[str],
    *,
    rounds: int = 250,
    depth: int = 6,
    step: float = 0.1,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
    folder: str | None = None,
) -> BoostedModel:
    """Boosts ``rounds`` trees over ``features`` (an array of doubles) towards ``label_index`` (from 0).

    Rows without a label are left out. ``columns`` names the features. Needs at
    least one row. Subsamples are drawn by a hash of the row and the round.
    """
    spark = train.sparkSession
    width = len(columns)
    rows = train.select(features.alias("features"), label_index.cast("int").alias("y")).where("y IS NOT NULL")
    edges = bin_edges(rows, width, BINS)
    counts = dict(rows.groupBy("y").count().collect())
    total = sum(counts.values())
    model = BoostedModel(edges, [float(np.log(max(counts.get(k, 0), 1e-6) / total)) for k in range(classes)])

    work = folder or work_folder(spark, "boosting")
    drawn = rows.withColumn("draw", F.xxhash64("features", "y", F.lit(seed)))
    names = ["y", "draw", "bins", "margins", "owner"]
    state = block_rdd(write_and_read(_prepared(drawn, model), f"{work}/state-0"), names, BLOCKS_PER_TASK).persist(StorageLevel.MEMORY_AND_DISK)
    earlier, written = None, ["state-0"]
    rng = np.random.default_rng(seed)
    for number in range(rounds):
        tree = Tree.empty(depth, classes)
        chosen = sorted(rng.permutation(width)[: max(1, round(column_share * width))].tolist())
        drawn_rows = _drawn(state, number, row_share, width, classes).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(depth):
            splits = _best_splits(drawn_rows, tree, level, chosen, width)
            if earlier is not None:
                # This round's state has been made of it by now.
                earlier.unpersist()
                earlier = None
            for node, feature, last, gain, *sides in splits:
                if gain > 1e-9:
                    tree.feature[node], tree.bin[node], tree.gain[node] = feature, last, gain
                    for child, side in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                        g, h = np.split(side, 2)
                        tree.value[child] = -step * g / (h + DAMPING)
            if not any(s[3] > 1e-9 for s in splits):
                break
        drawn_rows.unpersist()
        model.trees.append(tree)
        if number + 1 == rounds:
            break
        earlier, state = state, _added(state, tree, width)
        if (number + 1) % WRITE_EVERY == 0:
            table = spark.createDataFrame(state, _STATE)
            state = block_rdd(write_and_read(table, f"{work}/state-{number + 1}"), names, BLOCKS_PER_TASK)
            written.append(f"state-{number + 1}")
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if len(written) > 2:
            remove_path(spark, f"{work}/{written.pop(0)}")
    for held in (earlier, state):
        if held is not None:
            held.unpersist()
    return model


def losses_by_round(
    rows: DataFrame, model: BoostedModel, features: Column, label_index: Column, width: int, part: Column
) -> DataFrame:
    """(part, round, log_loss, n): the mean loss after each number of trees, from one pass over the rows.

    Round 0 is the loss of the class shares alone. Rows without a label are left out.
    """
    known = rows.select(features.alias("features"), label_index.cast("int").alias("y"), part.alias("part")).where("y IS NOT NULL AND features IS NOT NULL")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            y = batch.column("y").to_numpy()
            names = np.array(batch.column("part").to_pylist(), object)
            for name in set(names.tolist()):
                mine = np.flatnonzero(names == name)
                at = np.arange(len(mine))
                x = matrix(batch.column("features").take(pa.array(mine)), width)
                sums = [-np.log(np.maximum(softmax(m)[at, y[mine]], 1e-15)).sum() for m in model.margins(x)]
                held[name] = held.get(name, 0) + np.array([[s, len(mine)] for s in sums])
        for name, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(sums), pa.string()), pa.array(np.arange(len(sums))), pa.array(sums[:, 0]), pa.array(sums[:, 1].astype(np.int64))],
                ["part", "round", "loss", "n"],
            )

    sums = known.mapInArrow(measure, "part string, round bigint, loss double, n bigint")
    return sums.groupBy("part", "round").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n"))
