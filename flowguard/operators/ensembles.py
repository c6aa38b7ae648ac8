"""One binary boosted ensemble per class, all grown together on histograms.

Each ensemble is that of MLlib's ``GBTClassifier``: regression trees on the gradients
of the logistic loss of its class against all others, the first with weight 1, the
others with the step. A level of one round's trees of all classes is one pass over
blocks of binned rows (see ``trees``): tasks sum rows and gradients per class, node,
feature and bin, the sums meet per class and node, and only each node's best split
reaches the driver. A round takes the same rows for all classes, drawn anew in every
pass from the seed, the block and the round. Rows of one class in the same bins are one
entry with their number, as in ``forest``; an entry keeps four bytes per class besides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import remove_path, work_folder, write_and_read
from .forest import BINS, COUNTED
from .trees import Tree, bin_edges, binned, block_rdd, grouped_sums, matrix

# Rounds between two written states.
WRITE_EVERY = 20
#: Blocks that a task reads in one pass, about.
BLOCKS_PER_TASK = 32


@dataclass
class EnsemblesModel:
    """Bin edges per feature, where each class's margin starts (None: the class was not seen), and trees.

    A round has one tree per class that was seen, in their order.
    """

    edges: list[list[float]]
    start: list[float | None]
    trees: list[Tree] = field(default_factory=list)

    @property
    def seen(self) -> list[int]:
        return [k for k, s in enumerate(self.start) if s is not None]

    @property
    def stages(self) -> list[list[Tree]]:
        """The trees of each ensemble."""
        n = len(self.seen)
        return [self.trees[i::n] for i in range(n)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """What each ensemble gives its own class, as shares of their sum."""
        if not self.seen:
            raise ZeroDivisionError("the ensembles were trained without any labelled row")
        bins = binned(self.edges, x).T
        each = np.zeros((len(self.start), len(x)))
        for k, trees in zip(self.seen, self.stages, strict=True):
            margin = np.full(len(x), self.start[k])
            for tree in trees:
                margin += tree.value[:, 0].take(tree.nodes(bins))
            with np.errstate(over="ignore"):
                each[k] = 1 / (1 + np.exp(-2 * margin))
        return (each / each.sum(axis=0)).T

    def importances(self) -> np.ndarray:
        """Share of each feature in an ensemble's gain, as the mean of the ensembles."""
        total = np.zeros((len(self.stages), len(self.edges)))
        for own, trees in zip(total, self.stages, strict=True):
            for tree in trees:
                inner = tree.feature >= 0
                np.add.at(own, tree.feature[inner], tree.gain[inner])
            own /= own.sum() or 1.0
        return total.mean(axis=0)


def ensemble_edges(rows: DataFrame, width: int) -> list[list[float]]:
    """Where the bins of each of ``features``'s places end; one with few values has them all as edges.

    Quantiles alone would put a rare value into the bin of the next larger one.
    """
    edges = bin_edges(rows, width, BINS)
    few = [i for i, e in enumerate(edges) if len(e) < BINS - 1]
    if not few:
        return edges

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: np.zeros(0) for i in few}
        for batch in batches:
            x = matrix(batch.column("features"), width)
            # A place that has shown more values than bins keeps some of them, and isn't looked at again.
            for i in [i for i, v in held.items() if len(v) <= BINS]:
                known, mine = held[i], x[:, i]
                new = mine[known.take(np.searchsorted(known, mine), mode="clip") != mine] if len(known) else mine
                if len(new):
                    held[i] = np.unique(np.concatenate([known, new]))[: BINS + 1]
        for i, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], ["place", "value"])

    found: dict[int, set[float]] = {i: set() for i in few}
    # At most BINS + 1 values per task and place.
    for place, value in rows.select("features").mapInArrow(values, "place int, value double").distinct().collect():
        found[place].add(value)
    return [sorted(v for v in found[i] if v == v) if i in found and len(found[i]) <= BINS else e for i, e in enumerate(edges)]


def _taken(block: int, n: np.ndarray, rows: int, number: int, share: float, seed: int) -> np.ndarray:
    """How many of each entry's rows a round takes: a repeatable draw without replacement."""
    if share >= 1:
        return n.astype(np.float64) if len(n) else np.ones(rows)
    generator = np.random.Generator(np.random.SFC64([seed, block, number]))
    return generator.binomial(n, share).astype(np.float64) if len(n) else (generator.random(rows) < share).astype(np.float64)


def _residuals(own: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a round's tree is fitted to: 1 and -1 at first, then the negative gradients of the logistic loss."""
    sign = np.where(own, 1.0, -1.0)
    if margin is None:
        return sign
    with np.errstate(over="ignore"):
        return 4 * sign / (1 + np.exp(2 * sign * margin.astype(np.float64)))


def _margins(data: bytes, classes: int) -> np.ndarray | None:
    return np.frombuffer(data, np.float32).reshape(classes, -1) if data else None


def _best_splits(
    state: RDD, trees: Sequence[tuple[int, Tree]], seen: Sequence[int], number: int, level: int, features: int, share: float, chosen: int, seed: int
) -> list[tuple]:
    """The best split of each open node of a level: place of the ensemble, node, feature, bin, gain, rows and sums of both sides.

    The feature is -1 where no split of the node's ``chosen`` features gains anything.
    """
    first, width = 2**level - 1, 2**level
    paths = [(k, Tree(t.feature, t.bin, t.gain[:0], t.value[:0])) for k, t in trees]

    def sums(held_blocks: Iterable[tuple]) -> Iterator[tuple]:
        held = np.zeros((len(paths), 2, features, width * BINS))
        for block, y, bins, n, margins in held_blocks:
            y, bins, n = np.frombuffer(y, np.int32), np.frombuffer(bins, np.uint8).reshape(features, -1), np.frombuffer(n, np.int64)
            weight, margins = _taken(block, n, len(y), number, share, seed), _margins(margins, len(seen))
            rows = np.flatnonzero(weight)
            y, bins, weight = y.take(rows), bins.take(rows, axis=1), weight.take(rows)
            for i, (k, path) in enumerate(paths):
                at = path.nodes(bins, level) - first
                sum_up = weight * _residuals(y == seen[k], None if margins is None else margins[k].take(rows))
                # Rows whose node wasn't split stay above this level.
                here = np.flatnonzero(at >= 0) if level and at.min(initial=0) < 0 else slice(None)
                at = at[here] * BINS
                for c in range(features):
                    place = at + bins[c][here]
                    held[i, 0, c] += np.bincount(place, weight[here], width * BINS)
                    held[i, 1, c] += np.bincount(place, sum_up[here], width * BINS)
        held = held.reshape(len(paths), 2, features, width, BINS)
        for i, (k, _) in enumerate(paths):
            for node in np.flatnonzero(held[i, 0, 0].any(axis=1)).tolist():
                yield (k, node + first), held[i, :, :, node].tobytes()

    def search(key: tuple[int, int], total: np.ndarray) -> tuple:
        mine = np.sort(np.random.default_rng([seed, number, *key]).permutation(features)[:chosen])
        left = np.cumsum(total.reshape(2, features, BINS)[:, mine], axis=2)
        whole = left[:, 0, -1]
        right = whole[:, None, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
        gain = np.where((left[0] > 0.5) & (right[0] > 0.5), gain, 0.0)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] <= 1e-9 * whole[0]:
            return (*key, -1, 0, 0.0, whole, whole)
        return (*key, int(mine[f]), int(b), float(gain[f, b]), left[:, f, b], right[:, f, b])

    return grouped_sums(state, sums, search, np.float64, len(paths) * width)


def _added(state: RDD, trees: Sequence[Tree], features: int) -> RDD:
    """The state with the values of a round's trees added to the margins."""

    def add(block: tuple) -> tuple:
        bins, margins = np.frombuffer(block[2], np.uint8).reshape(features, -1), _margins(block[4], len(trees))
        added = np.stack([t.value[:, 0].take(t.nodes(bins)) for t in trees])
        return (*block[:4], (added if margins is None else margins + added).astype(np.float32).tobytes())

    return state.map(add)


def fit_ensembles(
    blocks: DataFrame,
    edges: list[list[float]],
    classes: int,
    *,
    rounds: int,
    depth: int,
    step: float,
    row_share: float,
    column_share: float,
    seed: int,
) -> EnsemblesModel:
    """Boosts an ensemble of ``rounds`` trees for each class that occurs in ``blocks``, a written table as ``forest`` prepares it.

    A round takes ``row_share`` of the rows, each node splits on the best of
    ``column_share`` of the features (rounded up).
    """
    spark, width = blocks.sparkSession, len(edges)
    names = ["block", "y", "bins", "n", "margins"]
    state = block_rdd(blocks.withColumn("margins", F.lit(b"")), names, BLOCKS_PER_TASK).persist(StorageLevel.MEMORY_AND_DISK)
    seen = sorted(state.flatMap(lambda block: set(np.frombuffer(block[1], np.int32).tolist())).distinct().collect())
    model = EnsemblesModel(edges, [0.0 if k in seen else None for k in range(classes)])
    chosen = min(width, max(1, int(np.ceil(column_share * width))))
    work, written, earlier = work_folder(spark, "ensembles"), [], None
    for number in range(rounds if seen else 0):
        trees, weight = [Tree.empty(depth, 1) for _ in seen], step if number else 1.0
        for level in range(depth):
            at_once = max(1, COUNTED // (2 * 2**level * width * BINS))
            # An ensemble without a split in the level above has no open node.
            growing = [(k, t) for k, t in enumerate(trees) if not level or (t.feature[(2**level - 1) // 2 : 2**level - 1] >= 0).any()]
            for some in range(0, len(growing), at_once):
                for k, node, feature, last, gain, *sides in _best_splits(
                    state, growing[some : some + at_once], seen, number, level, width, row_share, chosen, seed
                ):
                    tree = trees[k]
                    if level == 0:
                        rows, total = sides[0] if feature < 0 else sides[0] + sides[1]
                        tree.value[0] = weight * total / rows
                    if feature >= 0:
                        tree.feature[node], tree.bin[node], tree.gain[node] = feature, last, gain
                        for child, (rows, total) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                            tree.value[child] = weight * total / rows
            if earlier is not None:
                # This round's state has been made of it by now.
                earlier.unpersist()
                earlier = None
        model.trees += trees
        if number + 1 == rounds:
            break
        earlier, state = state, _added(state, trees, width)
        if (number + 1) % WRITE_EVERY == 0:
            table = spark.createDataFrame(state, "block bigint, y binary, bins binary, n binary, margins binary")
            written.append(f"{work}/state-{number + 1}")
            state = block_rdd(write_and_read(table, written[-1]), names, BLOCKS_PER_TASK)
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if len(written) > 1:
            remove_path(spark, written.pop(0))
    for held in (earlier, state):
        if held is not None:
            held.unpersist()
    remove_path(spark, work)
    return model
