"""Multiclass random forest on histograms.

All trees grow together, level by level. A level is one pass over blocks of
binned rows (see ``trees``): tasks count classes per tree, node, feature and bin,
the counts meet per tree and node, and only each node's best split reaches the
driver. A row's place in each tree's bootstrap sample is drawn anew in every pass
from the seed, its block and the tree, so a row costs one byte per feature
however many trees there are. Rows of one class in the same bins are one entry with
their number: that sample takes it as often as a Poisson draw of so many rows says.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import remove_path, work_folder, write_and_read
from .trees import Tree, bin_edges, binned, block_rdd, blocks, byte_rows, grouped_sums, matrix

# Bins per feature, as MLlib has them.
BINS = 32
#: Numbers that a task counts into in one pass: trees beyond these wait for the next.
COUNTED = 1 << 23
#: Blocks that a task reads in one pass, about: its counts are as large for one as for all.
BLOCKS_PER_TASK = 64
#: Rows that are scored in all trees at once, and the most split features for which that pays off.
_ROWS_AT_ONCE = 128
_MASKED_FEATURES = 24
#: Draws are 16 bits wide.
_DRAWS = 1 << 16
#: Entries of up to so many rows are drawn by table.
_TABLED = 32
#: Parts that the entries are dealt to: a number of its own, as the draws depend on it.
ENTRY_PARTS = 32


@dataclass
class ForestModel:
    """Bin edges per feature, the class shares of all rows, and trees whose values are class shares."""

    edges: list[list[float]]
    start: list[float]
    trees: list[Tree] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' class shares."""
        bins = binned(self.edges, x).T
        total = np.zeros((len(x), len(self.start)))
        if self._ends is not None:
            for start in range(0, len(x), _ROWS_AT_ONCE):
                total[start : start + _ROWS_AT_ONCE] = self._summed(bins[:, start : start + _ROWS_AT_ONCE])
        else:
            for tree in self.trees:
                total += tree.value.take(tree.nodes(bins), axis=0)
        return total / total.sum(axis=1, keepdims=True)

    @cached_property
    def _ends(self) -> tuple[dict[int, np.ndarray], np.ndarray] | None:
        """For all trees at once: which ends a feature's bin leaves open (a bit each), and the ends' values.

        None where a tree has more ends than bits, or so many features split that a walk is shorter.
        """
        used = sorted({f for t in self.trees for f in t.feature.tolist() if f >= 0})
        sizes = {len(t.feature) for t in self.trees}
        if len(sizes) != 1 or max(sizes) > 127 or len(used) > _MASKED_FEATURES:
            return None
        feature, last = (np.stack([getattr(t, n) for t in self.trees], axis=1) for n in ("feature", "bin"))
        inner, ends = feature >= 0, (max(sizes) + 1) // 2
        bins = np.arange(max(map(len, self.edges)) + 1)[:, None]
        open_ends = {f: np.full((len(bins), len(self.trees)), 2**64 - 1, np.uint64) for f in used}
        reached = np.zeros((1, len(self.trees)), np.intp)
        for i in range(ends - 1):
            level = (i + 1).bit_length() - 1
            under = ends >> (level + 1)
            left = ((1 << under) - 1) << ((i + 1 - 2**level) * 2 * under)
            for f in set(feature[i].tolist()) & open_ends.keys():
                # Beyond a split's last bin, the ends below its left side are closed.
                beyond = (bins > last[i]) & (feature[i] == f)
                open_ends[f] &= np.where(beyond, np.uint64(2**64 - 1 - left), np.uint64(2**64 - 1))
        while len(reached) < ends:
            go = np.take_along_axis(inner, reached, axis=0)
            sides = [np.where(go, 2 * reached + side, reached) for side in (1, 2)]
            reached = np.stack(sides, axis=1).reshape(-1, len(self.trees))
        values = np.stack([t.value for t in self.trees])
        return open_ends, values[np.arange(len(self.trees))[:, None], reached.T].reshape(-1, len(self.start))

    def _summed(self, bins: np.ndarray) -> np.ndarray:
        """The sums of the trees' class shares: a row's end in a tree is the first that all its bins leave open."""
        masks, values = self._ends
        ends = len(values) // len(self.trees)
        left = np.full((bins.shape[1], len(self.trees)), 2**64 - 1, np.uint64)
        for f, mask in masks.items():
            left &= mask.take(bins[f], axis=0)
        left &= ~left + np.uint64(1)
        # A power of two's exponent as a double.
        at = (left.astype(np.float64).view(np.int64) >> 52) - 1023
        at += np.arange(len(self.trees)) * ends
        return values.take(at.T, axis=0).sum(axis=0)

    def importances(self) -> np.ndarray:
        """Share of each feature in a tree's gain (by rows), as the mean of the trees that split."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner], len(self.edges))
            total += own / own.sum() if own.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total


def _times(share: float) -> np.ndarray:
    """How often a bootstrap sample of ``share`` takes a row (Poisson), by a 16-bit draw."""
    upto, chance, n, ends = 0.0, np.exp(-share), 0, []
    while upto + chance < 1 - 0.5 / _DRAWS:
        upto += chance
        ends.append(round(upto * _DRAWS))
        n += 1
        chance *= share / n
    return np.searchsorted(np.array(ends), np.arange(_DRAWS), "right").astype(np.float64)


def entry_blocks(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Blocks of label indexes, bins and numbers of rows, each with a number of its own.

    A block whose rows share their class and bins with less than one other on average
    keeps them one by one, and no numbers.
    """
    width = len(edges)

    def bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = byte_rows(binned(edges, matrix(batch.column("features"), width)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), bins], ["y", "bins"])

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            y, n = table.column("y").to_numpy().astype(np.int32), table.column("n").to_numpy()
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            if n.sum() < 2 * len(n):
                y, bins, n = y.repeat(n), bins.repeat(n, axis=0), n[:0]
            else:
                order = np.argsort(n, kind="stable")
                y, bins, n = y[order], bins[order], n[order]
            parts = [y.tobytes(), bins.T.tobytes(), n.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["y", "bins", "n"])

    entries = rows.mapInArrow(bin_rows, "y int, bins binary").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))
    placed = entries.repartition(ENTRY_PARTS, "bins", "y").sortWithinPartitions("bins", "y")
    return placed.mapInArrow(prepare, "y binary, bins binary, n binary").withColumn("block", F.monotonically_increasing_id())


def _runs(n: np.ndarray) -> list[tuple[int, int, int]]:
    """Where the entries of 1, 2, ... rows begin and end, up to those that are drawn by table."""
    values, starts = np.unique(n, return_index=True)
    ends = np.append(starts[1:], len(n))[: len(starts)]
    return [(v, a, b) for v, a, b in zip(values.tolist(), starts.tolist(), ends.tolist(), strict=True) if v <= _TABLED]


def _drawn_times(generator: np.random.SFC64, draws: np.ndarray, n: np.ndarray, runs: list[tuple], tables: dict[int, np.ndarray], share: float) -> np.ndarray:
    """How often a bootstrap sample takes the rows of each entry: the sum of as many draws as the entry has rows."""
    times, end = np.zeros(len(n)), 0
    for rows, start, end in runs:
        times[start:end] = tables[rows].take(draws[start:end])
    if end < len(n):
        times[end:] = np.random.Generator(generator).poisson(share * n[end:])
    return times


def _grown(state: RDD, trees: Sequence[tuple[int, Tree]], level: int, features: int, classes: int, share: float, chosen: int, seed: int) -> list[tuple]:
    """The best split of each open node of a level: tree, node, feature, bin, gain by rows, class counts of both sides.

    The feature is -1 where no split of the node's ``chosen`` features gains anything.
    """
    first, width = 2**level - 1, 2**level
    cells = BINS * classes
    paths = [(number, Tree(t.feature, t.bin, t.gain[:0], t.value[:0])) for number, t in trees]
    opened = {}
    for number, t in trees:
        above = (np.arange(first, first + width) - 1) // 2
        opened[number] = t.feature[above] >= 0 if level else np.ones(1, bool)
    times = _times(share)
    # The least draw that takes a row.
    least = int(np.count_nonzero(times == 0))

    def sums(held_blocks: Iterable[tuple]) -> Iterator[tuple]:
        counts = np.zeros((len(paths), features, width * cells))
        tables: dict[int, np.ndarray] = {}
        for block, y, bins, n in held_blocks:
            y, bins, n = np.frombuffer(y, np.int32), np.frombuffer(bins, np.uint8).reshape(features, -1), np.frombuffer(n, np.int64)
            runs = _runs(n)
            for size in {v for v, _, _ in runs} - tables.keys():
                tables[size] = _times(share * size).astype(np.uint8)
            cell = [b.astype(np.intp) * classes + y for b in bins]
            for i, (number, path) in enumerate(paths):
                if not opened[number].any():
                    continue
                generator = np.random.SFC64([seed, block, number])
                draws = generator.random_raw((len(y) + 3) // 4).view(np.uint16)[: len(y)]
                if len(n):
                    drawn = _drawn_times(generator, draws, n, runs, tables, share)
                    rows = np.flatnonzero(drawn)
                else:
                    drawn, rows = None, np.flatnonzero(draws >= least)
                if level:
                    at = path.nodes(bins, level).take(rows) - first
                    # Rows whose node wasn't split stay above this level.
                    if not opened[number].all():
                        here = at >= 0
                        rows, at = rows[here], at[here]
                    at *= cells
                else:
                    at = 0
                weight = times.take(draws.take(rows)) if drawn is None else drawn.take(rows)
                for c in range(features):
                    counts[i, c] += np.bincount(cell[c].take(rows) + at, weight, width * cells)
        counts = counts.reshape(len(paths), features, width, cells)
        for i, (number, _) in enumerate(paths):
            for node in np.flatnonzero(counts[i, 0].any(axis=1)).tolist():
                yield (number, node + first), counts[i, :, node].astype(np.float64).tobytes()

    def search(key: tuple[int, int], total: np.ndarray) -> tuple:
        total = total.reshape(features, BINS, classes)
        mine = np.sort(np.random.default_rng([seed, *key]).permutation(features)[:chosen])
        left = np.cumsum(total[mine], axis=1)
        whole = left[0, -1]
        right = whole - left
        n, m = left.sum(axis=2), right.sum(axis=2)
        # Rows times Gini impurity are rows less the squares of the counts over the rows.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(axis=2) / n + (right**2).sum(axis=2) / m - (whole**2).sum() / whole.sum()
        gain = np.where((n > 0) & (m > 0), gain, 0.0)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] <= 1e-9 * whole.sum():
            return (*key, -1, 0, 0.0, whole, whole)
        return (*key, int(mine[f]), int(b), float(gain[f, b]), left[f, b], right[f, b])

    return grouped_sums(state, sums, search, np.float64, len(paths) * width)


def fit_forest(
    train: DataFrame,
    features: Column,
    label_index: Column,
    classes: int,
    columns: Sequence[str],
    *,
    trees: int = 250,
    depth: int = 6,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
    folder: str | None = None,
) -> ForestModel:
    """Grows ``trees`` trees over ``features`` (an array of doubles) towards ``label_index`` (from 0).

    Each tree is grown on a bootstrap sample of ``row_share`` of the rows, each
    node splits on the best of ``column_share`` of the features (both rounded up
    to one at least). Rows without a label are left out; missing features lie
    behind all others. Needs at least one row.
    """
    spark, width = train.sparkSession, len(columns)
    rows = train.select(features.alias("features"), label_index.cast("int").alias("y")).where("y IS NOT NULL")
    edges = bin_edges(rows, width, BINS)
    counts = dict(rows.groupBy("y").count().collect())
    total = sum(counts.values())
    model = ForestModel(edges, [counts.get(k, 0) / total for k in range(classes)], [Tree.empty(depth, classes) for _ in range(trees)])
    for tree in model.trees:
        tree.value[0] = model.start
    chosen = max(1, int(np.ceil(column_share * width)))

    path = f"{folder or work_folder(spark, 'forest')}/blocks"
    state = block_rdd(write_and_read(entry_blocks(rows, edges), path), ["block", "y", "bins", "n"], BLOCKS_PER_TASK).persist(StorageLevel.MEMORY_AND_DISK)
    numbered = list(enumerate(model.trees))
    for level in range(depth):
        at_once = max(1, COUNTED // (2**level * width * BINS * classes))
        found = []
        for start in range(0, trees, at_once):
            found += _grown(state, numbered[start : start + at_once], level, width, classes, row_share, chosen, seed)
        for number, node, feature, last, gain, *sides in found:
            tree = model.trees[number]
            if level == 0:
                tree.value[0] = sides[0] / sides[0].sum() if feature < 0 else sum(sides) / sum(sides).sum()
            if feature >= 0:
                tree.feature[node], tree.bin[node], tree.gain[node] = feature, last, gain
                for child, side in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                    tree.value[child] = side / side.sum()
        if all(f[2] < 0 for f in found):
            break
    state.unpersist()
    remove_path(spark, path)
    return model
