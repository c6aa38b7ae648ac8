"""What the tree ensembles share: trees over binned features, rows in blocks, sums by key.

Training reads its rows many times. They are binned once and kept in blocks, one
row of bytes per some ten thousand training rows, so that a pass costs arithmetic
over arrays and not a conversion of each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

#: Rows of a block: its arrays stay in a core's cache.
BLOCK_ROWS = 1 << 15
#: Levels at a tree's top whose nodes are numbered in one byte.
TOP_LEVELS = 5


@dataclass
class Tree:
    """Nodes in heap order (children 2i + 1 and 2i + 2): split feature (-1 in a leaf), last bin of the left side, gain, values."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, classes: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros((n, classes)))

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row of ``bins`` (features, rows) has reached, after all levels or so many.

        The top levels compare whole features with each of their nodes and choose
        among the few numbers by bits; below, rows look up their own nodes.
        """
        levels = int(np.log2(len(self.feature) + 1)) - 1 if levels is None else levels
        inner, n = self.feature >= 0, bins.shape[1]
        own = np.arange(len(self.feature))
        # A leaf goes on to itself: no bin lies beyond 255.
        left, last = np.where(inner, 2 * own + 1, own), np.where(inner, self.bin, 255).astype(np.uint8)
        feature = np.maximum(self.feature, 0).astype(np.intp)
        top = min(levels, TOP_LEVELS)
        ends = own[:1]
        for _ in range(top):
            ends = np.stack([left.take(ends), left.take(ends) + inner.take(ends)], axis=1).reshape(-1)
        found = np.broadcast_to(ends.astype(np.uint8)[:, None], (len(ends), n))
        for level in reversed(range(top)):
            here = slice(2**level - 1, 2 ** (level + 1) - 1)
            right = np.negative((bins.take(feature[here], axis=0) > last[here, None]).view(np.uint8))
            right &= found[0::2] ^ found[1::2]
            right ^= found[0::2]
            found = right
        at = found[0].astype(np.intp)
        if levels > top:
            flat, rows, starts = np.ascontiguousarray(bins).reshape(-1), np.arange(n), feature * n
            for _ in range(levels - top):
                right = flat.take(starts.take(at) + rows) > last.take(at)
                at = left.take(at) + right
        return at


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array<double> column without NULL rows; NULL cells are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Where the bins of each of ``features``'s places end, by a sketch over all rows."""
    named = rows.select(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(width)])
    found = quantiles(named, named.columns, [i / bins for i in range(1, bins)], exact=False)
    return [sorted({v for v in found[c] if v is not None and v == v}) for c in named.columns]


def binned(edges: Sequence[Sequence[float]], x: np.ndarray) -> np.ndarray:
    """Bins of feature rows; missing values are in the last bin. Each feature's lie together in memory."""
    bins = np.empty((len(edges), len(x)), np.uint8)
    for i, e in enumerate(edges):
        bins[i] = np.searchsorted(e, x[:, i], "left")
    return bins.T


def byte_rows(bins: np.ndarray) -> pa.Array:
    """Rows of bins as a binary column."""
    n, width = bins.shape
    ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(bins))])


def blocks(batches: Iterable[pa.RecordBatch], size: int | None = None) -> Iterator[pa.Table]:
    """A task's rows in tables of at most ``size`` rows."""
    size, held, n = size or BLOCK_ROWS, [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def block_rdd(table: DataFrame, names: Sequence[str], at_most: int) -> RDD:
    """The blocks of a written table as tuples, dealt to partitions of about ``at_most`` blocks, as many for each core.

    A pass costs a task's start, and its sums' way, per partition, so small tables aren't cut further.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-table.count() // (cores * at_most)))
    spread = table if table.rdd.getNumPartitions() >= parts else table.repartition(parts)
    return spread.select(*names).rdd.map(lambda row: tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))


def grouped_sums(
    state: RDD, sums: Callable[[Iterable[tuple]], Iterator[tuple]], search: Callable[[Any, np.ndarray], Any], dtype: type, keys: int
) -> list:
    """``search(key, sum)`` for each key of the packed arrays that ``sums`` gives per task, on the driver.

    There are at most about ``keys`` keys, and what ``search`` returns is small.
    """
    parts = max(1, min(keys, state.ctx.defaultParallelism))

    def meet(pairs: Iterable[tuple[Any, bytes]]) -> Iterator[Any]:
        total: dict[Any, np.ndarray] = {}
        for key, data in pairs:
            values = np.frombuffer(data, dtype).astype(np.float64)
            total[key] = total[key] + values if key in total else values
        for key, values in total.items():
            yield search(key, values)

    return state.mapPartitions(sums).partitionBy(parts).mapPartitions(meet).collect()


def ensemble_probabilities(model: Any, features: Column, width: int) -> Column:
    """An array of class probabilities, NULL where the features are missing."""

    @F.arrow_udf("array<double>")
    def probabilities(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        if not known.any():
            return pa.nulls(len(column), pa.list_(pa.float64()))
        found = model.probabilities(matrix(column.drop_null(), width))
        ends = np.concatenate([[0], np.cumsum(known)]) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.reshape(-1)), mask=pa.array(~known))

    return probabilities(features)
