"""Rolling sequences as keyed streaming state.

One key's rows of one micro-batch are ordered in one task, in bounded memory:
chunks are sorted as they arrive, kept in the state store, and merged block by
block. For a device that dominates the stream, ``cascade.start_cascade`` spreads
its rows over slices instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import SEQUENCE_LENGTH

# Rows of a sorted run that are loaded at once, and runs that are merged at once.
BLOCK = 256
FAN = 32

_VECTORS = T.ArrayType(T.ArrayType(T.DoubleType()))


def _up_to(rows: pd.DataFrame, bound: tuple, order_by: list[str]) -> np.ndarray:
    """Which rows are not behind ``bound`` in the order."""
    less, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
    for column, limit in zip(order_by, bound, strict=True):
        values = rows[column]
        less |= equal & (values < limit).to_numpy()
        equal &= (values == limit).to_numpy()
    return less | equal


class SortedRuns:
    """Chunks of rows as sorted runs in a map state, cut into blocks.

    ``FAN`` runs of a level are merged to one of the next, so that a merge holds
    at most ``FAN`` blocks, however many rows a key has.
    """

    def __init__(self, store: Any, order_by: list[str], block: int = BLOCK, fan: int = FAN) -> None:
        self.store, self.order_by, self.block, self.fan = store, order_by, block, fan
        self.levels: list[list[int]] = [[]]
        self.sizes: dict[int, int] = {}  # blocks of each run

    def add(self, chunk: pd.DataFrame) -> None:
        self._put(0, iter([chunk.sort_values(self.order_by, ignore_index=True)]))

    def _put(self, level: int, parts: Iterator[pd.DataFrame]) -> None:
        run, n = len(self.sizes), 0
        self.sizes[run] = 0
        for part in parts:
            for start in range(0, len(part), self.block):
                table = pa.Table.from_pandas(part.iloc[start : start + self.block], preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                self.store.updateValue((run, n), (sink.getvalue().to_pybytes(),))
                n += 1
        self.sizes[run] = n
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(full))

    def _load(self, run: int, number: int) -> pd.DataFrame | None:
        if number >= self.sizes[run]:
            return None
        data = self.store.getValue((run, number))[0]
        self.store.removeKey((run, number))
        return pa.ipc.open_stream(pa.py_buffer(data)).read_all().to_pandas()

    def _merge(self, runs: list[int]) -> Iterator[pd.DataFrame]:
        at = {run: 0 for run in runs}
        held = {run: self._load(run, 0) for run in runs}
        while held := {r: h for r, h in held.items() if h is not None}:
            # All that may still come lies behind the nearest end of a block.
            bound = min(tuple(h[self.order_by].iloc[-1]) for h in held.values())
            ready = []
            for run, rows in held.items():
                near = _up_to(rows, bound, self.order_by)
                ready.append(rows[near])
                held[run] = rows[~near]
                if near.all():
                    at[run] += 1
                    held[run] = self._load(run, at[run])
            yield pd.concat(ready).sort_values(self.order_by, ignore_index=True)

    def merged(self) -> Iterator[pd.DataFrame]:
        """All rows in order, in parts of at most ``FAN`` blocks a level."""
        return self._merge([run for level in self.levels for run in level])


class _RollingSequences(StatefulProcessor):
    """State per key: its last ``length - 1`` vectors and the number of rows seen."""

    def __init__(self, keys: list[str], order_by: list[str], value: str, length: int) -> None:
        self.keys, self.order_by, self.value, self.length = keys, order_by, value, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType(
            [T.StructField("recent", _VECTORS), T.StructField("seen", T.LongType())]
        )
        self.state = handle.getValueState("recent", schema)
        self.runs = handle.getMapState("runs", "run int, block int", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        recent = [list(v) for v in held[0]] if held else []
        seen = held[1] if held else 0
        for part in self._ordered(rows):
            out, recent = self._sequences(part, recent)
            for name, value in zip(self.keys, key):
                out[name] = value
            out["device_sample_no"] = np.arange(seen + 1, seen + 1 + len(part))
            seen += len(part)
            yield out[[*self.keys, *self.order_by, "device_sample_no", "sequence"]]
        self.state.update((recent, seen))

    def _ordered(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The key's rows in order; a single chunk needs no merging."""
        first, second = next(chunks), next(chunks, None)
        if second is None:
            yield first.sort_values(self.order_by, ignore_index=True)
            return
        runs = SortedRuns(self.runs, self.order_by)
        runs.add(first)
        runs.add(second)
        for chunk in chunks:
            runs.add(chunk)
        yield from runs.merged()
        self.runs.clear()

    def _sequences(self, part: pd.DataFrame, recent: list) -> tuple[pd.DataFrame, list]:
        """The rows with their sequences, and the vectors that the next rows look back to."""
        known = len(recent)
        vectors = np.empty(known + len(part), object)
        vectors[:] = recent + [list(v) for v in part[self.value]]
        own = np.arange(known, len(vectors))[:, None]
        at = own + np.arange(1 - self.length, 1)[None, :]
        out = part[self.order_by].copy()
        # In front of a key's first vector stands the current one.
        out["sequence"] = vectors[np.where(at < 0, own, at)].tolist()
        return out, vectors[max(0, len(vectors) - self.length + 1) :].tolist()

    def close(self) -> None:
        pass


def rolling_sequence_stream(
    rows: DataFrame,
    *,
    keys: Sequence[str] = ("device_id",),
    order_by: Sequence[str] = ("timestamp",),
    value: str = "vector",
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """Keys, order columns, the key's running sample number and its padded ``sequence``.

    Needs the RocksDB state store provider. Rows are taken in micro-batch order,
    and by ``order_by`` (unique per key, without NULLs) within a micro-batch.
    """
    keys, order_by = list(keys), list(order_by)
    schema = T.StructType(
        [rows.schema[c] for c in (*keys, *order_by)]
        + [T.StructField("device_sample_no", T.LongType()), T.StructField("sequence", _VECTORS)]
    )
    return rows.select(*keys, *order_by, value).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_RollingSequences(keys, order_by, value, length),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
