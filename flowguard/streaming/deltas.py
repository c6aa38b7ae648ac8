"""State of many keys as tables: one delta per micro-batch, merged from time to time.

A micro-batch writes only the keys it touches, to ``delta/<batch>``, in order of
a hash of the key. After a number of deltas they are merged with the last base
to a new one, ``base/<batch>``, with a folder per hash bucket: looking up a few
keys reads a few folders, and of the deltas the row groups with their buckets. A
retried micro-batch writes its delta anew and reads what was there before it, so
it counts once. A replaced base and its deltas stay until the next merge, for
readers that have listed them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.paths import children, path_exists, remove_path

BUCKETS = 32
MERGE_AFTER = 20
BUCKET = "_bucket"


class DeltaTable:
    """Rows of ``schema`` that ``merge`` reduces to one state per key."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        merge: Callable[[DataFrame], DataFrame],
        *,
        buckets: int = BUCKETS,
        merge_after: int = MERGE_AFTER,
    ) -> None:
        self.spark, self.path, self.keys, self.merge = spark, path, list(keys), merge
        self.schema = schema
        self.buckets, self.merge_after = buckets, merge_after

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self, kind: str) -> list[int]:
        """Micro-batches whose table is complete."""
        names = [int(n) for n in children(self.spark, f"{self.path}/{kind}") if n.isdigit()]
        return sorted(n for n in names if path_exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _parts(self, before: int | None) -> tuple[int | None, list[int]]:
        """The newest base and the deltas behind it, of micro-batches before ``before``."""
        wanted = lambda n: before is None or n < before
        bases = [n for n in self._numbers("base") if wanted(n)]
        base = bases[-1] if bases else None
        return base, [n for n in self._numbers("delta") if wanted(n) and (base is None or n > base)]

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn(BUCKET, self._bucket())

    def append(self, batch: int, rows: DataFrame) -> None:
        """Writes the delta of a micro-batch, in place of an earlier attempt's."""
        placed = self._placed(rows).sortWithinPartitions(BUCKET)
        placed.write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")

    def _read(self, base: int | None, deltas: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        reader = self.spark.read.schema(schema)
        parts = [reader.parquet(f"{self.path}/base/{base}")] if base is not None else []
        parts += [reader.parquet(*[f"{self.path}/delta/{n}" for n in deltas])] if deltas else []
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows written before a micro-batch (or at all), not merged."""
        return self._read(*self._parts(before)).drop(BUCKET)

    def state(self, before: int | None = None) -> DataFrame:
        """One merged state per key, as of before a micro-batch (or now)."""
        return self.merge(self.rows(before))

    def lookup(self, touched: DataFrame, before: int) -> DataFrame:
        """The rows of the touched keys: only their folders are read."""
        wanted = touched.select(*self.keys).distinct()
        # At most one number per bucket.
        places = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        rows = self._read(*self._parts(before)).where(F.col(BUCKET).isin(places) if places else F.lit(False)).drop(BUCKET)
        return rows.join(wanted, self.keys, "left_semi")

    def compact(self, before: int) -> None:
        """Merges base and deltas of the micro-batches before ``before`` once there are enough."""
        base, deltas = self._parts(before)
        if len(deltas) < self.merge_after:
            return
        merged = self._placed(self.merge(self._read(base, deltas).drop(BUCKET)))
        target = f"{self.path}/base/{deltas[-1]}"
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        # What the base before this one had replaced can no longer be asked for.
        if base is not None:
            for kind, old in (("base", lambda n: n < base), ("delta", lambda n: n <= base)):
                for n in filter(old, self._numbers(kind)):
                    remove_path(self.spark, f"{self.path}/{kind}/{n}")
