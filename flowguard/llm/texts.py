"""What the text operators share: fixed patterns, row keys, working tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import work_folder, write_and_read

# A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole(text: str) -> Column:
    """The text column; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words as a long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text: str) -> Column:
    """Orders rows by id, NULL ids last, then by a hash of the text.

    Rows equal in both are repeats of one document: they share the key, and
    every decision taken by key treats them alike.
    """
    return F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.xxhash64(whole(text)).alias("text_hash"),
    )


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Applies ``function`` to each Arrow batch; one batch is in memory at a time."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(each, schema)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table, written once below ``folder`` (else the cluster's shared folder) and reread.

    Later stages read the files, so a lost executor costs no recomputation. The
    folder belongs to the caller; by default it lives as long as
    ``spark.checkpoint.dir`` does.
    """
    path = f"{folder.rstrip('/')}/{name}" if folder else work_folder(df.sparkSession, name)
    return write_and_read(df, path)


def one_per_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_key, _row): each row once by its ``row_key`` as text, all its columns in a struct.

    Repeats meet in the map-side aggregate, and a join by _key finds the rows
    dealt out already. ``select("_row.*")`` gives the columns back whatever
    their names are.
    """
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.to_json(row_key(id_col, text)).alias("_key"), whole_row.alias("_row"))
    return rows.groupBy("_key").agg(F.first("_row").alias("_row"))


def unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns, the same in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))
