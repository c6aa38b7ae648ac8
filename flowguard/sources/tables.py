"""Flow tables in files."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .paths import first_line, path_exists, write_and_read

# Header lines that are read at the same time.
HEADERS_AT_ONCE = 16


def flow_schema(feature_columns: Sequence[str], label: str | None = None) -> T.StructType:
    """Doubles in model order, and the label where there is one."""
    fields = [T.StructField(c, T.DoubleType()) for c in feature_columns]
    if label:
        fields.append(T.StructField(label, T.StringType()))
    return T.StructType(fields)


def plain_name(name: str) -> str:
    """Published flow files have blanks around names and dots in them; Spark reads a dot as a path."""
    return name.strip().replace(".", "_")


def read_labelled_flows(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, file_format: str = "csv"
) -> DataFrame:
    """Labelled flows from CSV with a header, or from another format, under plain names.

    Without a schema, CSV types are discovered in an extra pass over the text.
    With one, its columns are looked up by name in each file's header and come
    out in its order, whatever the files' orders.
    """
    if file_format == "csv":
        groups = _files_by_header(spark, path)
    else:
        groups = {None: [path]}
    parts = [_read_alike(spark, files, header, schema, file_format) for header, files in groups.items()]
    if not parts:
        raise ValueError(f"{path} has no file with a header")
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


def _files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by their header line.

    Only the first block of each file is read, several at a time, and no Spark
    job is run for it, however many files there are.
    """
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPool(HEADERS_AT_ONCE) as pool:
        lines = pool.map(lambda f: first_line(spark, f), files)
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, file in zip(lines, files, strict=True):
        if line:  # an empty file has none
            groups.setdefault(header_names(line), []).append(file)
    return groups


def header_names(line: str) -> tuple[str, ...]:
    """The column names of a header line, made unique as Spark does it: empty and repeated ones get their place."""
    fields = next(csv.reader([line], escapechar="\\", doublequote=False))
    seen = [f.lower() for f in fields]
    return tuple(f"_c{i}" if not f else f"{f}{i}" if seen.count(f.lower()) > 1 else f for i, f in enumerate(fields))


def _read_alike(
    spark: SparkSession, files: list[str], header: tuple[str, ...] | None, schema: T.StructType | None, file_format: str
) -> DataFrame:
    """Files of one header, under plain names."""
    reader = spark.read.format(file_format)
    if header is not None:
        reader = reader.option("header", True)
    if header is not None and schema is not None:
        types = {f.name: f.dataType for f in schema.fields}
        reader = reader.schema(T.StructType([T.StructField(h, types.get(plain_name(h), T.StringType())) for h in header]))
    elif header is not None:
        # Types are discovered over the whole text of all the files of this header, in one pass.
        reader = reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(files)
    df = df.toDF(*[plain_name(c) for c in df.columns])
    return df if schema is None else df.select(*schema.names)


def read_features(
    spark: SparkSession, path: str, feature_columns: Sequence[str], *, file_format: str = "csv"
) -> DataFrame:
    """Unlabelled features, in the order the model was trained with."""
    return read_labelled_flows(
        spark, path, flow_schema(feature_columns), file_format=file_format
    ).select(*feature_columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_or_extract(
    spark: SparkSession, saved: str | None, extract: Callable[[], DataFrame] | None
) -> DataFrame:
    """The saved table if it was written completely, else extract and save it, else fail."""
    if saved and path_exists(spark, f"{saved}/_SUCCESS"):
        return spark.read.parquet(saved)
    if extract is None:
        raise ValueError("no saved rows and nothing to extract them from")
    return write_and_read(extract(), saved) if saved else extract()
