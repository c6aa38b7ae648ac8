"""The corpus pipeline: five stages from raw documents to packed batches.

Each stage works on all rows its predecessor kept, and all but the last return
the columns of documents, whatever further columns there are and whatever their
names. An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowguard.llm import lines, mixing, packing, quality, simhash
from flowguard.llm.texts import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or the calibrated forest go.

    NULL and empty texts fail the limits. Rows are judged by their text alone:
    repeated rows share a verdict, and ids may be NULL. Without labels of any of
    the documents only the limits decide.
    """
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, forest)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or differ from it by one character, go; documents stay.

    Earlier is what has a smaller id (NULL ids last), then a smaller text hash,
    then stands further up. Rows equal in id and text keep the same lines. A
    text that loses nothing is unchanged, NULL included; one that loses all its
    lines becomes empty. A text of any length is one line if it has no line end.
    """
    return lines.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Of rows that share it, one stays: that with the smallest text hash. NULL
    ids come last. NULL and empty texts, and those without words, have the
    fingerprint zero and form a group like any other.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for.

    A NULL source is a source, weighed last. Documents without words (NULL and
    empty texts among them) are not taken. Rows equal in id and text come from
    the first of them, as often as all of them are taken; NULL ids are ids.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence: where it starts in its document, its bucket, batch and slot.

    Long documents give several sequences, repeated rows are packed as often as
    they occur, and NULL ids are passed on. Documents without words give one
    row of length 0 in no batch (NULLs).
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


#: The forest, the components and the seeded choices are beyond SQL; tests check each stage by brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
