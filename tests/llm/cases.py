"""Shared fixtures: random small tables with the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("size", T.StringType()), T.StructField("fp", T.DoubleType()), T.StructField("_key", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("line", T.LongType()), T.StructField("h1", T.StringType()),
])


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 1.5, "k", 7, None, None)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(seed=1, n=60):
    """NULL ids and texts, empty and long texts, ties, repeated rows, copies."""
    r = random.Random(seed)
    words = ["ab", "cd", "efg", "h", "ïjk", "lmno", "p q", "r\ts"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]
    texts = [t.replace("h ab", "h\nab") for t in texts]
    rows = [row(i, t, r.choice(["a", "b", "é", None, ""])) for i, t in enumerate(texts)]
    rows += [row(1000 + i, texts[i]) for i in range(8)]
    rows += [row(3, texts[3]), row(3, texts[3]), row(4, "another text under the id of four"), row(None, texts[5])]
    rows += [row(2000, None, None), row(2001, ""), row(2002, " \t\n "), row(None, None, None), row(2003, "w " * 30_000)]
    return rows
