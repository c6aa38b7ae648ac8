"""Attack-label grouping and the label vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attack group -> the raw labels that belong to it. The three web
# attacks occur with an en dash and with the replacement character in its place.
ATTACK_GROUPS = {
    "DoS": ["DoS Hulk", "DoS GoldenEye", "DoS slowloris", "DoS Slowhttptest", "DDoS"],
    "Web Attack": [
        "Web Attack – Brute Force",
        "Web Attack – XSS",
        "Web Attack – Sql Injection",
        "Web Attack � Brute Force",
        "Web Attack � XSS",
        "Web Attack � Sql Injection",
    ],
    "Brute Force": ["FTP-Patator", "SSH-Patator"],
    "Reconnaissance": ["PortScan"],
    "Malware": ["Bot"],
    "Advanced Attack": ["Infiltration", "Heartbleed"],
}


def group_label(label: Column) -> Column:
    """Raw label to its attack group; BENIGN and unknown labels pass through."""
    grouped = label
    branches = None
    for group, raw in ATTACK_GROUPS.items():
        test = label.isin(raw)
        branches = F.when(test, F.lit(group)) if branches is None else branches.when(test, F.lit(group))
    return branches.otherwise(grouped)


def vocabulary(frames: Sequence[DataFrame], label: str = "Label") -> list[str]:
    """Sorted distinct labels over all the frames (byte order)."""
    return [r[0] for r in vocabulary_table(frames, label).orderBy("class_index").select("class").collect()]


def vocabulary_table(frames: Sequence[DataFrame], label: str = "Label") -> DataFrame:
    """(class, class_index), one row per distinct label, indexed alphabetically from 0.

    Each frame is reduced to its distinct labels before the union, so what the
    numbering sees is a handful of rows.
    """
    from pyspark.sql import Window

    parts = [f.select(F.col(label).alias("class")).where(F.col("class").isNotNull()).distinct() for f in frames]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    names = union.distinct()
    index = F.row_number().over(Window.orderBy("class")) - 1
    return names.withColumn("class_index", index.cast("long"))


def encode(label: Column, classes: Sequence[str]) -> Column:
    """Label to its position in the class list; NULL for a label outside it."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(position > 0, (position - 1).cast("long"))


def decode(index: Column, classes: Sequence[str]) -> Column:
    """Position in the class list back to the label; NULL outside it."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))
