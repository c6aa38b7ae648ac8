"""Expressions over a class-probability array whose order is a given class list.

They use array built-ins with generated code, and stay short however many
classes there are: rules built on them are copied into filters, and a filter
method that grows too long is no longer compiled by the JVM. ``get`` is used
because an optimised plan may evaluate them on rows that a filter is about to
drop, and plain indexing raises there when the array is too short.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two class names that are not attacks.
BENIGN = "BENIGN"
DOUBT = "DOUBT"


def attack_classes(classes: Sequence[str]) -> list[str]:
    return [c for c in classes if c not in (BENIGN, DOUBT)]


def class_probability(probability: Column, classes: Sequence[str], name: str) -> Column:
    if name not in classes:
        return F.lit(0.0)
    return F.get(probability, F.lit(list(classes).index(name)))


def max_confidence(probability: Column) -> Column:
    return F.array_max(probability)


def predicted_class(probability: Column, classes: Sequence[str]) -> Column:
    """Class of the largest probability; the first class wins a tie."""
    first = F.array_position(probability, F.array_max(probability)).cast("int")
    return F.get(F.array(*[F.lit(c) for c in classes]), first - 1)


def attack_probability(probability: Column, classes: Sequence[str]) -> Column:
    parts = [class_probability(probability, classes, c) for c in attack_classes(classes)]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)
