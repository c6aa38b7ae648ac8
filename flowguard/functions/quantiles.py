"""Exact linear-interpolation quantiles of many columns that never gather a column in one task.

There is one way for every size. A bounded sketch per column gives ends around
the wanted order statistics; one grouping counts the values between and at the
ends; what lies strictly between two ends is counted exactly, or, if it is still
too much for one task, enclosed again. All columns share each pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import small_table

# Values between two ends that one task may order.
PICKED = 1_000_000


@dataclass
class _Target:
    """The k-th smallest value (from 0) of a column, known to lie strictly in (low, high)."""

    column: str
    k: int
    low: float
    high: float
    below: int  # values <= low
    inside: int  # values strictly between
    value: float | None = None
    bucket: int | None = None

    def within(self) -> Column:
        c = F.col(self.column)
        return F.when((c > F.lit(self.low)) & (c < F.lit(self.high)), c) if self.bucket is not None else c


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    exact: bool = True,
    picked: int = PICKED,
    accuracy: int = 10_000,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, NULLs ignored; an all-NULL column gives ``None``.

    ``df`` is read in several passes: hand in a written table. ``counts`` passes on the numbers of non-NULL values where they are known.
    """
    columns, probabilities = list(columns), list(probabilities)
    if not columns:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if not exact:
        found = data.agg(
            *[F.percentile_approx(c, probabilities, accuracy).alias(c) for c in columns]
        ).first()
        return {c: list(found[c]) if found[c] is not None else [None] * len(probabilities) for c in columns}

    if counts is None:
        counts = data.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    wanted: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probabilities if counts[c] else ():
            at = p * (counts[c] - 1)
            for k in {math.floor(at), math.ceil(at)}:
                wanted[c, k] = _Target(c, k, -math.inf, math.inf, 0, counts[c])
    _find(data, list(wanted.values()), picked, accuracy)

    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in probabilities:
            if not counts[c]:
                result[c].append(None)
                continue
            at = p * (counts[c] - 1)
            k = math.floor(at)
            low, high = wanted[c, k].value, wanted[c, math.ceil(at)].value
            result[c].append(low if low == high else (k + 1 - at) * low + (at - k) * high)
    return result


# Groups whose quantiles are found in one fit.
MOST_GROUPS = 100


def quantiles_by(
    df: DataFrame, group: str, columns: Sequence[str], probabilities: Sequence[float], *, exact: bool = True
) -> dict[object, dict[str, list[float | None]]]:
    """Quantiles of each column within each value of ``group``, in one set of passes.

    Each group's values of a column are a column of their own to ``quantiles``,
    which shares its passes among all of them. Rows without a group are left
    out. Like ``quantiles``, it reads ``df`` several times: hand in a written
    table. More than ``MOST_GROUPS`` groups are refused.
    """
    names = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} values")
    own = {(n, c): f"g{i}_{j}" for i, n in enumerate(sorted(names)) for j, c in enumerate(columns)}
    parts = df.select(*[F.when(F.col(group) == F.lit(n), F.col(c).cast("double")).alias(a) for (n, c), a in own.items()])
    found = quantiles(parts, list(own.values()), probabilities, exact=exact)
    return {n: {c: found[own[n, c]] for c in columns} for n in sorted(names)}


def _find(data: DataFrame, targets: list[_Target], picked: int, accuracy: int) -> None:
    open_ = targets
    while open_:
        ends = _ends(data, open_, accuracy)
        placed = _placed(data, ends)
        before = [t.inside for t in open_]
        _narrow(placed, ends, open_)
        # What a sketch can't part further, such as infinite values, is picked as it is.
        small = [t for t, n in zip(open_, before, strict=True) if t.value is None and (t.inside <= picked or t.inside == n)]
        if small:
            _pick(placed, list(ends), small)
        open_ = [t for t in open_ if t.value is None]


def _ends(data: DataFrame, targets: list[_Target], accuracy: int) -> dict[str, list[float]]:
    """For each column, sorted data values around its targets, from one sketch per enclosure."""
    margin = 2.0 / accuracy
    shared: dict[tuple, list[_Target]] = {}
    for t in targets:
        shared.setdefault((t.column, t.low, t.high), []).append(t)
    groups = list(shared.values())
    sketches = []
    for i, group in enumerate(groups):
        shares = [(t.k - t.below + 0.5) / t.inside + m for t in group for m in (-margin, margin)]
        shares = sorted({min(1.0, max(0.0, v)) for v in shares})
        sketches.append(F.percentile_approx(group[0].within(), shares, accuracy).alias(f"g{i}"))
    row = data.agg(*sketches).first()
    ends: dict[str, set[float]] = {}
    for i, group in enumerate(groups):
        known = {e for e in (group[0].low, group[0].high) if math.isfinite(e)}
        ends.setdefault(group[0].column, set()).update(known, row[f"g{i}"])
    return {c: sorted(e) for c, e in ends.items()}


def _splits(ends: list[float]) -> list[float]:
    """Each end begins a bucket of its own, closed by the next larger double."""
    inner = {x for e in ends for x in (e, math.nextafter(e, math.inf)) if math.isfinite(x)}
    return [-math.inf, *sorted(inner), math.inf]


def _placed(data: DataFrame, ends: dict[str, list[float]]) -> DataFrame:
    """(column number, bucket, value) of every non-NULL value."""
    columns = list(ends)
    cut = Bucketizer(
        splitsArray=[_splits(e) for e in ends.values()], inputCols=columns,
        outputCols=[f"bucket {i}" for i in range(len(columns))], handleInvalid="keep",
    ).transform(data.select(*columns))
    cells = [
        F.struct(F.lit(i).alias("c"), F.col(f"bucket {i}").cast("int").alias("b"), F.col(c).alias("v"))
        for i, c in enumerate(columns)
    ]
    return cut.select(F.inline(F.array(*cells))).where("v IS NOT NULL")


def _narrow(placed: DataFrame, ends: dict[str, list[float]], targets: list[_Target]) -> None:
    """Sets each target's value if it is an end, else the bucket it lies in."""
    # At most two buckets for each wanted statistic and one more for each column.
    counted: dict[int, dict[int, int]] = {}
    for c, b, n in placed.groupBy("c", "b").count().collect():
        counted.setdefault(c, {})[b] = n
    for i, (column, own) in enumerate(ends.items()):
        splits, points = _splits(own), set(own)
        for t in (t for t in targets if t.column == column):
            before = 0
            for b, n in sorted(counted[i].items()):
                if t.k < before + n:
                    break
                before += n
            low = splits[b] if b < len(splits) else math.nan
            if low in points or math.isnan(low):
                t.value = low
            else:
                t.low = math.nextafter(low, -math.inf) if math.isfinite(low) else low
                t.high, t.below, t.inside, t.bucket = splits[b + 1], before, n, b


def _pick(placed: DataFrame, columns: list[str], targets: list[_Target]) -> None:
    """The k-th values inside their buckets, by counting equal values and summing along the order."""
    asked = [
        {"c": columns.index(t.column), "b": t.bucket, "k": t.k - t.below} for t in targets
    ]
    table = small_table(placed.sparkSession, asked, "c int, b int, k long")
    inside = placed.join(F.broadcast(table.select("c", "b").distinct()), ["c", "b"], "left_semi")
    equal = inside.groupBy("c", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = equal.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "b").orderBy("v")))
    hits = upto.join(F.broadcast(table), ["c", "b"]).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
    found = {(r.c, r.b, r.k): r.v for r in hits.select("c", "b", "k", "v").collect()}
    for t, a in zip(targets, asked, strict=True):
        t.value = found[a["c"], a["b"], a["k"]]
