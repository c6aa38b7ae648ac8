"""Quality rules: text statistics, fixed limits, and an isolation forest over the statistics.

The forest isolates a document by random splits of its statistics: anomalous
ones are separated after few splits. It is grown on a bounded sample of labelled
rows, and labelled rows set the path length below which a document goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"

WINDOW = 3
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[!?]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "mean_word", "short_share", "symbol_share", "capital_share", "mark_share", "dup_line_share", "repeat_share",
    "digit_share",
)
#: Of these, only what exceeds the share that good texts reach counts: see ``excess``.
EXCESSES = ("dup_line_share", "repeat_share", "digit_share")
SHORT = 3


def repeated_words(words: list[str]) -> int:
    """Words inside windows of three that occur twice or more, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    # Two steps keep the keys exact for any number of distinct words.
    _, pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[again + k] = True
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The COUNTS and the FEATURES of a whole text."""
    words = [w for w in _SPACES.split(text) if w]
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line and _SPACES.fullmatch(line) is None:
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    per = lambda k, of: k / of if of else 0.0
    features = [
        per(chars, n),
        per(sum(len(w) <= SHORT for w in words), n),
        per(symbols, chars),
        per(sum(map(str.isupper, text)), chars),
        per(len(_MARK.findall(text)), chars),
        per(dup, lines),
        per(repeated, n),
        per(len(_DIGIT.findall(text)), chars),
    ]
    return [n, chars, symbols, dup, repeated], features


def fails_limits(counts: list[int]) -> bool:
    n, repeated = counts[0], counts[4]
    return n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 in a leaf), split value, first child, path length.

    ``usual`` has, for each of FEATURES, what is subtracted before the trees see it.
    """

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    threshold: float = 0.0
    usual: np.ndarray | None = None

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the splits that isolate each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, child, depth in zip(self.feature, self.value, self.child, self.depth, strict=True):
            at = np.zeros(len(x), np.int32)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                at[inner] = child[here] + (x[rows[inner], feature[here]] >= value[here])
            total += depth[at]
        return total / len(self.feature)


def _unresolved(n: int) -> float:
    """Mean further splits that separate n rows left in a leaf."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def usual_shares(x: np.ndarray, good: np.ndarray, most_lost: float) -> np.ndarray:
    """For the EXCESSES what all but ``most_lost`` of the good rows stay within; 0 for other features."""
    usual = np.zeros(len(FEATURES))
    for name in EXCESSES if good.any() else ():
        usual[FEATURES.index(name)] = np.quantile(x[good, FEATURES.index(name)], 1 - most_lost)
    return usual


def excess(x: np.ndarray, usual: np.ndarray | None) -> np.ndarray:
    """The features as the trees see them."""
    return x if usual is None else np.where(usual > 0, np.maximum(x - usual, 0), x)


def grow(x: np.ndarray, *, trees: int = 300, sample: int = 128, seed: int = 42) -> Forest:
    """An isolation forest: each tree splits a random sample by random features at random values.

    The samples are small on purpose: of few rows only a few are bad, so that
    bad rows that resemble each other don't hide one another.
    """
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(sample, 2)))) + 2
    size = 2 * sample + 1
    shape = (trees, size)
    forest = Forest(np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape))
    for t in range(trees):
        rows = x[rng.choice(len(x), min(sample, len(x)), replace=False)]
        todo, used = [(0, rows, 0)], 1
        for node, part, depth in todo:
            low, high = part.min(axis=0), part.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or not len(splittable):
                forest.depth[t, node] = depth + _unresolved(len(part))
                continue
            f = int(rng.choice(splittable))
            value = rng.uniform(low[f], high[f])
            right = part[:, f] >= value
            if right.all() or not right.any():
                forest.depth[t, node] = depth + _unresolved(len(part))
                continue
            forest.feature[t, node], forest.value[t, node], forest.child[t, node] = f, value, used
            todo += [(used, part[~right], depth + 1), (used + 1, part[right], depth + 1)]
            used += 2
    return forest


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, most_lost: float) -> Forest:
    """Sets the path length below which a document goes.

    Of the thresholds that lose at most ``most_lost`` of the good rows, the one
    with the largest share of bad rows found less the share of good rows lost;
    without bad rows nothing goes.
    """
    paths = forest.path_lengths(x)
    if good.all() or not good.any():
        forest.threshold = 0.0
        return forest
    cuts = np.unique(paths)
    lost = np.searchsorted(np.sort(paths[good]), cuts) / good.sum()
    found = np.searchsorted(np.sort(paths[~good]), cuts) / (~good).sum()
    best = np.argmax(np.where(lost <= most_lost, found - lost, -1.0))
    # Halfway to the next lower path, so that equal paths fall on one side.
    forest.threshold = float(cuts[best] if best == 0 else (cuts[best] + cuts[best - 1]) / 2)
    return forest


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 6_000,
    bad_share: float = 0.03,
    most_lost: float = 0.005,
    seed: int = 42,
) -> Forest | None:
    """A calibrated forest from at most ``sample_rows`` labelled rows, those with the smallest hash of the id.

    Rows that the fixed limits reject anyway are left out. Bad rows are thinned
    to ``bad_share`` of what the trees are grown on, as anomalies are to be
    rare there; all of them calibrate. None if no labelled row is left.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    chosen = (
        known.select(F.col(id_col).alias("id"), (F.col(label) == 1).alias("good"))
        .orderBy(F.xxhash64("id", F.lit(seed)), "id", "good").limit(sample_rows)
    )
    # Bounded by sample_rows, so that broadcasting it is safe at any size of the input.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t.as_py() or "") for t in batch.column("text")]
            out = [(f, g.as_py()) for (c, f), g in zip(got, batch.column("good"), strict=True) if not fails_limits(c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in out], pa.list_(pa.float64())), pa.array([g for _, g in out], pa.bool_())],
                ["x", "good"],
            )

    # Repeated ids could give more rows than were chosen.
    sample = rows.mapInArrow(measure, "x array<double>, good boolean").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None
    found = sorted(zip(sample.column("x").to_pylist(), sample.column("good").to_pylist(), strict=True))
    x, good = np.array([f for f, _ in found]), np.array([g for _, g in found])
    rng = np.random.default_rng(seed)
    bad = np.flatnonzero(~good)
    most = int(good.sum() * bad_share / (1 - bad_share))
    usual = usual_shares(x, good, most_lost)
    x = excess(x, usual)
    grown = np.concatenate([x[good], x[rng.permutation(bad)[:most]]]) if good.any() else x
    forest = calibrate(grow(grown, seed=seed), x, good, most_lost)
    forest.usual = usual
    return forest


def judge(texts: list[str], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its COUNTS, base_failed, path length (0 without a forest) and kept."""
    got = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
    failed = np.array([fails_limits(c) for c, _ in got], bool)
    if forest is None:
        return counts, failed, np.zeros(len(got)), ~failed
    paths = forest.path_lengths(excess(np.array([f for _, f in got]).reshape(-1, len(FEATURES)), forest.usual))
    return counts, failed, paths, ~failed & (paths >= forest.threshold)


def score(docs: DataFrame, forest: Forest | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, the COUNTS, base_failed, kept and path_length.

    NULL texts have no words and fail the limits, as do empty ones. NULL and
    repeated ids are passed on; an empty table gives no rows; other columns are
    ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    names = ["id", *COUNTS, "base_failed", "kept", "path_length"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, paths, kept = judge([t.as_py() or "" for t in batch.column("text")], forest)
            columns = [pa.array(c) for c in (*counts.T, failed, kept, paths)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    out = narrow.mapInArrow(each, f"{schema}, base_failed boolean, kept boolean, path_length double")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, forest: Forest | None, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the limits and the forest, with all their columns.

    NULL and empty texts fail the limits and go. Repeated rows are judged alike,
    ids are not looked at, and an empty table stays empty.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = judge([t.as_py() or "" for t in batch.column(text)], forest)[3]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
