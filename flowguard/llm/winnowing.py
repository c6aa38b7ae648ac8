"""Benchmark decontamination by winnowing.

Every text is a sequence of words. All k-grams of words are hashed, and of each
window of consecutive k-grams the smallest hash (the rightmost of equal ones) is
kept as the window's fingerprint. With ``span`` words in a window, equal windows
have equal fingerprints, so two texts that share ``span`` words or more share at
least one: fingerprints that only one side has are dropped early, and what is
left is extended by comparing the windows around it word by word.

Documents are read once, in blocks of a fixed number of bytes. What leaves that
pass are the fingerprints that a fixed-size bit table of the benchmark's lets
through, each with the few words that its windows cover. Everything after it is
joins of those on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .texts import map_batches, whole, written

# Words of a window: every shared span of so many words is found.
SPAN = 10
# Words of a hashed gram; a window of fewer words is one gram.
GRAM = 5
# Bytes that are hashed at once.
BLOCK = 1 << 20
# Bits of the table per fingerprint of the benchmark, and at most in all (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27

_BASE = 0x9E3779B97F4A7C15
_RUN = pa.struct([("span", pa.int32()), ("fp", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))])
_RUN_SQL = "array<struct<span: int, fp: bigint, start: bigint, words: array<string>>>"


def _table() -> np.ndarray:
    """Bytes of words in lower case; 0 for all other bytes."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


_LOWER = _table()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the differences of 64-bit numbers over all their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words in reading order: their bytes in the buffer, a hash, their text's number."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, part: slice) -> Words:
        return Words(self.start[part], self.end[part], self.hash[part], self.text[part])

    def __add__(self, other: Words) -> Words:
        pairs = zip(vars(self).values(), vars(other).values(), strict=True)
        return Words(*[np.concatenate(p) for p in pairs])


def read_words(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> Iterator[Words]:
    """The words of texts that lie one behind the other, block by block.

    ``offsets`` has each text's first byte and the end of the last. A block ends
    between words, so a word is never cut, however long it is.
    """
    at, stop = int(offsets[0]), int(offsets[-1])
    powers = _powers(_BASE, block + 1)
    inverse = _powers(pow(_BASE, -1, 1 << 64), block + 1)
    while at < stop:
        end = min(at + block, stop)
        while end < stop and _LOWER[data[end]] and _LOWER[data[end - 1]]:
            blank = np.flatnonzero(_LOWER[data[end : min(end + block, stop)]] == 0)
            end = end + int(blank[0]) if len(blank) else min(end + block, stop)
        low = _LOWER[data[at:end]]
        if len(low) > len(powers):
            powers = _powers(_BASE, len(low))
            inverse = _powers(pow(_BASE, -1, 1 << 64), len(low))
        fresh = np.zeros(len(low) + 1, bool)  # a text's first byte starts a word anew
        fresh[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        inside = low > 0
        before = np.concatenate([[False], inside[:-1]])
        start = np.flatnonzero(inside & (~before | fresh[:-1]))
        if len(start):
            after = np.concatenate([inside[1:], [False]])
            stops = np.flatnonzero(inside & (~after | fresh[1:])) + 1
            sums = np.add.reduceat(low * powers[: len(low)], start) * inverse[start]
            texts = np.searchsorted(offsets, start + at, "right") - 1
            yield Words(start + at, stops + at, _mixed(sums ^ (stops - start).astype(np.uint64)), texts)
        at = end


def _choose(words: Words, span: int, gram: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's first word, fingerprint's first word, fingerprint) of the windows that end at word ``first`` or later."""
    gram = min(gram, span)
    n = len(words) - span + 1
    low = max(0, first - span + 1)
    if n <= low:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(_BASE) + words.hash[k : k + len(grams)]
    grams = _mixed(grams)
    least = grams[low:n].copy()
    place = np.zeros(len(least), np.int64)
    for o in range(1, span - gram + 1):
        other = grams[low + o : n + o]
        place[other <= least] = o
        np.minimum(least, other, out=least)
    at = np.arange(low, n)
    whole_window = words.text[at] == words.text[at + span - 1]
    at = at[whole_window]
    return at, at + place[whole_window], least[whole_window]


def _runs(words: Words, data: memoryview, first: int, spans: Sequence[int], gram: int, bits: np.ndarray | None):
    """Yields (text, run): consecutive windows of one fingerprint and the words they cover."""
    for span in spans:
        at, place, fps = _choose(words, span, gram, first)
        if bits is not None:
            slot = fps & np.uint64(len(bits) * 64 - 1)
            met = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
            at, place, fps = at[met], place[met], fps[met]
        if not len(at):
            continue
        edge = np.flatnonzero((np.diff(at) > 1) | (np.diff(place) > 0) | (np.diff(words.text[at]) > 0)) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(at)], strict=True):
            covered = range(int(at[s]), int(at[e - 1]) + span)
            texts = [
                bytes(_LOWER[np.frombuffer(data[words.start[i] : words.end[i]], np.uint8)]).decode() for i in covered
            ]
            yield int(words.text[at[s]]), span, int(fps[s].astype(np.int64)), int(at[s]), texts


def winnow(texts: pa.Array, gram: int, spans: Sequence[int], bits: np.ndarray | None, block: int = BLOCK):
    """(words of each text, runs of each text) for one batch.

    A run is a fingerprint with the first word of its first window and the
    words that its windows cover. ``bits`` drops fingerprints the other side
    lacks. At any time the words of one block are held, and the last few before it.
    """
    texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.large_string()) if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = memoryview(raw) if raw is not None else memoryview(b"")
    counts = np.zeros(len(texts), np.int64)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    held = None
    total = 0  # words read before what is held
    firsts = np.full(len(texts), -1, np.int64)  # each text's first word, counted over the batch
    for new in read_words(np.frombuffer(data, np.uint8), offsets, block):
        counts += np.bincount(new.text, minlength=len(texts))
        carried = 0 if held is None else len(held)
        words = new if held is None else held + new
        seen, where = np.unique(new.text, return_index=True)
        unseen = firsts[seen] < 0
        firsts[seen[unseen]] = total + carried + where[unseen]
        for text, span, fp, at, covered in _runs(words, data, carried, spans, gram, bits):
            found[text].append({"span": span, "fp": fp, "start": total + at - int(firsts[text]), "words": covered})
        keep = min(len(words), max(spans, default=1) - 1)
        total += len(words) - keep
        held = words[len(words) - keep :]
    return counts, found


def _fingerprinted(df: DataFrame, kept: str, text: str, gram: int, spans: Sequence[int], bits: np.ndarray | None, own: bool) -> DataFrame:
    """(id, n_words, runs). ``own``: a text of fewer words than a window is one window by itself."""
    narrow = df.select(F.col(f"`{kept}`").alias("id"), whole(text).alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        counts, found = winnow(texts, gram, () if own else spans, bits)
        if own:
            lengths = np.minimum(counts, max(spans))
            for n in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == n)
                for i, runs in zip(at.tolist(), winnow(texts.take(pa.array(at)), gram, (n,), bits)[1], strict=True):
                    found[i] = runs
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts), pa.array(found, pa.list_(_RUN))], ["id", "n_words", "runs"]
        )

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, one, f"id {kind}, n_words bigint, runs {_RUN_SQL}")


def _windows(runs: DataFrame, *kept: str) -> DataFrame:
    """One row per window of each run: the kept columns, fp, start, span and the window's words in one text."""
    offsets = F.sequence(F.lit(0), F.size("run.words") - F.col("run.span"))
    return runs.select(*kept, "run", F.explode(offsets).alias("o")).select(
        *kept,
        F.col("run.fp").alias("fp"),
        (F.col("run.start") + F.col("o")).alias("start"),
        F.col("run.span").alias("span"),
        F.array_join(F.slice("run.words", F.col("o") + 1, F.col("run.span")), " ").alias("window"),
    )


def bit_table(fps: DataFrame) -> np.ndarray:
    """Bits of the distinct fingerprints, 64 in a number; its size follows their count up to MOST_BITS."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * fps.count()).bit_length()))
    slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
    one = F.expr("shiftleft(1L, cast(fp & 63 as int))")
    words = fps.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows), all written tables.

    documents: row (a number), the id as ``id``, n_words. hits: one row per
    window of a document that some item has: row, start (its first word, from
    0), span, window (the words). windows: (item, window), distinct.

    An item of fewer words than ``span``, but not none, is one window of its
    own length; documents are then winnowed once more for each such length,
    of which there are fewer than ``span``.
    """
    spans = range(1, span + 1)
    own = _fingerprinted(items, item_col, text, gram, spans, None, True)
    windows = written(
        _windows(own.select("id", F.explode("runs").alias("run")), "id")
        .select(F.col("id").alias("item"), "fp", "span", "window").distinct(),
        "benchmark-windows", folder,
    )
    fps = windows.select("fp").distinct()
    lengths = sorted(r.span for r in windows.select("span").distinct().collect())
    read = _fingerprinted(docs, id_col, text, gram, lengths, bit_table(fps), False)
    # Rows of the written table are numbered once, so that repeated rows stay apart.
    rows = written(read.withColumn("row", F.monotonically_increasing_id()), "document-fingerprints", folder)
    met = rows.select("row", F.explode("runs").alias("run")).withColumn("fp", F.col("run.fp"))
    met = met.join(fps, "fp", "left_semi").drop("fp")
    hits = written(
        _windows(met, "row")
        .join(windows.select("window").distinct(), "window", "left_semi")
        .select("row", "start", "span", "window"),
        "benchmark-hits", folder,
    )
    return rows.select("row", "id", "n_words"), hits, windows.select("item", "window").distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: its id, n_words, n_hit (words inside a window that an item has, too),
    n_items, items_sha256 (of the items' ids as sorted strings, joined by commas) and contaminated.

    Words are runs of ASCII letters and digits and all characters beyond ASCII,
    A-Z in lower case. Repeated rows and rows that share an id get a row each.
    NULL and empty texts have no words. Items of equal id are one item; a NULL
    item id counts as one item with an empty name. Without documents there are
    no rows; without items no word is hit. Other columns are ignored.
    """
    rows, hits, windows = find_benchmark(
        docs, items, id_col=id_col, item_col=item_col, text=text, span=span, gram=gram, folder=folder
    )
    # A word may lie in several windows: each window adds what reaches beyond those before it.
    end = F.col("start") + F.col("span")
    before = W.partitionBy("row").orderBy("start", "span").rowsBetween(W.unboundedPreceding, -1)
    added = hits.select("row", "start", "span").withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = added.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).cast("long").alias("n_hit")
    )
    name = F.coalesce(F.col("item").cast("string"), F.lit(""))
    named = (
        hits.select("row", "window").distinct().join(windows, "window").select("row", name.alias("item")).distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    return (
        rows.join(hit, "row", "left").join(named, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
