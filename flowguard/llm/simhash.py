"""SimHash fingerprints and their exact comparison in tiles.

Distinct fingerprints are dealt into cells so that every pair within the radius
shares a cell: of m bit blocks such a pair agrees in m - radius, and every choice
of so many blocks is a key. More blocks make finer cells and more keys; their
number follows the number of fingerprints, so that a cell's mean size is bounded
and the pairs compared grow with the input, not with its square. Inside a
cell all pairs are compared, tile by tile, with numpy exclusive-or and bit
counts; the tiles follow the population count, and tile pairs whose counts
differ beyond the radius are skipped. A cell that holds too much for one task is
cut into a grid of tiles first, each tile pair within the radius being a task's
work. A cell gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .texts import map_batches, one_per_key, row_key, written

# Fixed values of the contract.
SHINGLE = 4
RADIUS = 4
HASH_SEED = 42

#: Shingles hashed at once; bounds the memory of a very long text.
BLOCK = 32_768
#: Fingerprints of one tile inside a task, and of one tile of a cut cell.
TILE = 256
CELL = 4_096
#: With eight blocks a key has 32 bits: cells stay small beyond 10^13 fingerprints.
MOST_BLOCKS = 8


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned 64-bit number.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of
    ``shingle`` words count as often as they occur. Fewer words form one
    shingle; no word gives zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([hash_of(joined[s:e], HASH_SEED) for s, e in spans], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: Column, kept: dict[str, Column], shingle: int = SHINGLE) -> DataFrame:
    """The ``kept`` columns and fp, the fingerprint's bits as a signed long."""
    narrow = docs.select(*[c.alias(n) for n, c in kept.items()], text.alias("_text"))
    fields = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp bigint"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("_text")], np.uint64)
        arrays = [batch.column(f.name) for f in fields] + [pa.array(values.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, [*[f.name for f in fields], "fp"])

    return map_batches(narrow, one, schema)


def key_masks(blocks: int, radius: int) -> list[int]:
    """The bits of each key: every choice of ``blocks - radius`` of the blocks that cover 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    widths = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(widths, blocks - radius)]


def blocks_for(fingerprints: int, radius: int, cell_size: int) -> int:
    """The fewest blocks with which cells of evenly spread fingerprints hold at most ``cell_size``."""
    blocks = radius + 1
    while blocks < MOST_BLOCKS and fingerprints >> (64 * (blocks - radius) // blocks) > cell_size:
        blocks += 1
    return blocks


def forest(fps: np.ndarray, radius: int, sides: np.ndarray | None = None, tile: int = TILE) -> list[tuple[int, int]]:
    """Links that connect whatever pairs within ``radius`` connect, as few as possible.

    ``sides`` numbers the two tiles of a grid's cell; then only pairs between
    the two are compared.
    """
    n = len(fps)
    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    fps, pops = fps[order], pops[order].astype(np.int64)
    sides = None if sides is None else sides[order]
    label = np.arange(n)
    links = []
    for i in range(0, n, tile):
        for j in range(i, n, tile):
            if pops[j] - pops[min(i + tile, n) - 1] > radius:
                break  # the tiles are in order of population counts
            near = np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= radius
            if sides is not None:
                near &= sides[i : i + tile, None] != sides[None, j : j + tile]
            if i == j:
                near = np.triu(near, 1)
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                at = i + row
                found = j + np.flatnonzero(near[row])
                others, where = np.unique(label[found], return_index=True)
                new = others != label[at]
                if new.any():
                    links += [(int(fps[at]), int(fps[found[w]])) for w in where[new].tolist()]
                    label[np.isin(label, others[new])] = label[at]
    return links


def _forests(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Cells lie one behind the other; a cell may span several batches."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table) -> pa.RecordBatch:
        cells = np.stack([rows.column(c).to_numpy() for c in ("block", "value", "tile_a", "tile_b")])
        fps = rows.column("fp").to_numpy().view(np.uint64)
        own = rows.column("tile").to_numpy()
        edges = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
        links = []
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
            if e - s > 1:
                between = cells[2, s] != cells[3, s]
                links += forest(fps[s:e], radius, own[s:e] if between else None)
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def cell(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(c)[row].as_py() for c in ("block", "value", "tile_a", "tile_b"))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = cell(batch, batch.num_rows - 1)
        if held and cell(held[-1], held[-1].num_rows - 1) != last or not held and cell(batch, 0) != last:
            # All rows before the last cell are complete.
            cut = next(
                (r for r in range(batch.num_rows - 1, -1, -1) if cell(batch, r) != last), -1
            ) + 1
            yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield solve(pa.Table.from_batches(held))


def near_links(
    distinct: DataFrame, radius: int = RADIUS, cell_size: int = CELL, blocks: int | None = None
) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the same components as all pairs.

    ``distinct`` is a written table with the column fp, which is counted to
    choose the number of ``blocks`` where none is given. No pair within the radius is left out: cells
    over ``cell_size`` are cut into tiles of one population count and a hash
    salt, and every two tiles within the radius meet in a cell of their own.
    """
    masks = key_masks(blocks or blocks_for(distinct.count(), radius, cell_size), radius)
    keys = [
        F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for k, mask in enumerate(masks)
    ]
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("cell")).select(
        "cell.block", "cell.value", "fp", "pop"
    )
    # One row for each key value and population count. Only cut cells are kept.
    counts = rows.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    grid = (
        counts.groupBy("block", "value")
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(
                F.collect_list(F.struct("pop", F.ceil(F.col("n") / (cell_size // 2)).cast("int")))
            ).alias("salts"),
        )
        .where(F.col("total") > cell_size)
        .select("block", "value", "salts")
    )
    salts = lambda pop: F.coalesce(F.try_element_at("salts", pop), F.lit(0))
    tile_of = lambda pop, salt: pop * F.lit(1 << 24) + salt
    tile = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
        tile_of(F.col("pop"), F.pmod(F.xxhash64("fp"), salts(F.col("pop"))).cast("int"))
    )
    meets = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.col("pop") - radius, F.lit(0)), F.least(F.col("pop") + radius, F.lit(64))),
            lambda p: F.when(
                salts(p) > 0, F.transform(F.sequence(F.lit(0), salts(p) - 1), lambda s: tile_of(p, s))
            ).otherwise(F.array().cast("array<int>")),
        )
    )
    placed = (
        rows.join(grid, ["block", "value"], "left")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(meets)))
        .select(
            "block", "value", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
            "tile", "fp",
        )
    )
    cell = ["block", "value", "tile_a", "tile_b"]
    together = placed.repartition(*cell).sortWithinPartitions(*cell)
    return together.mapInArrow(lambda it: _forests(it, radius), "a bigint, b bigint")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits, the document itself included. NULL and empty texts have the
    fingerprint zero and link like any other. NULL ids get a row and belong to
    their component, but name it only if it has no other id (then NULL). Rows
    that repeat an id each get a row. An empty table gives no rows; other
    columns are ignored.
    """
    rows = written(fingerprints(docs, F.col(text), {"id": F.col(id_col)}, shingle), "fingerprints", folder)
    named = rows.groupBy("fp").agg(F.min("id").alias("least"))
    return rows.join(_named_components(named, radius, folder).hint("merge"), "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _named_components(named: DataFrame, radius: int, folder: str | None) -> DataFrame:
    """(fp, component): the least name over each component of the distinct fingerprints."""
    named = written(named, "distinct", folder)
    roots = components(near_links(named.select("fp"), radius), f"{folder}/components" if folder else None)
    placed = named.join(roots, named.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    return placed.join(names, "root").select("fp", "component")


def drop_near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    folder: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id.

    Of rows that share the smallest id and the text, one stays; of those with
    different texts, the one with the smallest text hash. NULL ids come last.
    NULL and empty texts have the fingerprint zero: they form one component, and
    link to others like any document. An empty table stays empty. All columns
    are kept as they are.
    """
    key = row_key(id_col, text)
    rows = written(fingerprints(docs, F.col(text), {"key": key}, shingle), "fingerprints", folder)
    named = rows.groupBy("fp").agg(F.min("key").alias("least"))
    stays = _named_components(named, radius, folder).select(F.to_json("component").alias("_key")).distinct()
    once = one_per_key(docs, id_col, text)
    return once.join(stays.hint("merge"), "_key", "left_semi").select("_row.*")
