"""A trie of conversation prefixes, built by truncation peeling.

A node is a distinct sequence of first turns. The trie is peeled from its
deepest turn upwards: conversations that end in the depths at hand join the
nodes that survived from below, their last turns are stripped, and what has
become equal is grouped. Counts, leaves and savings are carried along, so a
subtree is never walked again, and equal conversations are one row from the
start.

A round strips up to ``LEVELS`` turns: its truncations by one turn, two turns
and so on are grouped in one shuffle, so that a conversation of hundreds of
turns costs a few rounds and not hundreds of jobs. All groupings add up partial
sums before the shuffle; a prefix that a third of all conversations share is no
single task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import map_batches, written

# Fixed values of the rebuilding: conversations that share a first one, and the most turns taken from it.
GROUP, SHARED = 100, 6
# Depths that one round peels.
LEVELS = 32
# Ids of one text of ids: an id's slice is the id divided by this.
SLICE = 4096

ROOT = hashlib.md5(b"").digest()


def turn_lists(conversations: DataFrame, id_col: str, turn: str, role: str, text: str) -> DataFrame:
    """(id, turns): each conversation's turns in order, each as a digest of role and text and a number of code points.

    Texts don't enter the shuffle. Rows of one turn number are ordered by their digests.
    """
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.struct(
            # NULLs come first in the order of structs.
            F.col(f"`{turn}`").alias("turn"),
            # The length keeps the border between role and text.
            F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("digest"),
            F.length(said).cast("long").alias("size"),
        ).alias("turn"),
    )
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.select("id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(lists: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Each conversation with its first turns replaced by those of its group's first conversation."""
    first = lists.where(F.col("id") % group == 0).select(
        F.col("id").alias("base"), F.slice("turns", 1, shared - 1).alias("opening")
    )
    taken = (F.crc32(F.col("id").cast("string")) % shared).cast("int")
    own = lists.withColumns({"base": F.col("id") - F.col("id") % group, "taken": taken})
    opening = F.slice(F.coalesce("opening", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    rest = F.slice("turns", F.col("taken") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("taken")))
    return own.join(first, "base", "left").select("id", F.concat(opening, rest).alias("turns"))


def _paths(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Chained digests: the n-th names the first n turns."""
    keys, sizes = [], []
    for turns in batch.column("turns").to_pylist():
        path, key = [], ROOT
        for t in turns:
            key = hashlib.md5(key + t["digest"]).digest()
            path.append(key)
        keys.append(path)
        sizes.append([t["size"] for t in turns])
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))],
        ["id", "path", "sizes"],
    )


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from its slices, which come in order: only the running hash of its ids is held."""
    names = ["key", "path", "sizes", "depth", "n", "conv_id", "ends_sha256"]
    types = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    node, hasher = None, None

    def rows(nodes: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in nodes], t) for c, t in zip(names, types, strict=True)], names)

    for batch in batches:
        done = []
        for part in batch.to_pylist():
            if node is not None and node["key"] == part["key"]:
                hasher.update(b",")
                node["n"] += part["n"]
                node["conv_id"] = min(node["conv_id"], part["conv_id"])
            else:
                if node is not None:
                    done.append(node | {"ends_sha256": hasher.hexdigest()})
                node, hasher = part | {"depth": len(part["path"])}, hashlib.sha256()
            hasher.update(part["ids"].encode())
        yield rows(done)
    if node is not None:
        yield rows([node | {"ends_sha256": hasher.hexdigest()}])


def endings(paths: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per distinct conversation: key, path, sizes, depth, n of those that end there, the smallest id, ends_sha256."""
    last = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.lit(ROOT))
    # A conversation ends once, so a slice has at most SLICE ids, whatever the number of copies.
    slices = (
        paths.withColumn("key", last)
        .groupBy("key", F.floor(F.col("id") / SLICE).alias("slice"))
        .agg(
            F.first("path").alias("path"),
            F.first("sizes").alias("sizes"),
            F.count(F.lit(1)).alias("n"),
            F.min("id").alias("conv_id"),
            F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"),
        )
    )
    merged = slices.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(
        _ends, "key binary, path array<binary>, sizes array<bigint>, depth bigint, n bigint, conv_id bigint, ends_sha256 string"
    )
    return written(merged, "conversation-ends", folder)


def peel(states: DataFrame, low: int) -> DataFrame:
    """The nodes of the depths from ``low`` to the deepest state.

    A state is (path, sizes, depth, n, conv_id, ends_sha256, n_children,
    n_leaves, saved): a distinct conversation that ends at its depth, or a node
    that survived from below, which then brings its subtree's numbers.

    Nodes have key, parent, depth, conv_id, n, ends_sha256, n_children, n_leaves
    and saved, and those at ``low`` the path and sizes above them.
    """
    # Every truncation of a state that ends in these depths.
    at = F.col("d") == F.col("depth")
    cut = states.withColumn("d", F.explode(F.sequence(F.lit(low).cast("long"), F.col("depth"))))
    once = lambda c: F.when(at, F.col(c)).otherwise(F.lit(0))
    truncated = cut.select(
        "d",
        F.element_at("path", F.col("d").cast("int")).alias("key"),
        F.element_at("sizes", F.col("d").cast("int")).alias("size"),
        F.slice("path", F.lit(low), (F.col("d") - (low - 1)).cast("int")).alias("chain"),
        F.when(F.col("d") == low, F.struct(F.slice("path", 1, low - 1).alias("path"), F.slice("sizes", 1, low - 1).alias("sizes"))).alias("above"),
        "n",
        "conv_id",
        F.when(at, F.col("ends_sha256")).alias("ends_sha256"),
        *[once(c).alias(c) for c in ("n_children", "n_leaves", "saved")],
        (~at).alias("longer"),
    )
    nodes = truncated.groupBy("d", "key").agg(
        *[F.first(c).alias(c) for c in ("size", "chain", "above")],
        *[F.sum(c).alias(c) for c in ("n", "n_children", "n_leaves", "saved")],
        F.min("conv_id").alias("conv_id"),
        F.max("ends_sha256").alias("ends_sha256"),
        F.max("longer").alias("longer"),
    )
    childless = ~F.col("longer") & (F.col("n_children") == 0)
    nodes = nodes.withColumns({
        "n_leaves": F.when(childless, F.lit(1)).otherwise(F.col("n_leaves")),
        "saved": (F.col("n") - 1) * F.col("size") + F.col("saved"),
        "parent": F.when(F.col("d") > low, F.get("chain", (F.col("d") - low - 1).cast("int")))
        .when(F.lit(low == 1), F.lit(ROOT)).otherwise(F.element_at("above.path", -1)),
    })
    # A node's numbers go to itself and to its ancestors in these depths.
    itself = F.col("level") == F.col("d")
    mine = lambda c: F.when(itself, F.col(c)).alias(c)
    given = nodes.select("*", F.posexplode("chain").alias("i", "to")).withColumn("level", F.col("i") + F.lit(low).cast("long"))
    given = given.select(
        "level",
        "to",
        *[mine(c) for c in ("parent", "conv_id", "n", "ends_sha256", "above")],
        F.when(itself, F.col("n_children")).otherwise((F.col("level") == F.col("d") - 1).cast("long")).alias("n_children"),
        "n_leaves",
        "saved",
    )
    # Exactly one of the rows of a key is its own.
    return given.groupBy(F.col("to").alias("key"), F.col("level").alias("depth")).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("parent", "conv_id", "n", "ends_sha256", "above")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")],
    )


def prefix_trie(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    levels: int = LEVELS,
    folder: str | None = None,
) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, all but the last as longs. The
    result doesn't depend on ``levels``.

    Rows without a conversation id are ignored. NULL roles and texts are empty,
    NULL turns come first, and rows of one conversation and turn are ordered by
    a digest of role and text; repeated rows are turns of their own. Without
    conversations there are no rows, not even the root. Other columns are
    ignored.
    """
    lists = turn_lists(conversations, id_col, turn, role, text)
    # Read twice: for the conversations and for the first ones of groups.
    lists = written(lists, "conversation-turns", folder)
    paths = map_batches(rebuilt(lists), _paths, "id bigint, path array<binary>, sizes array<bigint>")
    ends = endings(paths, folder)
    fresh = ends.select(
        "path", "sizes", "depth", "n", "conv_id", "ends_sha256", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved")]
    )
    high = ends.agg(F.max("depth")).first()[0] or 0
    rounds: list[DataFrame] = []
    states = None
    while high > 0:
        low = max(1, high - levels + 1)
        new = fresh.where(F.col("depth").between(low, high))
        nodes = written(peel(new if states is None else new.unionByName(states), low), f"conversation-nodes-{low}", folder)
        rounds.append(nodes)
        states = nodes.where(F.col("depth") == low).select(
            "above.path", "above.sizes", (F.col("depth") - 1).alias("depth"), "n", "conv_id",
            F.lit(None).cast("string").alias("ends_sha256"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved",
        )
        high = low - 1
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    # The root: conversations without turns and the survivors of the last round.
    turnless = fresh.where("depth = 0")
    top = turnless if states is None else turnless.unionByName(states)
    top = top.agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("ends_sha256").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")],
    ).where("n_convs > 0")
    root_id = (top.first() or {"conv_id": None})["conv_id"]
    root = top.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", nothing).alias("ends_sha256"),
    )
    if not rounds:
        return root.select(*columns)
    nodes = reduce(DataFrame.unionByName, [r.drop("above") for r in rounds])
    # All nodes of depth 1 have the root for parent: no join for its many children.
    names = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root_id).cast("long"))
    deeper = nodes.where("depth > 1").join(names, "parent")
    return root.select(*columns).unionByName(
        first.unionByName(deeper).select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
            F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
