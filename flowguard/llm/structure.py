"""Repair of conversation structure: fewest edits that make the roles alternate.

Each conversation is read backwards, row by row, by a dynamic program over a
directed acyclic graph of (row, state of the role pattern). A path's weight is
one whole number: its cost in the high digits, and below them the letters of its
edits as digits at fixed places, the first edit highest and zeros behind the
last. Comparing two such numbers compares costs first and then the letters in
ASCII order, a shorter text before its extensions; so the smallest number is the
answer, with nothing to be traced back.

A task holds the numbers of one row's states, not the conversation: rows stream
through it in order, sorted by Spark, and so do the texts when the repaired
conversation is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .texts import written

# Fixed values of the contract: costs of edits, and what an unfinished text that stays adds.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
# Edits as digits; their order is that of the letters.
LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
# Bits of a digit.
DIGIT = 3

# States of the pattern (s?(ua)+)?: at the start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
FITS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a message by the user or the assistant, whoever's turn it is.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
GOOD_PAIRS = {"su", "ua", "au"}

NOTHING = hashlib.sha256(b"").hexdigest()
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame, id_col: str, turn: str, role: str, text: str) -> DataFrame:
    """(id, turn, role, text) after the damage that the contract asks for; missing values are one space."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn}`").alias("turn"), name(role).alias("role"), name(text).alias("text"),
        (F.crc32(F.concat(name(id_col), F.lit(":"), name(turn))) % 20).alias("damage"),
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return plain.where("damage <> 0").select(
        "id",
        "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit(""))
        .when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds place (from 1, by turn, then role and text) and fault: blank, duplicate, truncated or NULL."""
    order = W.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # The two windows and their sorts share one exchange.
    numbered = rows.repartition("id").withColumn("place", F.row_number().over(order).cast("long"))
    earliest = F.min("place").over(W.partitionBy("id", "role", "text"))
    numbered = numbered.withColumn("again", F.col("place") > earliest)
    return numbered.withColumn("fault", _fault()).drop("again")


def _fault() -> Column:
    seen = F.rtrim("text", F.lit(SPACES))
    return (
        F.when(seen == "", F.lit("blank"))
        .when(F.col("again"), F.lit("duplicate"))
        .when(~F.substring(seen, -1, 1).isin(".", "!", "?"), F.lit("truncated"))
    )


class Backwards:
    """The dynamic program over one conversation, from its last row to its first."""

    def __init__(self, n: int) -> None:
        # Deleting all rows costs DELETE each, so a cheapest repair inserts at most DELETE / INSERT of them.
        self.width = DIGIT * (n + DELETE * n // INSERT + 2)
        self.low = (1 << self.width) - 1
        self.best = self._with_inserts([0, None, None, 0])

    def _edit(self, letter: int, cost: int) -> int:
        return (cost << self.width) + (letter << (self.width - DIGIT))

    def _behind(self, weight: int) -> int:
        """The weight with its letters moved back by one place."""
        return (weight >> self.width << self.width) + ((weight & self.low) >> DIGIT)

    def _with_inserts(self, weights: list[int | None]) -> list[int | None]:
        """Messages may be inserted before what follows; two at most are of use."""
        for _ in range(2):
            weights = [
                min((w for w in (weights[q], self._inserted(weights[NEXT[q]])) if w is not None), default=None) for q in range(4)
            ]
        return weights

    def _inserted(self, weight: int | None) -> int | None:
        return None if weight is None else self._edit(_I, INSERT) + self._behind(weight)

    def row(self, initial: str, fault: str | None) -> None:
        """Puts one row in front of the rows read so far."""
        after = [self._behind(w) for w in self.best]
        weights = [self._edit(_D, DELETE) + w for w in after]
        if fault not in ("blank", "duplicate"):
            more = UNFINISHED if fault == "truncated" else 0
            keep, rerole = self._edit(_K, KEEP + more), self._edit(_R, REROLE + more)
            for q in range(4):
                weights[q] = min(weights[q], rerole + after[NEXT[q]])
                if (q, initial) in FITS:
                    weights[q] = min(weights[q], keep + after[FITS[q, initial]])
        self.best = self._with_inserts(weights)

    def answer(self) -> tuple[int, str]:
        """Cost and letters of the cheapest repair."""
        weight = self.best[START]
        digits, at = [], self.width - DIGIT
        while at >= 0 and (digit := (weight >> at) & 7):
            digits.append(LETTERS[digit])
            at -= DIGIT
        return weight >> self.width, "".join(digits)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """Counts and repair of one conversation of ``n`` rows, which come last first."""

    def __init__(self, n: int) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.program = Backwards(n)
        self.later = None
        self.last = self.first = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault is not None:
            self.counts[fault] += 1
        if self.later is not None and initial + self.later not in GOOD_PAIRS:
            self.counts["illegal"] += 1
        self.later = initial
        if turn is not None and turn != self.first:
            self.last = turn if self.last is None else self.last
            self.first = turn
            self.turns += 1
        self.program.row(initial, fault)

    def report(self) -> dict:
        cost, audit = self.program.answer()
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return self.counts | {"gaps": gaps, "cost": cost, "audit": audit}


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its rows come one behind the other, the last place first."""
    now = None
    for batch in batches:
        ids, done = [], []
        for id_, turn, place, initial, fault in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            now = now or _Conversation(place)
            now.add(turn, initial, fault)
            if place == 1:
                ids.append(id_)
                done.append(now.report())
                now = None
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, batch.schema.field("id").type),
                *[pa.array([r[c] for r in done], pa.int64()) for c in COUNTS],
                pa.array([r["audit"] for r in done], pa.string()),
            ],
            ["id", *COUNTS, "audit"],
        )


def repairs(rows: DataFrame) -> DataFrame:
    """(id, counts, cost, audit) of each conversation with rows; ``rows`` has place and fault."""
    narrow = rows.select(
        "id", F.col("turn").cast("long").alias("turn"), "place", F.substring("role", 1, 1).alias("initial"), "fault"
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
    return narrow.repartition("id").sortWithinPartitions("id", F.col("place").desc()).mapInArrow(_reports, schema)


class Repair:
    """Applies the letters of an audit to rows that come in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _speaker(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The messages inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._speaker(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands in the repaired conversation for this row, and before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = FITS[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            yield self._speaker(), text


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation; its audit stands at place 0, before its rows."""

    def finished() -> str:
        take(repair.inserted())
        return hasher.hexdigest()

    def take(messages: Iterator[tuple[str, str]]) -> None:
        nonlocal begun
        for role, text in messages:
            hasher.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True

    repair, hasher, begun, now = None, None, False, None
    for batch in batches:
        kind = batch.schema.field("id").type
        ids, hashes = [], []
        for id_, place, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if place == 0:
                if repair is not None:
                    hashes.append(finished())
                    ids.append(now)
                repair, hasher, begun, now = Repair(text), hashlib.sha256(), False, id_
            else:
                take(repair.row(role, text))
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], ["id", "repaired_sha256"])
    if repair is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([finished()])], ["id", "repaired_sha256"])


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired conversations' rows, numbered from 1."""
    repair, now, number = None, None, 0
    for batch in batches:
        kind = batch.schema.field("id").type
        out: list[tuple] = []

        def put(messages: Iterator[tuple[str, str]]) -> None:
            nonlocal number
            for role, text in messages:
                number += 1
                out.append((now, number, role, text))

        for id_, place, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if place == 0:
                if repair is not None:
                    put(repair.inserted())
                repair, now, number = Repair(text), id_, 0
            else:
                put(repair.row(role, text))
        yield _rows(out, kind)
    if repair is not None:
        out = []
        for role, text in repair.inserted():
            number += 1
            out.append((now, number, role, text))
        yield _rows(out, kind)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    types = [kind, pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "place", "role", "text"]
    )


def _with_audits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, place, role, text): each conversation's audit as the text of place 0, and then its rows."""
    audits = reports.select("id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.select("id", "place", "role", "text"))
    return both.repartition("id").sortWithinPartitions("id", "place")


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, place, role, text): the repaired conversations, from ``faults`` and ``repairs``."""
    kind = rows.schema["id"].dataType.simpleString()
    return _with_audits(rows, reports).mapInArrow(_repaired, f"id {kind}, place bigint, role string, text string")


def repaired_hashes(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, repaired_sha256): of the repaired ``role:text`` rows, joined by newlines."""
    kind = rows.schema["id"].dataType.simpleString()
    return _with_audits(rows, reports).mapInArrow(_hashes, f"id {kind}, repaired_sha256 string")


def repaired_conversations(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Damages conversations as the contract says, and reports faults and the cheapest repair of each.

    Gives one row per original id: the id column, gaps, blank, duplicate,
    truncated, illegal, cost (longs), audit and repaired_sha256.

    Missing ids (in the damage), turns (likewise), roles and texts count as one
    space; rows without an id are one conversation. Rows go by turn, NULL
    first, and within a turn by role and text; repeated rows are duplicates. A
    role is judged by its first character alone; an empty role fits nowhere.
    A conversation without rows after the damage has zeros, an empty audit and
    the hash of nothing. Without conversations there are no rows. Other columns
    are ignored.
    """
    rows = written(faults(damaged(conversations, id_col, turn, role, text)), "conversation-faults", folder)
    reports = written(repairs(rows), "conversation-repairs", folder)
    done = reports.join(repaired_hashes(rows, reports).withColumnRenamed("id", "hashed"), F.col("id").eqNullSafe(F.col("hashed")))
    every = conversations.select(F.col(f"`{id_col}`").alias("every")).distinct()
    return every.join(done, F.col("every").eqNullSafe(F.col("id")), "left").select(
        F.col("every").alias(id_col),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )
