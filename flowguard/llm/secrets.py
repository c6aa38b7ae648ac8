"""Secrets in texts, found by one automaton over all rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, any_case, backward, forward
from .texts import map_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` then ``tail``; matches with a tail under ``least`` bytes are dropped.

    Dropping comes after matching: a dropped match has used up its characters.
    """

    kind: str
    head: str
    tail: str
    least: int = 0


# Fixed values of the contract. A hexadecimal run of 32 characters is the same as a longest run
# with the shorter ones dropped; counted inside the automaton, plain text seldom ends a match.
BASE = (
    Rule(
        "assign",
        any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=-]+",
        8,
    ),
    Rule("access", "AKIA", "[A-Z0-9]+", 12),
    Rule("hex", "", "[0-9a-f]{32,}"),
)
# What follows a private key's first line: base64 or the name of a field, whose value goes to the end
# of its line. Two dashes end it, as before END; one behind a word belongs to it, as in DEK-Info.
# Line ends may be written out, as in JSON.
KEY_LINES = r"""([\r\n\\]+([A-Za-z0-9+/=]+-?)*(: ?[^\r\n\\"]*)?)*"""
MORE = (
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY( BLOCK)?", "-----" + KEY_LINES),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        patterns = [f"({r.head})({r.tail})" if r.head else r.tail for r in rules]
        self.automaton = Automaton(patterns)
        self.starts = [backward(p) for p in patterns]
        self.heads = [forward(r.head) if r.least and r.head else None for r in rules]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for k, ends in self.automaton.ends(data).items():
            rule, before = self.rules[k], 0
            for end in ends:
                # The leftmost start is the longest way back that doesn't touch the last match.
                start = end - self.starts[k].longest(data, end - 1, before - 1, -1)
                before = end
                head = self.heads[k].longest(data, start, end) if self.heads[k] else 0
                if end - start - head >= rule.least:
                    found.append((start, k, end))
        found.sort()
        if len(data) != len(text):
            place = _code_points(data, sorted({x for s, _, e in found for x in (s, e)}))
            found = [(place[s], k, place[e]) for s, k, e in found]
        return [(self.rules[k].kind, s, e) for s, k, e in found]


def _code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each of the rising byte offsets."""
    out, at, n = {}, 0, 0
    for offset in offsets:
        n += len(data[at:offset].decode("utf-8", "surrogatepass"))
        out[offset], at = n, offset
    return out


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One compiled scanner for each Python worker."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: its id and ``secrets``, an array of (kind, start, end).

    Offsets are code points of the whole text, end exclusive, ordered by start
    and then by rule. NULL and empty texts have none. NULL and repeated ids are
    passed on; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = scanner(rules).spans
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py() or "")] for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(span))], ["id", "secrets"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = map_batches(narrow, scan, f"id {id_type}, secrets array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def redact(text: str, secrets: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; nested spans go as one."""
    out, at = [], 0
    for kind, start, end in secrets:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def written_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

