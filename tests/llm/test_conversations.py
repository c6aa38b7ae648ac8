"""The prefix trie and the structure repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from flowguard.llm import prefixes, structure

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    # Names that the operators use inside.
    T.StructField("id", T.StringType()), T.StructField("path", T.LongType()), T.StructField("place", T.StringType()),
    T.StructField("depth", T.StringType()), T.StructField("fault", T.LongType()),
])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 101, 150, 307, 1_000_000_007, -5]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["system", "user", "user", "assistant"]), r.choice(["a.", "b?", "é", "Hm "])))
    return rows


AWKWARD = [
    (None, 1, "user", "of none"), (None, None, None, None), (200, None, None, None), (200, 1, "user", None), (200, 2, "", ""),
    (201, 5, "user", " \t"), (201, 5, "user", " \t"), (201, 9, "tool", "x" * 50_000 + "."), (202, None, "assistant", "a."),
    (203, 3, "user", "q?"), (203, 3, "user", "q?"), (203, 3, "assistant", "q?"),
]
LONG = [(400, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(75)] + [
    (401 + c, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for c in range(3) for t in range(70 + c)
]


# --- prefix trie


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        parent = min(nodes[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(members), len(path), parent, len(members), children, leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def got_trie(spark, rows, **options):
    got = prefixes.prefix_trie(table(spark, rows), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3, 32])
def test_trie_is_that_of_brute_force(spark, levels):
    rows = conversations(1, 40) + AWKWARD
    assert got_trie(spark, rows, levels=levels) == trie(rows)


def test_long_conversations_take_several_rounds(spark):
    assert got_trie(spark, LONG) == trie(LONG)


def test_trie_of_copies_and_slices(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SLICE", 7)
    rows = [(c, t, "user", "same") for c in range(300, 400) for t in range(6)] + [(7, 0, "user", "same")]
    assert got_trie(spark, rows) == trie(rows)


def test_trie_without_turns_or_conversations(spark):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 1, "user", "x")]) == []
    # Conversations that lose all their turns, and have no first one in their group.
    short = [(c, 0, "user", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]
    assert got_trie(spark, short) == trie(short) and len(trie(short)) == 1


# --- structure repair

VALID = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows, by trying all edits with up to two inserts in each gap."""
    best = None
    speakers = {"u": "user", "a": "assistant"}
    inserts = ["", "u", "a", "ua", "au"]
    for choice in itertools.product("KuaD", repeat=len(rows)):
        if any(c != "D" and f in ("blank", "duplicate") for c, (_, _, f) in zip(choice, rows, strict=True)):
            continue
        cost = sum({"K": 0, "u": 1, "a": 1, "D": 2}[c] + 5 * (c != "D" and f == "truncated") for c, (_, _, f) in zip(choice, rows, strict=True))
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            total = cost + 5 * len("".join(gaps))
            if best is not None and total > best[0]:
                continue
            audit, out = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(gaps[i])
                out += [(speakers[x], "") for x in gaps[i]]
                if i < len(rows):
                    c, (role, text, _) = choice[i], rows[i]
                    audit += "R" if c in "ua" else c
                    out += [] if c == "D" else [(role if c == "K" else speakers[c], text)]
            if all(r for r, _ in out) and VALID.fullmatch("".join(r[0] for r, _ in out)):
                best = min(best or (total, audit, out), (total, audit, out))
    return best


def test_program_finds_the_cheapest_and_first_edits():
    r = random.Random(7)
    for _ in range(250):
        rows = [
            (r.choice(["system", "user", "user", "assistant", "tool", ""]), r.choice("xy"), r.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for _ in range(r.randint(0, 3))
        ]
        program = structure.Backwards(len(rows))
        for role, _, fault in reversed(rows):
            program.row(role[:1], fault)
        cost, audit = program.answer()
        repair = structure.Repair(audit)
        out = [m for role, text, _ in rows for m in repair.row(role, text)] + list(repair.inserted())
        assert (cost, audit, out) == cheapest(rows), rows


def test_inserts_that_pay():
    # Seven finished messages with one missing: an insert costs less than rerole and deletes.
    program = structure.Backwards(8)
    for initial in reversed("uauauuau"):
        program.row(initial, None)
    assert program.answer()[0] <= 7 and set(program.answer()[1]) <= set("KDRI")
    program = structure.Backwards(2)
    program.row("u", None)
    assert program.answer() == (2, "D")


def plain_dp(rows):
    """The same by a dictionary of (cost, audit, state), from the first row to the last."""
    after = {"0": "u", "s": "u", "u": "a", "a": "u"}
    states = {"0": (0, "")}

    def insert(states):
        for _ in range(2):
            for q, (c, e) in list(states.items()):
                new = (c + 5, e + "I")
                states[after[q]] = min(states.get(after[q], new), new)
        return states

    for role, _, fault in rows:
        more = 5 if fault == "truncated" else 0
        new = {}
        for q, (c, e) in insert(dict(states)).items():
            options = [(q, c + 2, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((after[q], c + 1 + more, "R"))
                if role[:1] == after[q] or (q, role[:1]) == ("0", "s"):
                    options.append((role[0], c + more, "K"))
            for to, cost, letter in options:
                new[to] = min(new.get(to, (cost, e + letter)), (cost, e + letter))
        states = new
    return min(v for q, v in insert(states).items() if q in "0a")[0]


def test_long_conversations_by_another_program():
    r = random.Random(8)
    for _ in range(30):
        rows = [(r.choice(["user", "assistant", "system"]), "", r.choice([None] * 6 + ["blank", "truncated"])) for _ in range(r.randint(20, 200))]
        program = structure.Backwards(len(rows))
        for role, _, fault in reversed(rows):
            program.row(role[:1], fault)
        assert program.answer()[0] == plain_dp(rows)


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def repaired(rows, repair):
    out, after = [], damaged(rows)
    for c in {r[0] for r in rows}:
        marked, seen, counts = [], set(), dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        for _, role, text in after.get(c, []):
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in after.get(c, []) if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, fixed = repair(marked)
        out.append((c, gaps, *counts.values(), illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in fixed))))
    return sorted(out, key=str)


def by_program(rows):
    """The operator's program over rows in memory: it has its own tests above."""
    program = structure.Backwards(len(rows))
    for role, _, fault in reversed(rows):
        program.row(role[:1], fault)
    cost, audit = program.answer()
    repair = structure.Repair(audit)
    return cost, audit, [m for role, text, _ in rows for m in repair.row(role, text)] + list(repair.inserted())


def got_repairs(spark, rows):
    got = structure.repaired_conversations(table(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_short_conversations_by_brute_force(spark):
    rows = [r for r in conversations(2) if r[1] < 3] + AWKWARD
    assert got_repairs(spark, rows) == repaired(rows, cheapest)


def test_conversations_of_all_kinds(spark):
    rows = conversations(3, 150) + AWKWARD + LONG + [(500, 3, "user", "dropped?")]
    rows += [(600, t, "user", "again.") for t in range(40)]
    assert got_repairs(spark, rows) == repaired(rows, by_program)


def test_conversation_that_loses_all_rows(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got_repairs(spark, [(lost, 0, "user", "x.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert got_repairs(spark, []) == []


def test_repaired_rows(spark):
    rows = conversations(4)
    faulty = structure.faults(structure.damaged(table(spark, rows), "conv_id", "turn", "role", "text")).cache()
    got = defaultdict(list)
    for r in structure.repaired_rows(faulty, structure.repairs(faulty)).orderBy("id", "place").collect():
        got[r.id].append(f"{r.role}:{r.text}")
    want = {r[0]: r[-1] for r in repaired(rows, by_program)}
    assert {c: sha("\n".join(got.get(c, []))) for c in want} == want
