"""Line dedup against comparing all lines."""

import random
from collections import Counter

import pytest

from flowguard.llm import lines

from .cases import SCHEMA, awkward, row, table


def _distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def _brute(rows, edits=1, least=20, copied=1):
    """Texts after dropping, by (id, text); documents equal in both are one."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = [], {}
    for none, i, text in docs:
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(" ")
            if len(line) >= copied:
                long = edits and len(line) >= least
                gone = any(line == s or long and len(s) >= least and _distance(line, s) <= 1 for s in seen)
                seen.append(line)
                if gone:
                    continue
            kept.append(raw)
        out[None if none else i, text] = "\n".join(kept)
    return out


def _near_rows(seed=5, n=120):
    r = random.Random(seed)
    base = ["the quick brown fox jumps over it", "ééé a line with other letters ïï", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "short"]
    base += ["".join(r.choice("ab ") for _ in range(r.randint(18, 26))).strip() for _ in range(15)]

    def edit(s):
        k = r.random()
        if not s or k < 0.3:
            return s
        at, c = r.randrange(len(s)), r.choice("abxé")
        return s[:at] + c + s[at + 1 :] if k < 0.55 else s[:at] + s[at + 1 :] if k < 0.8 else s[:at] + c + s[at:]

    return [
        row(i, "\n".join(r.choice(["", " ", "  "]) + edit(edit(r.choice(base))) for _ in range(r.randint(1, 4)))) for i in range(n)
    ]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_lines_equal_brute_force(spark, tmp_path, broadcast_rows):
    rows = _near_rows() + [row(i + 1000, t[1]) for i, t in enumerate(awkward())] + [row(3, _near_rows()[3][1]), row(None, None), row(None, "x" * 25)]
    docs = table(spark, rows)
    out = lines.drop_repeated_lines(docs, broadcast_rows=broadcast_rows, folder=f"{tmp_path}/a")
    assert out.columns == docs.columns
    want = _brute(rows)
    expected = Counter((r[0], None if r[1] is None else want[r[0], r[1]]) for r in rows)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expected
    report = lines.line_report(docs, folder=f"{tmp_path}/b").collect()
    assert Counter((r.doc_id, r.text) for r in report) == Counter((r[0], want[r[0], r[1] or ""]) for r in rows)
    for r in report:
        assert r.n_near <= r.n_repeated <= r.n_lines
    assert sum(r.n_near for r in report) > 0


def test_exact_only(spark, tmp_path):
    rows = _near_rows(8)
    want = _brute(rows, edits=0)
    out = lines.drop_repeated_lines(table(spark, rows), edits=0, folder=f"{tmp_path}/a").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], want[r[0], r[1]]) for r in rows)


def test_long_lines_and_no_rows(spark, tmp_path):
    r = random.Random(6)
    line = "".join(r.choice("abcdef ") for _ in range(30_000)) + "z"
    rows = [row(1, line), row(2, line[:9_000] + "#" + line[9_001:]), row(3, line[:20_000] + line[20_001:]), row(4, line[:10] + "##" + line[12:])]
    out = lines.drop_repeated_lines(table(spark, rows), folder=f"{tmp_path}/a").collect()
    assert {x.doc_id: bool(x.text) for x in out} == {1: True, 2: False, 3: False, 4: True}
    assert lines.drop_repeated_lines(spark.createDataFrame([], SCHEMA), folder=f"{tmp_path}/b").collect() == []


def test_a_document_of_very_many_repeated_lines(spark, tmp_path):
    """Taking lines out costs in proportion to the text, not to its square."""
    text = "\n".join(["the same line again and again"] * 400_000 + ["the last line, which is another one"])
    out = lines.drop_repeated_lines(table(spark, [row(1, text), row(2, "the same line again and again")]), folder=f"{tmp_path}/a").collect()
    assert {r.doc_id: r.text for r in out} == {1: "the same line again and again\nthe last line, which is another one", 2: ""}


def test_short_copies_go(spark, tmp_path):
    rows = [row(1, "menu\nmenu\n\n  \na heading of 17 ch."), row(2, " menu\nmenx\n\na heading of 17 cx.\nb"), row(3, "b\nb")]
    docs = table(spark, rows)
    out = lines.drop_repeated_lines(docs, folder=f"{tmp_path}/a").collect()
    # Equal short lines go, blank lines and those one edit apart stay.
    assert {r.doc_id: r.text for r in out} == {1: "menu\n\n  \na heading of 17 ch.", 2: "menx\n\na heading of 17 cx.\nb", 3: ""}
    out = lines.drop_repeated_lines(docs, edits=0, folder=f"{tmp_path}/b").collect()
    assert {r.doc_id: r.text for r in out}[3] == ""
    kept = lines.drop_repeated_lines(docs, least_copied=20, folder=f"{tmp_path}/c").collect()
    assert {r.doc_id: r.text for r in kept} == {r[0]: r[1] for r in rows}


def test_edits_in_lines_of_over_a_million_characters(spark, tmp_path):
    r = random.Random(7)
    line = "".join(r.choices("abcdefgé ", k=(1 << 20) + 5_000)) + "z"
    at = 700_000
    texts = [line, line[:at] + "#" + line[at + 1 :], line[:at] + line[at + 1 :], line[:10] + "##" + line[12:]]
    out = lines.drop_repeated_lines(table(spark, [row(i, t) for i, t in enumerate(texts)]), folder=f"{tmp_path}/a").collect()
    assert {x.doc_id: bool(x.text) for x in out} == {0: True, 1: False, 2: False, 3: True}
