"""Secret scan and quality rules against plain regexes and counting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowguard.llm import quality, secrets
from flowguard.llm.automaton import Automaton

from .cases import SCHEMA, awkward, row, table

HEAD = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
PLAIN = [
    ("assign", re.compile(HEAD + "([A-Za-z0-9+/_.=-]+)", re.A), lambda m: len(m[1]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ("github", re.compile("gh[opsur]_([A-Za-z0-9]+)"), lambda m: len(m[1]) >= 36),
    ("slack", re.compile("xox[abprs]-([A-Za-z0-9-]+)"), lambda m: len(m[1]) >= 10),
    (
        "private_key",
        re.compile(r"""-----BEGIN ([A-Z]+ )*PRIVATE KEY( BLOCK)?-----([\r\n\\]+([A-Za-z0-9+/=]+-?)*(: ?[^\r\n\\"]*)?)*"""),
        bool,
    ),
]


def plain_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, rx, good) in enumerate(PLAIN) for m in rx.finditer(text) if good(m)]
    return [(k, s, e) for s, i, e, k in sorted(found)]


PARTS = [
    "password", "passwd", "secret", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "deadbeef", "0123456789abcdef",
    "AKIA", "ABCD1234", "é", "x", "_", ".", "ghp_", "aB3dE5gH7j", "xoxb-", "-", "-----BEGIN RSA PRIVATE KEY-----", "\n", "ſ", "K",
    "-----BEGIN PGP PRIVATE KEY BLOCK-----", "-----END RSA PRIVATE KEY-----", "\r\n", "\\n", "Proc-Type: 4",
]


def secret_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_scanner_equals_regexes():
    scan = secrets.scanner(secrets.BASE + secrets.MORE)
    for text in secret_texts(8_000):
        assert scan.spans(text) == plain_spans(text), text


def test_dropped_match_uses_up_its_text():
    scan = secrets.scanner(secrets.BASE)
    assert scan.spans("token=secret :abcdefgh12") == []
    assert scan.spans("é token==abcdefgh") == [("assign", 2, 17)]


def test_automaton_refuses_what_it_cannot_follow():
    with pytest.raises(ValueError):
        Automaton(["a*"])
    with pytest.raises(ValueError):
        Automaton(["ab(cd)*e?"])


def test_secret_table(spark):
    rows = awkward() + [row(5000 + i, t) for i, t in enumerate(secret_texts(200, 2))]
    rows.append(row(9000, "x " * 40_000 + "é" + "ab" * 16))
    got = secrets.find_secrets(table(spark, rows)).collect()
    expected = Counter((r[0], tuple(plain_spans(r[1] or ""))) for r in rows)
    assert Counter((g.doc_id, tuple(map(tuple, g.secrets))) for g in got) == expected
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_columns(spark, sf):
    from flowguard.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for g in QUERIES["op1_secret_scan"](spark, sf).collect():
        spans = plain_spans(texts[g.doc_id])
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        assert g.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest() and g.spans == join(spans)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))


def test_redact():
    assert secrets.redact("a token=abcdefgh b", [("assign", 2, 16)]) == "a [assign] b"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n"])
@pytest.mark.parametrize("name, fields", [
    ("PRIVATE KEY", []),
    ("RSA PRIVATE KEY", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C", ""]),
    ("PGP PRIVATE KEY BLOCK", ["Version: GnuPG v2", "Comment: one - two", ""]),
])
def test_key_material_is_redacted(end, name, fields):
    material = ["MIIEpAIBAAKCAQEA+/x9", "Zm9vYmFy0==", "=aB3d"]
    block = end.join([f"-----BEGIN {name}-----", *fields, *material, f"-----END {name}-----"])
    text = f'é "{block}" between "{block}" behind'
    scan = secrets.scanner(secrets.BASE + secrets.MORE)
    left = secrets.redact(text, scan.spans(text))
    assert not any(m in left for m in material)
    # The n of a line end that is written out is a word with a dash behind it.
    rest = f'"[private_key]{"-" * (4 if end == chr(92) + "n" else 5)}END {name}-----"'
    assert left == f"é {rest} between {rest} behind"


def test_a_key_without_its_end():
    scan = secrets.scanner(secrets.MORE)
    assert scan.spans("-----BEGIN PRIVATE KEY----- is a header") == [("private_key", 0, 27)]
    two = "-----BEGIN PRIVATE KEY-----\nQUJD\n"
    assert scan.spans(two * 2) == [("private_key", 0, 33), ("private_key", 33, 66)]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    ]


def test_counts():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "c", " ", "\n", "#", "\x0b", " ", "é", "<"]) for _ in range(r.randint(0, 80)))
        assert quality.statistics(text)[0] == plain_counts(text)
    assert quality.statistics("a b c " * 2)[0][4] == 6 and quality.statistics("")[0] == [0] * 5


def _labelled(n=400):
    r = random.Random(7)
    letters = "abcdefghijklmnop"
    word = lambda least: "".join(r.choice(letters) for _ in range(r.randint(least, 8)))
    good = lambda: " ".join(word(1) for _ in range(r.randint(60, 160)))
    bad = lambda: " ".join(word(5) + r.choice(["###", "$$$", "%%%"]) for _ in range(120))
    return [(10_000 + i, good() if i % 8 else bad(), int(i % 8 != 0)) for i in range(n)]


def test_forest_finds_junk(spark):
    cases = _labelled()
    docs = table(spark, [row(i, t) for i, t, _ in cases] + awkward())
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in cases[:300]] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, forest).collect() if r.doc_id is not None}
    held = [(got[i].kept, q) for i, _, q in cases[300:]]
    assert np.mean([k for k, q in held if q]) > 0.95 and np.mean([k for k, q in held if not q]) < 0.1
    for i, t, _ in cases:
        assert [got[i][c] for c in quality.COUNTS] == plain_counts(t)
    assert got[2000].base_failed and not got[2000].kept and got[2003].base_failed
    kept = quality.keep_good(docs, forest)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.score(docs, forest).where("kept").collect())


def test_forest_without_labels(spark):
    docs = table(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert quality.score(docs, None).where("kept = base_failed").count() == 0
    one_kind = spark.createDataFrame([(2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, one_kind)).where("kept = base_failed").count() == 0
    assert quality.score(spark.createDataFrame([], SCHEMA), None).collect() == []


def test_path_lengths_of_outliers():
    r = np.random.default_rng(1)
    x = r.normal(size=(2_000, 3))
    forest = quality.grow(x)
    outer, inner = forest.path_lengths(np.array([[8.0, -8.0, 8.0], [0.0, 0.0, 0.0]]))
    assert outer < inner - 2


def plain_path(forest, tree, row, node=0):
    """Splits from a node to the leaf of a row, and the further ones that the leaf's rows would take."""
    f = forest.feature[tree, node]
    if f < 0:
        return forest.depth[tree, node]
    return plain_path(forest, tree, row, forest.child[tree, node] + int(row[f] >= forest.value[tree, node]))


def test_path_lengths_by_brute_force():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 4)), 1)
    forest = quality.grow(x, trees=20, sample=64)
    rows = np.concatenate([x[:60], r.normal(size=(40, 4)) * 4])
    want = [np.mean([plain_path(forest, t, row) for t in range(20)]) for row in rows]
    assert np.allclose(forest.path_lengths(rows), want)


def test_trees_by_brute_force():
    """Each leaf's path length is its depth and the mean number of splits for the rows of the sample in it."""
    x = np.random.default_rng(3).normal(size=(64, 2))
    forest = quality.grow(x, trees=5, sample=64)
    harmonic = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    for t in range(5):
        todo = [(0, x, 0)]
        while todo:
            node, part, depth = todo.pop()
            f = forest.feature[t, node]
            if f < 0:
                further = 0 if len(part) < 2 else 1 if len(part) == 2 else harmonic(len(part))
                assert np.isclose(forest.depth[t, node], depth + further)
                continue
            right = part[:, f] >= forest.value[t, node]
            assert right.any() and not right.all()
            child = forest.child[t, node]
            todo += [(child, part[~right], depth + 1), (child + 1, part[right], depth + 1)]


def test_usual_shares_come_from_good_rows():
    x = np.zeros((1_000, len(quality.FEATURES)))
    at = quality.FEATURES.index("digit_share")
    x[:, at] = np.arange(1_000) / 1_000
    usual = quality.usual_shares(x, np.ones(1_000, bool), 0.005)
    assert 0.99 < usual[at] < 1 and usual.sum() == usual[at]
    assert (quality.excess(x, usual)[:, at] > 0).sum() == 5
    assert quality.usual_shares(x, np.zeros(1_000, bool), 0.005).sum() == 0
