"""Benchmark decontamination against a brute-force search of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from flowguard.llm import winnowing

from .cases import row, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
    # Names that the operator uses inside.
    T.StructField("fp", T.StringType()), T.StructField("row", T.LongType()), T.StructField("window", T.LongType()),
])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def key(r):
    return tuple((v is not None, v) for v in r)


def check(spark, docs, items, **options):
    left = table(spark, [row(d, t) for d, t in docs])
    right = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in items], ITEMS)
    got = winnowing.contamination(left, right, **options)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted(expected(docs, items, options.get("span", 10)), key=key)
    return rows


def random_tables(seed):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "Cc", "été", "x1", "日本", "z"]
    say = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 6, 9, 10, 11, 14, 25]) + 3 * (i % 4))) for i in range(14)]
    docs = []
    for i in range(50):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            w = re.split(r"\s", r.choice(items)[1])
            cut = r.randint(0, 4)
            parts += [" ".join(w[cut : len(w) - r.randint(0, 3)]), say(r.randint(0, 12))]
        docs.append((i, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rows = check(spark, *random_tables(seed))
    assert any(r[5] for r in rows)


def test_awkward_rows(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    items = [
        (1, passage), (2, "w3 W4"), (2, "another one of id two, which has more than ten words in all, and counts"),
        (None, passage[:90]), (4, None), (5, ""), (6, " ,.;"), (7, passage), (7, passage),
    ]
    docs = [
        (1, passage), (1, passage), (1, "another text"), (None, passage), (None, None), (3, None), (4, ""), (5, "?!"),
        (6, "W5 w6 w7 w8 w9 w10 w11 w12 w13"), (7, "x " * 30_000 + passage + " y" * 10), (8, passage.upper().replace(" ", "...")),
        (9, "w3w4 w3"), (10, "y" * 3_000_000 + " " + passage), (11, passage + " " + passage),
    ]
    check(spark, docs, items)


def test_other_lengths(spark):
    docs, items = random_tables(5)
    check(spark, docs, items, span=4, gram=5)
    check(spark, docs, items, span=12, gram=1)


def test_empty_tables(spark):
    docs, items = random_tables(3)
    check(spark, docs, [])
    check(spark, [], items)
    check(spark, [], [])
    check(spark, docs, [(1, None)])


def test_every_shared_span_shares_a_fingerprint():
    r = random.Random(4)
    for _ in range(200):
        shared = [str(r.randint(0, 3)) for _ in range(10)]
        around = lambda: [str(r.randint(0, 3)) for _ in range(r.randint(0, 20))]
        texts = pa.array([" ".join(around() + shared + around()) for _ in range(2)])
        found = [{run["fp"] for run in runs} for runs in winnowing.winnow(texts, 5, (10,), None)[1]]
        assert found[0] & found[1]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_do_not_matter(block):
    texts = pa.array(["", "A bc " * 30, "é", "longword" * 40 + " x y z", "", "p q r s t u v w x y z é è " * 5, "end"]).slice(1)

    def windows(size):
        counts, found = winnowing.winnow(texts, 3, (2, 6), None, size)
        return counts.tolist(), [
            sorted((r["span"], r["fp"], r["start"] + o, *r["words"][o : o + r["span"]]) for r in runs for o in range(len(r["words"]) - r["span"] + 1))
            for runs in found
        ]

    assert windows(block) == windows(1 << 20)


def test_words_of_neighbouring_texts_stay_apart():
    found = list(winnowing.read_words(np.frombuffer(b"abab", np.uint8), np.array([0, 2, 2, 4])))
    assert [x.tolist() for x in (found[0].start, found[0].end, found[0].text)] == [[0, 2], [2, 4], [0, 2]]
    assert found[0].hash[0] == found[0].hash[1]
