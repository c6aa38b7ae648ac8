"""Exact and near duplicates against brute force."""

import hashlib
import re
import uuid

import numpy as np
import pytest
import xxhash

from flowguard.llm import digests, simhash
from flowguard.llm.components import components

from .cases import SCHEMA, awkward, row, table


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _dedup(spark, docs, tmp_path, name, arrival="first"):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    return digests.exact_duplicates(docs, name, f"{tmp_path}/{name}", arrival=arrival, folder=folder).collect()


def test_exact_duplicates(spark, tmp_path):
    rows = awkward()
    got = _dedup(spark, table(spark, rows), tmp_path, "index_a")
    assert len(got) == len(rows)
    ids = {}
    for r in rows:
        ids.setdefault(_norm(r[1]), []).append(r[0])
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in ids.items()}
    kept = {}
    for g in got:
        members = by_hash[g.text_sha256]
        assert g.group_size == len(members)
        assert g.keep_id == min((m for m in members if m is not None), default=None)
        kept[g.text_sha256] = kept.get(g.text_sha256, 0) + g.kept
        assert not g.kept or g.doc_id == g.keep_id
    assert set(kept.values()) == {1}


def test_index_outlives_arrivals(spark, tmp_path):
    first = table(spark, [row(10, "a  b"), row(11, "c")])
    second = table(spark, [row(1, "a b"), row(2, "d"), row(3, "d")])
    assert {r.keep_id for r in _dedup(spark, first, tmp_path, "index_b")} == {10, 11}
    later = {r.doc_id: (r.keep_id, r.kept) for r in _dedup(spark, second, tmp_path, "index_b", "second")}
    assert later == {1: (10, False), 2: (2, True), 3: (2, False)}
    # The same path under another name, as a new session would open it.
    options = {"table": "index_c", "path": f"{tmp_path}/index_b"}
    again = digests.exact_duplicates(second, arrival="second", folder=f"{tmp_path}/again", **options)
    assert {r.doc_id: (r.keep_id, r.kept) for r in again.collect()} == later
    # The same rows under another name are another arrival, of which nothing is new.
    other = digests.exact_duplicates(second, arrival="third", folder=f"{tmp_path}/other", **options)
    assert {r.doc_id: (r.keep_id, r.kept) for r in other.collect()} == {1: (10, False), 2: (2, False), 3: (2, False)}
    assert spark.table("index_b").count() == 3
    plan = spark.table("index_b").groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("lost", ["nothing", "the result", "the append"])
def test_a_failed_arrival_is_run_again(spark, tmp_path, monkeypatch, lost):
    """Whatever was lost, the second attempt keeps one row of each new text."""
    name = f"index_{uuid.uuid4().hex[:8]}"
    _dedup(spark, table(spark, [row(1, "old")]), tmp_path, name, "before")
    docs = table(spark, [row(5, "new"), row(5, "new"), row(6, "new"), row(7, "old"), row(8, None), row(None, "")])
    if lost != "nothing":
        with monkeypatch.context() as m:
            # The append comes before the result is written.
            write = digests.written
            if lost == "the append":
                m.setattr(digests, "add_arrival", None)
            else:
                m.setattr(digests, "written", lambda df, what, folder: 1 / 0 if what == "exact-duplicates" else write(df, what, folder))
            with pytest.raises((TypeError, ZeroDivisionError)):
                _dedup(spark, docs, tmp_path, name, "new")
    got = _dedup(spark, docs, tmp_path, name, "new")
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 1, False), (5, 3, False), (5, 3, False), (5, 3, True), (8, 2, False), (8, 2, True),
    ]
    digests.close_index(spark, name)
    assert not spark.catalog.tableExists(name)


def test_buckets_follow_the_expected_size():
    assert digests.bucket_count(0) == digests.bucket_count(1_000_000) == 64
    assert digests.bucket_count(10**10) == 2048


def test_query_meets_a_filled_index(spark, sf):
    """All documents in two arrivals equal one grouping of them all."""
    from flowguard.llm import queries

    rows = queries.op9_exact_dedup(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    groups = {}
    for d in docs:
        groups.setdefault(_norm(d.text), []).append(d.doc_id)
    want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want and len(rows) == len(docs)


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert _dedup(spark, empty, tmp_path, "index_d") == []
    assert simhash.near_duplicates(empty, folder=f"{tmp_path}/e").collect() == []
    assert simhash.drop_near_duplicates(empty, folder=f"{tmp_path}/f").columns == empty.columns


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, tmp_path):
    rows = awkward()
    got = simhash.near_duplicates(table(spark, rows), folder=f"{tmp_path}/s").collect()
    fps = [_fingerprint(r[1]) for r in rows]
    assert sorted(g.fingerprint for g in got) == sorted(f"{f:016x}" for f in fps)
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = _roots(range(len(fps)), linked)
    want = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            want[roots[i]] = min(want.get(roots[i], r[0]), r[0])
    expected = sorted((r[0] is None, r[0] or 0, want.get(roots[i], -1)) for i, r in enumerate(rows))
    assert sorted((g.doc_id is None, g.doc_id or 0, -1 if g.component_id is None else g.component_id) for g in got) == expected
    kept = simhash.drop_near_duplicates(table(spark, rows), folder=f"{tmp_path}/t")
    assert kept.columns == [f.name for f in SCHEMA]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want.values())


@pytest.mark.parametrize("cell_size, blocks", [(4_096, None), (64, 5), (64, 6), (4_096, 7), (64, 8)])
def test_links_lose_nothing(spark, cell_size, blocks):
    """Clusters of near fingerprints in hot blocks, whole cells and cut ones."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = set(map(int, r.integers(0, 1 << 62, 300, dtype=np.uint64)))
    for b in map(int, base):
        for _ in range(40):
            flips = r.choice(64, r.integers(1, 5), replace=False)
            fps.add(b ^ sum(1 << int(x) for x in flips))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.near_links(df, cell_size=cell_size, blocks=blocks)
    got = {x.node: x.root for x in components(links).collect()}
    arr = np.array(fps, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None]) <= 4
    roots = _roots(signed, [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert {f: got.get(f, f) for f in signed} == roots
    assert links.count() <= 70 * 200 * len(fps)


def test_number_of_blocks_bounds_the_cells():
    """Pairs compared grow with the input: a mean cell holds at most so many, and any near pair shares a key."""
    r = np.random.default_rng(6)
    for n in (10**3, 10**6, 10**8, 10**10, 10**13):
        blocks = simhash.blocks_for(n, 4, 4_096)
        masks = simhash.key_masks(blocks, 4)
        assert all(n / 2 ** m.bit_count() <= 2 * 4_096 for m in masks)
        for _ in range(50):
            flips = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
            assert any(not flips & m for m in masks)
    assert [simhash.blocks_for(n, 4, 4_096) for n in (0, 10**7, 10**9, 10**13)] == [5, 5, 6, 8]


def test_pairs_compared_grow_with_the_input():
    """With cells of two at most, each fingerprint has a bounded number of pairs; with the fewest blocks it hasn't."""

    def pairs(n, blocks):
        fps = np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64)
        sizes = [np.unique(fps & np.uint64(m), return_counts=True)[1] for m in simhash.key_masks(blocks, 4)]
        return sum(int((s * (s - 1) // 2).sum()) for s in sizes)

    for n in (2_000, 20_000, 200_000):
        blocks = simhash.blocks_for(n, 4, 2)
        assert pairs(n, blocks) <= 2 * n * len(simhash.key_masks(blocks, 4))
    assert pairs(200_000, 5) > 90 * pairs(20_000, 5)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
