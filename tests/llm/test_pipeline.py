"""The pipeline's stages on their own inputs, each against brute force over the operator before it."""

from collections import Counter

import pytest

import corpus_pipeline
from flowguard.llm import quality, simhash

from .cases import SCHEMA, awkward, row, table
from .test_duplicates import _fingerprint, _roots
from .test_lines import _brute

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(path := f"{tmp_path}/{len(after)}")
        before, docs = docs, spark.read.parquet(path)
        after[name] = (before.collect(), docs.collect())
        assert docs.columns == columns or name == "packing"

    old, new = after["quality rules"]
    kept = {r.doc_id for r in new}
    for r in old:
        if quality.fails_limits(quality.statistics(r.text or "")[0]):
            assert r.doc_id not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.doc_id for r in old if labels.get(r.doc_id) == 1 and not quality.fails_limits(quality.statistics(r.text)[0])]
    assert len(kept & set(good)) >= 0.95 * len(good)
    # What the forest judges is what the stage keeps.
    forest = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept == {r.doc_id for r, k in zip(old, quality.judge([r.text or "" for r in old], forest)[3], strict=True) if k}

    old, new = after["line dedup"]
    rows = [(r.doc_id, r.text) for r in old]
    want = _brute(rows)
    assert {r.doc_id: r.text for r in new} == {i: want[i, t] for i, t in rows}

    old, new = after["SimHash near-dedup"]
    fps = {r.doc_id: _fingerprint(r.text) for r in old}
    ids = sorted(fps)
    roots = _roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS])
    assert sorted(r.doc_id for r in new) == sorted(i for i in ids if roots[i] == i)

    old, new = after["mixing sources to target weights"]
    copies = Counter(r.doc_id for r in new)
    assert set(copies) <= {r.doc_id for r in old} and max(copies.values()) <= 2
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(new) - 1.5 * words(old)) <= 0.03 * words(old) + 20

    old, new = after["packing"]
    packed = Counter()
    for r in new:
        packed[r.doc_id] += r.length
    assert +packed == +sum((Counter({r.doc_id: len(r.text.split())}) for r in old), Counter())


def test_quality_stage_drops_what_only_the_forest_finds(spark):
    """On the middle tables: the smallest have six such rows, too few to calibrate on."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passing = [r.doc_id for r in docs.collect() if not quality.fails_limits(quality.statistics(r.text or "")[0])]
    kept = {r.doc_id for r in STAGES["quality rules"](spark, docs, sf).collect()}
    bad, good = [[i for i in passing if labels.get(i) == q] for q in (0, 1)]
    assert len(bad) > 20 and len(kept & set(bad)) <= 0.1 * len(bad)
    assert len(kept & set(good)) >= 0.99 * len(good)


def test_run_gives_the_last_stage(spark, sf):
    assert {"bucket_length", "batch", "slot"} <= set(corpus_pipeline.run(spark, sf).columns)


def many_kinds():
    """The awkward rows and good ones, some of them repeated, with lines that others share."""
    good = [
        row(4000 + i, "\n".join(" ".join(f"word{(i * 7 + j * 13 + k) % 97}x{j}{k}" for k in range(12)) for j in range(6)), "zz")
        for i in range(12)
    ]
    shared = [row(4100 + i, f"a line that several documents share with others\n{good[i][1]}", None) for i in range(4)]
    return awkward() + good + shared + [good[0], good[0], row(None, good[1][1])]


def by_id(rows):
    return sorted(((r.doc_id, r.text, r.source) for r in rows), key=repr)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_no_rows(spark, sf, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = STAGES[name](spark, empty, sf)
    assert out.collect() == [] and (out.columns == empty.columns or name == "packing")


def test_quality_stage_on_all_kinds(spark, sf):
    rows = many_kinds()
    docs = table(spark, rows)
    out = STAGES["quality rules"](spark, docs, sf)
    assert out.columns == docs.columns
    forest = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality.judge([r[1] or "" for r in rows], forest)[3]
    assert by_id(out.collect()) == sorted(((r[0], r[1], r[3]) for r, k in zip(rows, kept, strict=True) if k), key=repr)
    assert kept.any() and not kept.all()


def test_line_stage_on_all_kinds(spark, sf):
    rows = many_kinds()
    out = STAGES["line dedup"](spark, table(spark, rows), sf)
    assert out.columns == [f.name for f in SCHEMA]
    want = _brute(rows)
    # A text that loses nothing stays as it is, NULL included.
    left = [(r[0], r[1] if want[r[0], r[1] or ""] == (r[1] or "") else want[r[0], r[1] or ""], r[3]) for r in rows]
    assert by_id(out.collect()) == sorted(left, key=repr)


def test_near_dedup_stage_on_all_kinds(spark, sf):
    rows = many_kinds()
    out = STAGES["SimHash near-dedup"](spark, table(spark, rows), sf)
    assert out.columns == [f.name for f in SCHEMA]
    fps = [_fingerprint(r[1]) for r in rows]
    roots = _roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(least.values())
    assert len(got) == len(set(roots.values()))


def test_mix_stage_on_all_kinds(spark, sf):
    rows = many_kinds()
    out = STAGES["mixing sources to target weights"](spark, table(spark, rows), sf)
    assert out.columns == [f.name for f in SCHEMA]
    words = lambda t: len((t or "").split())
    there, got = Counter((r[0], r[1]) for r in rows), Counter((r.doc_id, r.text) for r in out.collect())
    assert all(words(t) and n <= 2 * there[i, t] for (i, t), n in got.items())
    total = sum(words(r[1]) for r in rows)
    assert 0 < sum(words(t) * n for (_, t), n in got.items()) <= 2 * total


def test_packing_stage_on_all_kinds(spark, sf):
    rows = many_kinds()
    packed = STAGES["packing"](spark, table(spark, rows), sf).collect()
    lengths, want = Counter(), Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    assert +lengths == +want and {r.doc_id for r in packed} == {r[0] for r in rows}
    assert all((r.batch is None) == (r.length == 0) for r in packed)
    places = [(r.bucket_length, r.batch, r.slot) for r in packed if r.length]
    assert len(places) == len(set(places))
