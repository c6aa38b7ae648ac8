"""Budgets, boundaries and batches against exhaustive search."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from flowguard.llm import mixing, packing

from .cases import SCHEMA, awkward, row, table


def test_fit_budget_is_exact():
    r = random.Random(2)
    for _ in range(200):
        sizes = sorted(r.sample(range(1, 30), r.randint(1, 4)))
        counts = [r.randint(1, 4) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts, strict=True))
        budget = r.randint(0, total)
        take = mixing.fit_budget(np.array(sizes), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = int((take * sizes).sum())
        assert got <= budget
        knapsack = mixing._knapsack(np.array(sizes), np.array(counts), budget)
        best = max(
            x for x in (sum(s * n for s, n in zip(sizes, p, strict=True)) for p in itertools.product(*[range(c + 1) for c in counts]))
            if x <= budget
        )
        assert int((knapsack * sizes).sum()) == best


def _targets(sizes, weights, share=1.5, most=2):
    """The sharing as told: give by weight, cap, share the excess again."""
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weights[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark, tmp_path):
    r = random.Random(9)
    rows = awkward() + [row(5_000 + i, "w " * r.choice([3, 5, 8, 400]), r.choice(["a", "zz", "Z"])) for i in range(900)]
    rows += [row(7_000 + i, "w w w w", "a") for i in range(1_500)]  # one size of one source in slices
    got = mixing.mix(table(spark, rows), folder=f"{tmp_path}/m").collect()
    assert len(got) == len(rows)
    source_of, words = defaultdict(set), Counter()
    for x in rows:
        words[x[3]] += len((x[1] or "").split())
        source_of[x[0]].add(x[3])
    order = sorted(words, key=lambda s: (s is None, s or ""))
    targets = _targets(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    longest = max(len((x[1] or "").split()) for x in rows)
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and g.taken == g.copies * g.size
        if len(source_of[g.doc_id]) == 1:
            (s,) = source_of[g.doc_id]
            assert g.source_size == words[s] and abs(g.target - targets[s]) < 1e-6
            taken[s] += g.taken
    for s, n in taken.items():
        assert abs(n - targets[s]) <= longest
    assert abs(taken["Z"] - targets["Z"]) <= 2
    again = mixing.mix(table(spark, rows, 5), folder=f"{tmp_path}/n").collect()
    assert Counter((g.doc_id, g.taken) for g in again) == Counter((g.doc_id, g.taken) for g in got)
    copies = mixing.mixed(table(spark, rows), folder=f"{tmp_path}/o")
    assert copies.columns == [f.name for f in SCHEMA]
    assert Counter(x.doc_id for x in copies.collect()) == Counter(
        {k: n for k, n in sum((Counter({g.doc_id: g.copies}) for g in got), Counter()).items() if n}
    )


def test_mix_of_nothing(spark, tmp_path):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), folder=f"{tmp_path}/p").collect() == []
    blank = mixing.mix(table(spark, [row(1, None), row(2, "")]), folder=f"{tmp_path}/q").collect()
    assert [(g.size, g.target, g.taken) for g in blank] == [(0, 0.0, 0)] * 2


def test_bucket_lengths_are_best():
    r = random.Random(4)
    for _ in range(100):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 8))))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        k = r.randint(1, 4)
        ends, padding = packing.bucket_lengths(lengths, counts, k)
        pad = lambda e: int(sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, counts, strict=True)))  # noqa: E731, B023
        best = min(
            pad((*some, int(lengths[-1])))
            for m in range(min(k, len(lengths))) for some in itertools.combinations(map(int, lengths[:-1]), m)
        )
        assert padding == best == pad(ends) and len(ends) <= k


def test_pack(spark, tmp_path):
    rows = awkward() + [row(5_000 + i, "w " * (1 + i % 7)) for i in range(2_500)]
    got = packing.pack(table(spark, rows), longest=1_000, budget=2_000, buckets=5, folder=f"{tmp_path}/a").collect()
    words = Counter()
    for x in rows:
        words[x[0]] += len((x[1] or "").split())
    packed, batches = Counter(), defaultdict(list)
    for g in got:
        packed[g.doc_id] += g.length
        assert (g.batch is None) == (g.length == 0) and g.length <= 1_000
        if g.length:
            assert g.length <= g.bucket_length
            batches[g.bucket_length, g.batch].append(g.slot)
    assert +packed == +words and {g.doc_id for g in got} == set(words)
    assert sum(g.piece == 0 for g in got) == len(rows)
    assert len({b for b, _ in batches}) <= 5
    last = {b: max(n for x, n in batches if x == b) for b, _ in batches}
    for (bucket, n), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) * bucket <= 2_000 and (n == last[bucket] or len(slots) == 2_000 // bucket)
    assert packing.pack(spark.createDataFrame([], SCHEMA), folder=f"{tmp_path}/b").collect() == []
