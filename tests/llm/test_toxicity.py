"""The network against numeric gradients, windows, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from flowguard.llm import gru, toxicity

from .cases import SCHEMA, awkward, row, table


def test_gradients():
    net = gru.Network(1)
    words = "a bc def gh i jkl m n o p".split()
    (ids,), new = gru.Vocabulary().number([words * 5])
    cut = gru.windows(ids)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features = gru.word_features(new)
    x = net.inputs(*features, net.odds(*features)).astype(np.float64)
    target, weight = np.array([1.0, 0, 1, 0][: len(cut)]), np.array([1.0, 2, 1, 3][: len(cut)])
    _, g, d_x = net.gradients(x, cut, target, weight)
    step = 1e-4

    def slope(array, at):
        array[at] += step
        up = net.gradients(x, cut, target, weight)[0]
        array[at] -= 2 * step
        down = net.gradients(x, cut, target, weight)[0]
        array[at] += step
        return (up - down) / (2 * step)

    for name in ("f_x", "f_h", "f_b", "b_x", "b_h", "b_b", "att_w", "att_v", "out_w", "out_b"):
        at = tuple(n // 2 for n in net.p[name].shape)
        assert abs(slope(net.p[name], at) - g[name][at]) < 1e-6, name
    assert abs(slope(x, (3, 2)) - d_x[3, 2]) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 12, 24, 25, 36, 37, 100])
def test_windows_cover_all_words(n):
    cut = gru.windows(np.arange(1, n + 1, dtype=np.int32))
    assert set(cut.ravel()) - {0} == set(range(1, n + 1))
    assert all(np.array_equal(w[w > 0], np.arange(w[0], w[0] + (w > 0).sum())) for w in cut)
    assert [w[0] for w in cut] == [1 + gru.STRIDE * i for i in range(len(cut))]


def test_features_are_those_of_the_word():
    alone = [gru.word_features([w]) for w in ("ab", "é", "abcdefghijklmnop")]
    own, grams, starts = gru.word_features(["ab", "é", "abcdefghijklmnop"])
    parts = np.split(grams, starts[1:])
    for k, (o, g, _) in enumerate(alone):
        assert own[k] == o[0] and sorted(parts[k]) == sorted(g)
    assert gru.word_features(["x" * 10_000])[1].size < 200


@pytest.mark.parametrize("n", [1, 64, 65, 96, 97, 128, 1_000])
def test_pieces_hold_all_of_a_word(n):
    word = "".join(chr(0x4E00 + i) for i in range(n))
    cut = gru.pieces(["ab", word])
    assert cut[0] == "ab" and cut[1] + "".join(p[gru.LONGEST_WORD - gru.PIECE_STRIDE :] for p in cut[2:]) == word
    assert max(map(len, cut)) <= gru.LONGEST_WORD
    assert gru.Vocabulary().number([["ab", word]])[1] == list(cut)


def _cases(n):
    r = random.Random(4)
    bad = ["vorgle", "strint", "mubble"]
    plain = ["".join(r.choice("aeioust") for _ in range(r.randint(2, 6))) for _ in range(200)]
    out = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 90))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "r", "s"])
        out.append((10_000 + i, " ".join(words), int(i % 3 == 0)))
    return out


def test_held_out_accuracy(spark):
    cases = _cases(900)
    docs = table(spark, [row(i, t) for i, t, _ in cases] + awkward())
    labels = spark.createDataFrame([(i, 1, k) for i, _, k in cases] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    got = toxicity.score(docs, net).collect()
    assert len(got) == docs.count()
    truth = {i: k for i, _, k in cases}
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == (g.score >= 0.7)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1)
    held = [(g.predicted, truth[g.doc_id]) for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 200 and np.mean([p == t for p, t in held]) > 0.95
    assert {g.score for g in got if g.doc_id in (2000, 2001, 2002)} == {0.0}
    # A word at the end of a long text is seen.
    texts = [["aei"] * 3_000, ["aei"] * 3_000 + ["vorgles"]]
    low, high = gru.Scorer(net).logits(texts)
    assert high > low
    # So is one in the middle of a text without spaces.
    filling = "aei\u3000" * 300
    low, high = gru.Scorer(net).logits([[filling * 2], [filling + "vorgles\u3000" + filling]])
    assert high > low


def test_nothing_to_learn_from(spark):
    docs = table(spark, awkward())
    net = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {g.score for g in toxicity.score(docs, net).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), net).collect() == []
