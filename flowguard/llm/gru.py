"""A bidirectional gated recurrent network with attention pooling, in numpy.

A window of words is read in both directions. Each step's input joins a word
part and a character part: hashed vectors of the word and of its character
n-grams, and how much more often the word, and its most telling n-gram, occur
in one class of training texts. Attention weighs the steps of a window; the
pooled state gives a logit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice, pairwise

import numpy as np

#: Log-odds have fine buckets, as a collision hides a telling word; trained vectors share coarser ones.
BUCKETS = 1 << 20
SHARED = 32
VECTOR = 6
INPUT = 2 * (VECTOR + 1)
HIDDEN = 8
ATTENTION = 4
#: Character n-grams inside a word, and beginnings of a word up to this length.
INNER, BEGINNING = (3, 4), 10
#: A longer word (a text without spaces is one) is read as pieces of this length, this far apart.
LONGEST_WORD, PIECE_STRIDE = 64, 32
WINDOW, STRIDE = 24, 12
FOLDS = 4

_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(31))) * _MIX >> np.uint64(44)).astype(np.int32)


def pieces(words: Sequence[str]) -> Sequence[str]:
    """The words, each longer one as overlapping pieces, a step each."""
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    # The last piece is shorter, but longer than the overlap.
    overlap = LONGEST_WORD - PIECE_STRIDE
    return [w[at : at + LONGEST_WORD] for w in words for at in range(0, max(1, len(w) - overlap), PIECE_STRIDE)]


def word_features(words: Sequence[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket, and the buckets of its n-grams one behind the other with each word's start."""
    parts = [_features(words[at : at + block]) for at in range(0, len(words), block)]
    shift = np.cumsum([0, *[len(g) for _, g, _ in parts]])
    starts = [s + n for (_, _, s), n in zip(parts, shift[:-1], strict=True)]
    return np.concatenate([o for o, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), np.concatenate(starts)


def _features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial hashes over the code points of all words at once; < and > mark a word's ends.

    Words come from a vocabulary, in pieces; of a longer one only the ends would count.
    """
    marked = [f"<{w}>" if len(w) <= LONGEST_WORD else f"<{w[:32]}{w[-32:]}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters up to the word's end
    powers = _BASE ** np.arange(LONGEST_WORD + 2, dtype=np.uint64)
    own = _buckets(np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[owner]], starts), 1)
    owners, grams = [], []
    for n in INNER:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _BASE + codes[at + k]
        owners.append(owner[at])
        grams.append(_buckets(h, 100 + n))
    h, at = np.zeros(len(marked), np.uint64), np.arange(len(marked))
    for n in range(1, BEGINNING + 1):
        at = at[lengths[at] >= n]
        h[at] = h[at] * _BASE + codes[starts[at] + n - 1]
        if n > 1:  # every word has a gram: its mark and first character
            owners.append(at)
            grams.append(_buckets(h[at], 200 + n))
    who, flat = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(who, kind="stable")
    return own, flat[order], np.searchsorted(who[order], np.arange(len(marked)))


class Vocabulary:
    """Numbers words, long ones in pieces, from 1 in the order they come; 0 fills up windows."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def number(self, texts: Iterable[Sequence[str]]) -> tuple[list[np.ndarray], list[str]]:
        """Each text as numbers, and the words that are new."""
        numbers, known = self.numbers, len(self.numbers)
        put = numbers.setdefault
        ids = [np.array([put(w, len(numbers) + 1) for w in pieces(words)], np.int32) for words in texts]
        return ids, list(islice(numbers, known, None))


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text, STRIDE apart; the last one is filled up with 0."""
    n = len(ids)
    count = max(1, -(-(n - WINDOW) // STRIDE) + 1) if n else 0
    padded = np.zeros((count - 1) * STRIDE + WINDOW if count else 0, np.int32)
    padded[:n] = ids
    return padded[STRIDE * np.arange(count)[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 42) -> None:
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word_odds = np.zeros(BUCKETS, np.float32)
        self.char_odds = np.zeros(BUCKETS, np.float32)
        self.p = {
            "word": (0.1 * r.normal(size=(BUCKETS // SHARED, VECTOR))).astype(np.float32),
            "char": (0.1 * r.normal(size=(BUCKETS // SHARED, VECTOR))).astype(np.float32),
            "att_w": small(2 * HIDDEN, ATTENTION), "att_v": small(ATTENTION, 1)[:, 0],
            "out_w": small(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {
                f"{d}_x": small(INPUT, 3 * HIDDEN), f"{d}_h": small(HIDDEN, 3 * HIDDEN), f"{d}_b": np.zeros(3 * HIDDEN, np.float32)
            }
        self.shift = 0.0

    def odds(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Two columns by word: its own log-odds, and that of its most telling n-gram."""
        return np.stack([self.word_odds[own], np.maximum.reduceat(self.char_odds[grams], starts)], axis=1)

    def inputs(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Input vectors of words from their ``word_features`` and ``odds``; row 0 is the filling."""
        counts = np.diff(np.append(starts, len(grams)))
        x = np.zeros((len(own) + 1, INPUT), np.float32)
        x[1:, [0, VECTOR + 1]] = odds
        x[1:, 1 : VECTOR + 1] = self.p["word"][own // SHARED]
        x[1:, VECTOR + 2 :] = np.add.reduceat(self.p["char"][grams // SHARED], starts) / counts[:, None]
        return x

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Each word's share of the gates, by direction."""
        return {d: x @ self.p[f"{d}_x"] + self.p[f"{d}_b"] for d in "fb"}

    def _direction(self, d: str, gates: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, HIDDEN) of one direction."""
        n, u = len(ids), self.p[f"{d}_h"]
        h = np.zeros((n, HIDDEN), u.dtype)
        states = np.empty((WINDOW, n, HIDDEN), u.dtype)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            step = ids[:, t]
            x, hu = gates[step], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            there = (step > 0)[:, None]
            after = c + z * (h - c)
            if not there.all():
                after = np.where(there, after, h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], there))
            states[t] = h = after
        return states

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window of word numbers that index ``gates``."""
        states = [self._direction(d, gates[d], ids, None if keep is None else keep.setdefault(d, [])) for d in "fb"]
        h = np.concatenate(states, axis=2).transpose(1, 0, 2)
        a = np.tanh(h @ self.p["att_w"])
        e = np.where(ids > 0, a @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        weight = e / e.sum(axis=1, keepdims=True)
        pooled = (weight[:, None, :] @ h)[:, 0]
        if keep is not None:
            keep |= {"h": h, "a": a, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out_w"] + self.p["out_b"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Weighted mean cross-entropy, its gradients by parameter, and by input vector."""
        k: dict = {}
        logit = self.forward(self.gates(x), ids, k)
        share = weight / weight.sum()
        p = _sigmoid(logit)
        loss = float(-np.sum(share * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))))
        d_logit = ((p - target) * share).astype(x.dtype)
        g = {"out_w": k["pooled"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out_w"]
        d_h = k["weight"][:, :, None] * d_pooled[:, None, :]
        d_weight = (k["h"] @ d_pooled[:, :, None])[:, :, 0]
        d_e = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("nta,nt->a", k["a"], d_e)
        d_a = d_e[:, :, None] * self.p["att_v"] * (1 - k["a"] ** 2)
        g["att_w"] = np.einsum("nth,nta->ha", k["h"], d_a)
        d_h += d_a @ self.p["att_w"].T
        d_x = np.zeros_like(x)
        for j, d in enumerate("fb"):
            u = self.p[f"{d}_h"]
            d_gates = np.zeros((len(x), 3 * HIDDEN), x.dtype)
            g_u = np.zeros_like(u)
            back = np.zeros((len(ids), HIDDEN), x.dtype)
            for t, h, z, r, c, hc, there in reversed(k[d]):
                d_after = back + d_h[:, t, j * HIDDEN : (j + 1) * HIDDEN]
                d_new = np.where(there, d_after, 0)
                d_c = d_new * (1 - z) * (1 - c**2)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                step = np.concatenate([d_z, d_r, d_c], axis=1)
                np.add.at(d_gates, ids[:, t], step)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g_u += h.T @ d_hu
                back = np.where(there, d_new * z, d_after) + d_hu @ u.T
            g[f"{d}_h"], g[f"{d}_x"], g[f"{d}_b"] = g_u, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"{d}_x"].T
        return loss, g, d_x


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            size = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
            self.p[k] -= (size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each bucket, the log-odds of the class given that a text has it, less where few texts do.

    ``counts`` has the texts with each bucket, ``n`` all texts, each first of
    the other texts and then of the class.
    """
    rate = (counts + np.float32(0.5)) / (n + 1).astype(np.float32)[:, None]
    seen = counts.sum(axis=0)
    return (np.clip(np.log(rate[1] / rate[0]), -4, 4) * seen / (seen + 6)).astype(np.float32)


class Scorer:
    """Scores texts with a network; remembers the gates of words, of a bounded number of them."""

    MOST_WORDS = 200_000
    WORDS, BLOCK = 8_192, 2_048

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.words = Vocabulary()
        self.gates = {d: g[:1] for d, g in self._gates(["-"]).items()}

    def _gates(self, words: list[str]) -> dict[str, np.ndarray]:
        features = word_features(words)
        return self.net.gates(self.net.inputs(*features, self.net.odds(*features)))

    def _learn(self, new: list[str]) -> None:
        if new:
            # Pieces of long words have many n-grams: block by block, memory is bounded.
            more = [self._gates(new[at : at + self.WORDS]) for at in range(0, len(new), self.WORDS)]
            self.gates = {d: np.concatenate([g, *[m[d][1:] for m in more]]) for d, g in self.gates.items()}

    def logits(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        """The largest logit over all windows of each text; -inf for a text without words."""
        cut = [pieces(t) for t in texts]
        group = np.cumsum([len(t) for t in cut]) // self.MOST_WORDS
        parts = [self._logits(cut[a:b]) for a, b in pairwise([0, *np.flatnonzero(np.diff(group)) + 1, len(cut)])] if cut else []
        return np.concatenate([np.empty(0, np.float32), *parts])

    def _logits(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        if len(self.words.numbers) > self.MOST_WORDS:
            self._forget()
        ids, new = self.words.number(texts)
        self._learn(new)
        out = np.full(len(texts), -np.inf, np.float32)
        cut = [windows(t) for t in ids]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        if len(owner):
            flat = np.concatenate(cut)
            for at in range(0, len(flat), self.BLOCK):
                found = self.net.forward(self.gates, flat[at : at + self.BLOCK])
                np.maximum.at(out, owner[at : at + self.BLOCK], found)
        return out


def train(
    texts: Iterable[Sequence[str]], labels: Sequence[bool], *, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 42
) -> Network:
    """A network for texts given as words, each labelled as a whole.

    A text of the class is told by its strongest window: the network learns
    from that window of each such text, and from the strongest and one random
    window of each other text, as it sees them itself every other epoch (at
    first, by the log-odds alone). ``shift`` is then set so that the training
    texts are told apart best at a logit of 0.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, bool)
    if not y.any() or y.all():
        net.shift = np.inf if not y.any() else -np.inf
        return net
    ids, words = Vocabulary().number(texts)
    own, grams, starts = word_features(words)
    stops = np.append(starts[1:], len(grams))
    # A text's own words would tell its label: its log-odds come from the other folds.
    fold = rng.permutation(len(y)) % FOLDS
    word_counts, gram_counts = np.zeros((2, FOLDS, 2, BUCKETS), np.float32)
    n = np.zeros((FOLDS, 2), np.int64)
    for text, f, k in zip(ids, fold.tolist(), y.astype(int).tolist(), strict=True):
        different = np.unique(text) - 1
        word_counts[f, k, np.unique(own[different])] += 1
        gram_counts[f, k, np.unique(_of(different, grams, starts, stops))] += 1
        n[f, k] += 1
    odds = []
    for part in (*range(FOLDS), None):
        others = [f for f in range(FOLDS) if f != part]
        net.word_odds = log_odds(word_counts[others].sum(axis=0), n[others].sum(axis=0))
        net.char_odds = log_odds(gram_counts[others].sum(axis=0), n[others].sum(axis=0))
        odds.append(net.odds(own, grams, starts))
    del word_counts, gram_counts
    cut = [windows(t) for t in ids]
    have = np.array([i for i, c in enumerate(cut) if len(c)])
    # Word k in fold f is row f * len(words) + k of all inputs; 0 is the filling.
    flat = np.concatenate([np.where(cut[i] > 0, cut[i] + fold[i] * len(words), 0) for i in have])
    sizes = np.array([len(cut[i]) for i in have])
    first = np.cumsum(sizes) - sizes
    stacked = np.concatenate(odds[:FOLDS])

    def inputs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Input vectors for some windows, the windows as rows of them, and what the vectors are made of."""
        used, local = np.unique(numbers, return_inverse=True)
        rows = used[used > 0] - 1
        shown = rows % len(words)
        lengths = stops[shown] - starts[shown]
        these = _of(shown, grams, starts, stops)
        x = net.inputs(own[shown], these, np.cumsum(lengths) - lengths, stacked[rows])
        return x, (local + (used[0] > 0)).reshape(numbers.shape).astype(np.int32), (own[shown], these, lengths)

    def window_logits(block: int = 2_048) -> np.ndarray:
        found = []
        for at in range(0, len(flat), block):
            x, local, _ = inputs(flat[at : at + block])
            found.append(net.forward(net.gates(x), local))
        return np.concatenate(found)

    strength = np.append(-np.inf, stacked.sum(axis=1))[flat].max(axis=1)
    optimiser = Adam(net.p, rate)
    heavier = 0.5 * (~y).sum() / y.sum()
    for epoch in range(epochs):
        if epoch and epoch % 2 == 0:
            strength = window_logits()
        chosen, target = [], []
        for s, size, k in zip(first.tolist(), sizes.tolist(), y[have].tolist(), strict=True):
            best = s + int(np.argmax(strength[s : s + size]))
            picks = {best} if k else {best, s + int(rng.integers(size))}
            chosen += picks
            target += [float(k)] * len(picks)
        chosen, target = np.array(chosen), np.array(target, np.float32)
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, local, (of, these, lengths) = inputs(flat[chosen[part]])
            _, g, d_x = net.gradients(x, local, target[part], np.where(target[part] > 0, heavier, 1.0))
            g |= {"word": np.zeros_like(net.p["word"]), "char": np.zeros_like(net.p["char"])}
            np.add.at(g["word"], of // SHARED, d_x[1:, 1 : VECTOR + 1])
            np.add.at(g["char"], these // SHARED, np.repeat(d_x[1:, VECTOR + 2 :] / lengths[:, None], lengths, axis=0))
            optimiser.step(g)
    logits = np.full(len(y), -np.inf, np.float32)
    logits[have] = np.maximum.reduceat(window_logits(), first)
    net.shift = _threshold(logits, y)
    return net


def _of(words: np.ndarray, grams: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The n-grams of the given words, one word behind the other."""
    lengths = stops[words] - starts[words]
    first = np.repeat(starts[words] - (np.cumsum(lengths) - lengths), lengths)
    return grams[first + np.arange(lengths.sum())]


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that tells the classes apart with the highest F1, in the middle of its gap."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # Equal logits fall on one side.
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1
    k = int(np.argmax(f1))
    low = logits[order[k + 1]] if k + 1 < len(y) and np.isfinite(logits[order[k + 1]]) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)
