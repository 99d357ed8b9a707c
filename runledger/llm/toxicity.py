"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import labelled_sample, map_rows, own_names, record_batch, whole_text
from runledger.llm.learn import Adam, Numbering, gram_rows, sigmoid, word_rows

WINDOW = 24  # words a window holds
STRIDE = 12  # words from one window to the next; a passage of that many lies whole in some window
THRESHOLD = 0.5  # score from which a document is marked
UNFITTED = 0.25  # score of every document where nothing was learned
HIDDEN = 8  # units of each direction
WORD_DIMS, CHAR_DIMS = 3, 4  # learned input dimensions of words and of letter groups
INPUTS = 3 + WORD_DIMS + CHAR_DIMS
BUCKETS = 16_384
GRAMS = (3, 4, 5, 6)  # bytes of the letter groups
PRIOR = 3.0  # documents of either class added to every count
FOLDS = 5  # parts of the sample; the odds a text is trained with come from the other parts
COMMON = 5  # documents a bucket must stand in for its learned dimensions to move
TABLE_RATE = 0.5
TABLES = ("word", "char", "word_odds", "char_odds")
CLEAN_WEIGHT = 2.0  # long clean texts have many windows that could go wrong
TOGETHER = 4_096  # windows run at once
MAX_WORDS = 150_000  # distinct words a task remembers
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass
class GruNet:
    """Log odds and learned tables of words and letter groups; per direction input, recurrent and bias weights;
    attention; output."""

    params: dict[str, np.ndarray]
    fitted: bool = True  # False where the sample held no two classes to tell apart

    @classmethod
    def fresh(cls, seed: int = 3) -> GruNet:
        rng = np.random.default_rng(seed)
        n = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        p = {"word": n(BUCKETS, WORD_DIMS, by=0.02), "char": n(BUCKETS, CHAR_DIMS, by=0.02)}
        p |= {"word_odds": np.zeros(BUCKETS, np.float32), "char_odds": np.zeros(BUCKETS, np.float32)}
        for d in "fb":
            p |= {f"w{d}": n(INPUTS, 3 * HIDDEN), f"r{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p | {"a": n(2 * HIDDEN), "o": n(2 * HIDDEN), "d": np.zeros(1, np.float32)})

    def inputs(self, words: list[str], grams: list | None = None, odds: tuple | None = None) -> np.ndarray:
        """Input vector of each distinct word: its odds, the mean and the largest odds of its letter groups, and the
        learned rows of the word and, on average, of its letter groups."""
        if not words:
            return np.zeros((0, INPUTS), np.float32)
        p = self.params
        word_odds, char_odds = odds or (p["word_odds"], p["char_odds"])
        own = word_rows(words, BUCKETS)
        sums, counts, most = 0, 0, -np.inf
        table = np.concatenate([char_odds[:, None], p["char"]], 1)
        for valid, row, starts in grams or gram_rows(words, GRAMS, BUCKETS):
            values = table[row] * valid[:, None]
            sums = sums + np.add.reduceat(values, starts)
            counts = counts + np.add.reduceat(valid.astype(np.int64), starts)
            most = np.maximum(most, np.maximum.reduceat(np.where(valid, values[:, 0], -np.inf), starts))
        mean = sums / np.maximum(counts, 1)[:, None]
        most = np.where(np.isfinite(most), most, 0)
        return np.concatenate([word_odds[own][:, None], most[:, None], mean, p["word"][own]], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What a word adds to the gates of either direction; the last row stands for the place behind a text."""
        p = self.params
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}


def _step(p, d, gx, h):
    """One step of a gated recurrent unit: new state, and what the way back needs."""
    gh = h @ p[f"r{d}"][:, : 2 * HIDDEN]
    zr = 0.5 + 0.5 * np.tanh(0.5 * (gx[:, : 2 * HIDDEN] + gh))
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(gx[:, 2 * HIDDEN :] + (r * h) @ p[f"r{d}"][:, 2 * HIDDEN :])
    return h + z * (n - h), (z, r, n)


def run_windows(p: dict[str, np.ndarray], gates: dict[str, np.ndarray], ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logit of each window of word numbers; -1 is the place behind a text, which keeps the state and is not attended."""
    n, width = ids.shape
    mask = ids >= 0
    states = np.empty((width, n, 2 * HIDDEN), np.float32)
    for k, d in enumerate("fb"):
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            new, kept = _step(p, d, gates[d][ids[:, t]], h)
            new = np.where(mask[:, t, None], new, h)
            if trace is not None:
                trace[d, t] = (h, *kept)
            states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h = new
    e = np.where(mask.T, states @ p["a"], np.float32(-1e9))
    e = np.exp(e - e.max(0))
    att = e / e.sum(0)
    pooled = (states * att[:, :, None]).sum(0)
    if trace is not None:
        trace["states"], trace["att"], trace["pooled"], trace["mask"] = states, att, pooled, mask
    return pooled @ p["o"] + p["d"][0]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, trace: dict, dz: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights and of the input vectors ``x`` (row -1: behind a text)."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in TABLES}
    states, att, mask = trace["states"], trace["att"], trace["mask"]
    g["o"], g["d"] = trace["pooled"].T @ dz, np.array([dz.sum()], np.float32)
    dpool = dz[:, None] * p["o"]
    datt = (states * dpool).sum(2)
    de = att * (datt - (att * datt).sum(0))
    de = np.where(mask.T, de, 0)
    g["a"] = np.einsum("tn,tnh->h", de, states)
    dstates = att[:, :, None] * dpool + de[:, :, None] * p["a"]
    dx = np.zeros_like(x)
    width = ids.shape[1]
    for k, d in enumerate("fb"):
        r_zr, r_n = p[f"r{d}"][:, : 2 * HIDDEN], p[f"r{d}"][:, 2 * HIDDEN :]
        dh = np.zeros((len(ids), HIDDEN), np.float32)
        for t in range(width - 1, -1, -1) if d == "f" else range(width):
            h, z, r, n = trace[d, t]
            live = mask[:, t, None]
            dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            do = np.where(live, dh, 0)
            dn = do * z * (1 - n * n)
            drh = dn @ r_n.T
            dzr = np.concatenate([do * (n - h) * z * (1 - z), drh * h * r * (1 - r)], 1)
            dgate = np.concatenate([dzr, dn], 1)
            g[f"r{d}"][:, : 2 * HIDDEN] += h.T @ dzr
            g[f"r{d}"][:, 2 * HIDDEN :] += (r * h).T @ dn
            g[f"c{d}"] += dgate.sum(0)
            g[f"w{d}"] += x[ids[:, t]].T @ dgate
            np.add.at(dx, ids[:, t], dgate @ p[f"w{d}"].T)
            dh = np.where(live, do * (1 - z) + drh * r + dzr @ r_zr.T, dh)
    return g, dx


def windows(numbers: np.ndarray) -> np.ndarray:
    """Windows that overlap by half, over the whole text; the last one reaches the end, a text without words has one empty window."""
    if len(numbers) <= WINDOW:
        return np.concatenate([numbers, np.full(WINDOW - len(numbers), -1, numbers.dtype)])[None, :]
    starts = np.arange(0, len(numbers) - WINDOW + STRIDE, STRIDE)
    starts[-1] = len(numbers) - WINDOW
    return numbers[starts[:, None] + np.arange(WINDOW)]


def _odds(rows_of: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of a bucket in toxic and in other documents, from document counts smoothed by ``PRIOR`` documents."""
    seen = np.zeros((2, BUCKETS), np.float64)
    for rows, label in zip(rows_of, y, strict=True):
        seen[label][rows] += 1
    seen *= len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1)[:, None]
    return np.log((seen[1] + PRIOR) / (seen[0] + PRIOR)).astype(np.float32)


def train(rows: list[tuple[str, int]], steps: int = 270, batch: int = 32, rate: float = 0.02, seed: int = 3) -> GruNet:
    """Fit on labelled texts: a text is as toxic as its worst window, and the gradient goes through that window.

    Words and letter groups enter with their log odds. A text is trained with odds counted on the other parts of the
    sample, so that the network learns what they are worth on texts not counted; scores use the odds of the
    whole sample. A small sample is gone through more often, for about ``steps`` steps. Without both classes every score is
    ``UNFITTED``, and nothing is marked.
    """
    net = GruNet.fresh(seed)
    p = net.params
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        p["o"][:] = 0
        net.fitted = False
        return net
    numbering = Numbering()
    numbers = [np.array([numbering[w] for w in words_of(t)], np.int64) for t, _ in rows]
    vocabulary = list(numbering)
    grams = list(gram_rows(vocabulary, GRAMS, BUCKETS))
    own = word_rows(vocabulary, BUCKETS)
    of = np.concatenate([np.repeat(np.arange(len(s)), np.diff(np.append(s, len(r))))[v] for v, r, s in grams])
    flat = np.concatenate([r[v] for v, r, _ in grams])
    order = np.argsort(of, kind="stable")
    of, flat = of[order], flat[order]
    first = np.searchsorted(of, np.arange(len(vocabulary) + 1))
    sizes = np.maximum(np.diff(first), 1)
    distinct = [np.unique(n) for n in numbers]
    empty = np.zeros(0, np.int64)
    word_sets = [np.unique(own[d]) for d in distinct]
    char_sets = [np.unique(np.concatenate([flat[first[i] : first[i + 1]] for i in d])) if len(d) else empty for d in distinct]
    common = {"word": np.zeros(BUCKETS), "char": np.zeros(BUCKETS)}
    for name, sets in (("word", word_sets), ("char", char_sets)):
        for rows_ in sets:
            common[name][rows_] += 1
    fold = np.random.default_rng(seed).integers(0, FOLDS, len(rows))
    pick = lambda sets, where: [sets[i] for i in np.flatnonzero(where)]
    odds = [tuple(_odds(pick(sets, fold != f), y[fold != f]) for sets in (word_sets, char_sets)) for f in range(FOLDS)]
    p["word_odds"], p["char_odds"] = _odds(word_sets, y), _odds(char_sets, y)
    rng = np.random.default_rng(seed)
    opt = Adam({k: v for k, v in p.items() if k not in TABLES}, rate)
    cut = [windows(n) for n in numbers]
    share = np.bincount(y, minlength=2) / len(y)
    epochs = min(24, -(-steps * batch // len(rows)))
    for epoch in range(epochs):
        opt.rate = rate * (1 - epoch / epochs)
        inputs = [np.concatenate([net.inputs(vocabulary, grams, o), np.zeros((1, INPUTS), np.float32)]) for o in odds]
        dx_sum = np.zeros_like(inputs[0])
        batches = []
        for f in range(FOLDS):
            members = rng.permutation(np.flatnonzero(fold == f))
            batches += [(f, members[a : a + batch]) for a in range(0, len(members), batch)]
        for b in rng.permutation(len(batches)):
            f, some = batches[b]
            x = inputs[f]
            gates = {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
            ids = np.concatenate([cut[i] for i in some])
            ends = np.cumsum([len(cut[i]) for i in some])
            z = run_windows(p, gates, ids)
            worst = np.array([a + z[a:b_].argmax() for a, b_ in zip(ends - [len(cut[i]) for i in some], ends, strict=True)])
            trace: dict = {}
            z = run_windows(p, gates, ids[worst], trace)
            t = y[some]
            dz = ((sigmoid(z) - t) * np.where(t == 0, CLEAN_WEIGHT, 1.0) / (2 * share[t] * len(some))).astype(np.float32)
            g, dx = gradients(p, x, ids[worst], trace, dz)
            opt.step(g)
            dx_sum += dx
        dx_sum = dx_sum[:-1]
        chars = (dx_sum[:, 3 : 3 + CHAR_DIMS] / sizes[:, None])[of]
        for name, rows_, grad in (("word", own, dx_sum[:, 3 + CHAR_DIMS :]), ("char", flat, chars)):
            step = np.zeros_like(p[name])
            np.add.at(step, rows_, grad)
            p[name] -= TABLE_RATE * step * (common[name] >= COMMON)[:, None]
    return net


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 700, max_chars: int = 4_000
) -> GruNet:
    """Train on at most ``per_class`` texts of each class and ``max_chars`` of each text: the bound on the sample."""
    return train(labelled_sample(docs, labels, label, learn, per_class, max_chars))


def predicted(threshold: float = THRESHOLD, score: str = "score") -> Column:
    """Whether the score reaches the threshold."""
    return F.col(score) >= threshold


class Scorer:
    """Scores texts with a network; remembers the gate inputs of a bounded number of words."""

    def __init__(self, net: GruNet):
        self.net, self.numbering = net, Numbering()
        self.gates = net.projected(np.zeros((0, INPUTS), np.float32))

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.numbering) > MAX_WORDS:
            self.__init__(self.net)
        numbers = [np.array(list(map(self.numbering.__getitem__, words_of(t))), np.int64) for t in texts]
        known = len(self.gates["f"]) - 1
        if len(self.numbering) > known:
            new = list(self.numbering)[known:]
            more = self.net.projected(self.net.inputs(new))
            self.gates = {d: np.concatenate([self.gates[d][:-1], more[d]]) for d in "fb"}
        cut = [windows(n) for n in numbers]
        ids = np.concatenate(cut)
        z = np.concatenate([run_windows(self.net.params, self.gates, ids[a : a + TOGETHER]) for a in range(0, len(ids), TOGETHER)])
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        return np.maximum.reduceat(z, starts)


def score(docs: DataFrame, net: GruNet, text: str = "text", out: str = "score", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability that the whole text is toxic (its worst window), replacing a column named ``out``.

    ``carry`` names the columns kept, all by default.

    A null text is an empty one; a text without words is one empty window. Rows are worked through in pieces of
    some 200,000 characters and their windows a few thousand at a time, however long a text is. The network
    (under 1 MB) is broadcast.
    """
    names = [c for c in carry or docs.columns if c != out]
    if not net.fitted:
        return docs.select(*names, F.lit(UNFITTED).alias(out))
    [body] = own_names(docs, "_whole_text")
    rows = docs.select(*names, whole_text(text).alias(body))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` double"
    shared = docs.sparkSession.sparkContext.broadcast(net.params)

    def fn():
        scorer = Scorer(GruNet(shared.value))

        def step(c):
            sizes = np.cumsum([len(t) for t in c[body].to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // 200_000)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    z = scorer.logits(c[body][a:b].to_pylist())
                    yield record_batch(**{k: c[k][a:b] for k in names}, **{out: pa.array(sigmoid(z.astype(np.float64)), pa.float64())})

        return step

    return map_rows(rows, schema, fn)
