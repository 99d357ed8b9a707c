"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from runledger.llm.common import class_sample, map_rows, own_names, record_batch, whole_text
from runledger.llm.learn import Numbering, gram_rows, gram_sums, word_rows

BUCKETS = 32_768
GRAMS = (2, 3, 4, 5)  # bytes of the groups in <word>: those that hold < or > are its affixes
BLOCK = 16  # words of a block of the chain
SPAN = 32  # words of a training sequence
PRIOR = 0.5  # words of each language added to every lexicon count
TOGETHER = 100_000  # words labelled at once, where texts allow
MAX_WORDS = 150_000  # distinct words a task remembers
LONG = 500_000  # characters of a piece of a longer text
WORDS, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; number signs such as halves, superscripts and Roman or circled numerals are none."""
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for is_letter, run in groupby(w, str.isalpha) if is_letter]


def pieces_of(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that cut no word."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


@dataclass
class Crf:
    """Labels, feature weights (letter groups, lexicon; a column per label) and learned transitions."""

    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each distinct word."""
        sums, counts = gram_sums(words, GRAMS, self.grams)
        return sums / np.maximum(counts, 1)[:, None] + self.lexicon[word_rows(words, BUCKETS)]


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray,
    entry: np.ndarray | None = None, leave: np.ndarray | None = None, transfer: bool = False,
) -> np.ndarray:
    """Exact marginals of every word of many chains laid end to end.

    A single chain that is a piece of a longer one has ``entry``, the message that reaches it from before, and ``leave``, that from
    behind; ``transfer`` gives, instead of marginals, the matrix by which it carries messages on.

    Chains are cut into blocks of ``BLOCK`` words. The product of a block's transfer matrices carries messages
    across it, so the steps inside blocks run over all blocks at once and only one step per block runs along
    a chain. Every message is scaled to sum to one, so no length underflows.
    """
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k))
    lengths = lengths[lengths > 0]
    e = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(moves - moves.max())
    per = -(-lengths // BLOCK)
    chain_start = np.cumsum(lengths) - lengths
    block_of = np.cumsum(per) - per  # first block of each chain
    nb = int(per.sum())
    chain = np.repeat(np.arange(len(lengths)), per)
    at = np.arange(nb) - block_of[chain]  # place of the block in its chain
    offset = chain_start[chain] + at * BLOCK
    size = np.minimum(BLOCK, lengths[chain] - at * BLOCK)
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    place = np.minimum(offset[:, None] + np.arange(BLOCK), len(e) - 1)
    eb = np.where(inside[:, :, None], e[place], 1.0)
    first = (at == 0) & (entry is None)
    scaled = lambda m, axes: m / m.sum(axes, keepdims=True)

    # transfer matrix of each block, scaled now and then; nothing precedes the first word of a chain
    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        moved = (m.reshape(-1, k) @ a).reshape(nb, k, k)
        if t == 0:
            moved[first] = 1.0
        moved *= eb[:, t, None, :]
        m = np.where(inside[:, t, None, None], scaled(moved, (1, 2)) if t % 4 == 3 else moved, m)

    if transfer:
        product = np.eye(k)
        for block in m:
            product = scaled(product @ block, (0, 1))
        return product

    # messages at the edges of blocks, chain by chain
    before, after = np.full((nb, k), 1.0 / k), np.full((nb, k), 1.0 / k)
    if entry is not None:
        before[0] = entry
    if leave is not None:
        after[-1] = leave
    by_length = np.argsort(-per, kind="stable")
    active = lambda step: by_length[: int(np.searchsorted(-per[by_length], -step))]  # noqa: E731  chains of more blocks
    for step in range(1, int(per.max())):
        b = block_of[active(step)] + step
        before[b] = scaled(np.einsum("nj,njk->nk", before[b - 1], m[b - 1]), 1)
    for step in range(int(per.max()) - 2, -1, -1):
        b = block_of[active(step + 1)] + step
        after[b] = scaled(np.einsum("njk,nk->nj", m[b + 1], after[b + 1]), 1)

    alpha, beta = np.empty((BLOCK, nb, k)), np.empty((BLOCK, nb, k))
    x = before
    for t in range(BLOCK):
        moved = x @ a
        if t == 0:
            moved[first] = 1.0
        x = np.where(inside[:, t, None], scaled(moved * eb[:, t], 1), x)
        alpha[t] = x
    y = after
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = y
        y = np.where(inside[:, t, None], scaled((y * eb[:, t]) @ a.T, 1), y)
    p = scaled(alpha * beta, 2)
    out = np.empty_like(e)
    out[place[inside]] = p.transpose(1, 0, 2)[inside]
    return out


def _pair_marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of each transition, from word marginals and the chain's conditional structure."""
    k = scores.shape[1]
    total = np.zeros((k, k))
    a = np.exp(moves - moves.max())
    e = np.exp(scores - scores.max(1, keepdims=True))
    ends = np.cumsum(lengths)
    n = int(lengths[0])  # training sequences are equally long
    e, p = e.reshape(len(lengths), n, k), p.reshape(len(lengths), n, k)
    assert ends[-1] == e.shape[0] * n
    alpha = [e[:, 0] / e[:, 0].sum(1, keepdims=True)]
    for t in range(1, n):
        x = (alpha[-1] @ a) * e[:, t]
        alpha.append(x / x.sum(1, keepdims=True))
    for t in range(1, n):
        # p(i, j) = p_t(j) * alpha_{t-1}(i) a(i, j) / sum_i of the same
        reach = alpha[t - 1][:, :, None] * a[None]
        total += (reach / reach.sum(1, keepdims=True) * p[:, t, None, :]).sum(0)
    return total


def train(rows: list[tuple[str, str]], steps: int = 150, batch: int = 64, rate: float = 0.5, seed: int = 5) -> Crf:
    """Fit on texts of one language each; half of the training sequences are spliced from two texts, so that
    the transitions learn what switching looks like.

    The lexicon starts at the log share of each language in the sample's counts of a word. Rows without words teach
    nothing. With no language every text is unknown.
    """
    labels = sorted({lang for _, lang in rows})
    texts = [(words_of(t), labels.index(lang)) for t, lang in rows]
    texts = [(w, y) for w, y in texts if w]
    k = len(labels)
    if not texts:
        return Crf(labels, np.zeros((BUCKETS, max(k, 1))), np.zeros((BUCKETS, max(k, 1))), np.zeros((max(k, 1), max(k, 1))))
    numbering = Numbering()
    numbers = [np.array([numbering[w] for w in words], np.int64) for words, _ in texts]
    y = np.array([label for _, label in texts])
    vocabulary = list(numbering)
    lex = word_rows(vocabulary, BUCKETS)
    counts = np.full((BUCKETS, k), PRIOR)
    for ids, label in zip(numbers, y, strict=True):
        np.add.at(counts[:, label], lex[ids], 1.0)
    shares = counts / counts.sum(0)
    model = Crf(labels, np.zeros((BUCKETS, k)), np.log(shares / shares.mean(1, keepdims=True)), np.eye(k))
    spans = list(gram_rows(vocabulary, GRAMS, BUCKETS))
    gram = np.concatenate([row[valid] for valid, row, _ in spans])
    of = np.concatenate(
        [np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))[valid] for valid, row, starts in spans]
    )
    order = np.argsort(of, kind="stable")
    gram, of = gram[order], of[order]
    first = np.searchsorted(of, np.arange(len(vocabulary) + 1))
    n_grams = np.maximum(np.diff(first), 1)
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(y == label) for label in range(k)]
    by_label = [b for b in by_label if len(b)]

    def piece(n: int) -> tuple[np.ndarray, np.ndarray]:
        i = rng.choice(by_label[rng.integers(len(by_label))])
        start = rng.integers(max(1, len(numbers[i]) - n + 1))
        ids = np.resize(numbers[i][start : start + n], n)
        return ids, np.full(n, y[i])

    squares = [np.full_like(w, 1e-3) for w in (model.grams, model.lexicon, model.moves)]
    lengths = np.full(batch, SPAN)
    for _ in range(steps):
        ids, want = [], []
        for b in range(batch):
            cut = int(rng.integers(4, SPAN - 3)) if b % 2 else SPAN
            for n in (cut, SPAN - cut):
                if n:
                    i, w = piece(n)
                    ids.append(i)
                    want.append(w)
        ids, want = np.concatenate(ids), np.concatenate(want)
        used, back = np.unique(ids, return_inverse=True)
        sums = np.zeros((len(used), k))
        rows_of = np.concatenate([np.arange(first[u], first[u + 1]) for u in used])
        which = np.repeat(np.arange(len(used)), first[used + 1] - first[used])
        np.add.at(sums, which, model.grams[gram[rows_of]])
        scores = (sums / n_grams[used][:, None] + model.lexicon[lex[used]])[back]
        p = forward_backward(scores, lengths, model.moves)
        pairs = _pair_marginals(scores, lengths, model.moves, p)
        seq = want.reshape(batch, SPAN)
        np.subtract.at(pairs, (seq[:, :-1], seq[:, 1:]), 1.0)
        d = p
        d[np.arange(len(d)), want] -= 1.0
        d_used = np.zeros((len(used), k))
        np.add.at(d_used, back, d / batch)
        g_gram, g_lex = np.zeros_like(model.grams), np.zeros_like(model.lexicon)
        np.add.at(g_gram, gram[rows_of], (d_used / n_grams[used][:, None])[which])
        np.add.at(g_lex, lex[used], d_used)
        for w, g, s in zip((model.grams, model.lexicon, model.moves), (g_gram, g_lex, pairs / batch), squares, strict=True):
            s += g * g
            w -= rate * g / np.sqrt(s + 1e-8) * (0.2 if w is not model.grams else 1.0)
    return model


def fit(docs: DataFrame, learn: Column, lang: str = "lang", per_class: int = 200, max_chars: int = 4_000) -> Crf:
    """Train on at most ``per_class`` texts of each language and ``max_chars`` of each text: the bound on the sample."""
    return train(class_sample(docs, lang, learn, per_class, max_chars))


class Labeller:
    """Labels texts with a field; remembers the scores of a bounded number of words."""

    def __init__(self, model: Crf):
        self.model, self.numbering = model, Numbering()
        self.scores = np.zeros((0, max(len(model.labels), 1)))

    def marginals(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and, for each, the probability of every label."""
        if len(self.numbering) > MAX_WORDS:
            self.__init__(self.model)
        words = [words_of(t) for t in texts]
        ids = [np.array(list(map(self.numbering.__getitem__, w)), np.int64) for w in words]
        if len(self.numbering) > len(self.scores):
            new = list(self.numbering)[len(self.scores) :]
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        lengths = np.array([len(i) for i in ids], np.int64)
        p = forward_backward(self.scores[np.concatenate(ids)], lengths, self.model.moves)
        return list(zip(words, np.split(p, np.cumsum(lengths)[:-1]), strict=True))

    def _scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the words of a piece of text, and their scores for every label."""
        if len(self.numbering) > MAX_WORDS:
            self.__init__(self.model)
        words = words_of(text)
        ids = np.array(list(map(self.numbering.__getitem__, words)), np.int64)
        if len(self.numbering) > len(self.scores):
            self.scores = np.concatenate([self.scores, self.model.emissions(list(self.numbering)[len(self.scores) :])])
        return np.array([len(w) for w in words], np.float64), self.scores[ids]

    def _letters(self, text: str) -> np.ndarray:
        """Expected letters of each label in a long text, a piece in memory at a time: one pass for the messages, one for the marginals."""
        k, moves = len(self.model.labels), self.model.moves
        carry, began = [], False
        for piece in pieces_of(text, LONG):
            _, scores = self._scores(piece)
            if len(scores):
                entry = np.full(k, 1.0 / k) if began else None
                carry.append(forward_backward(scores, np.array([len(scores)]), moves, entry=entry, transfer=True))
                began = True
        before, after = [None], [np.full(k, 1.0 / k)]
        for m in carry[:-1]:
            x = (np.full(k, 1.0 / k) if before[-1] is None else before[-1]) @ m
            before.append(x / x.sum())
        for m in carry[:0:-1]:
            x = m @ after[-1]
            after.append(x / x.sum())
        after.reverse()
        total, i = np.zeros(max(k, 1)), 0
        for piece in pieces_of(text, LONG):
            weight, scores = self._scores(piece)
            if len(scores):
                total += weight @ forward_backward(scores, np.array([len(scores)]), moves, entry=before[i], leave=after[i])
                i += 1
        return total

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language of each text and its share of the text's letters, by marginal probability."""
        if not self.model.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        short = [t for t in texts if len(t) <= LONG]
        found = iter(self.marginals(short) if short else ())
        out = []
        for text in texts:
            if len(text) <= LONG:
                words, p = next(found)
                letters = np.array([len(w) for w in words], np.float64) @ p if words else np.zeros(1)
            else:
                letters = self._letters(text)
            if not letters.sum():
                out.append((UNKNOWN, 0.0))
                continue
            share = letters / letters.sum()
            out.append((self.model.labels[int(share.argmax())], float(min(share.max(), 1.0))))
        return out


def identify(docs: DataFrame, model: Crf, text: str = "text", spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` and, if ``spans``, ``words``: each word's language in order.

    A null text or one without letters is ``und`` with score 0. Columns of those names are replaced; ``carry`` names the
    columns kept, all by default. Rows are worked through in pieces of some 100,000 words, and so is a longer text, whose messages
    are carried from piece to piece, so that the marginals are those of the whole chain; with ``spans`` its words are all
    held. The model (some 2 MB a language pair) is broadcast.
    """
    extra = ["lang_pred", "score", *(["words"] if spans else [])]
    names = [c for c in carry or docs.columns if c not in extra]
    [body] = own_names(docs, "_whole_text")
    rows = docs.select(*names, whole_text(text).alias(body))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    schema += ", lang_pred string, score double" + (", words array<struct<word:string,lang:string>>" if spans else "")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn():
        labeller = Labeller(shared.value)

        def step(c):
            sizes = np.cumsum([len(t) for t in c[body].to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // (5 * TOGETHER))) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                texts = c[body][a:b].to_pylist()
                found = labeller.languages(texts)
                more = {}
                if spans:
                    known = labeller.model.labels or [UNKNOWN]
                    more["words"] = pa.array(
                        [[{"word": w, "lang": known[i]} for w, i in zip(ws, p.argmax(1), strict=True)] for ws, p in labeller.marginals(texts)],
                        pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())])),
                    )
                yield record_batch(
                    **{k: c[k][a:b] for k in names},
                    lang_pred=pa.array([x for x, _ in found], pa.string()),
                    score=pa.array([s for _, s in found], pa.float64()),
                    **more,
                )

        return step

    return map_rows(rows, schema, fn)
