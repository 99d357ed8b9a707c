"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import labelled_sample, map_rows, own_names, record_batch, whole_text
from runledger.llm.learn import Adam, sigmoid

THRESHOLD = 0.7  # score from which a document is kept
UNFITTED = 0.75  # score of every document where nothing was learned
WIDTH = 4  # bytes a filter sees
HALF = 256  # chunks are two halves long and start at every half
FILTERS = 12
LAGS = range(2, 25)  # distances at which repeated eight-byte groups are looked for
_SEGMENT = 1 << 16  # bytes convolved at once


@dataclass
class ByteCnn:
    """Weights: filters by position and byte, one per filter for the repeat plane, then a small dense head."""

    params: dict[str, np.ndarray]
    fitted: bool = True  # False where the sample held no two classes to tell apart

    @classmethod
    def fresh(cls, seed: int = 1) -> ByteCnn:
        rng = np.random.default_rng(seed)
        n = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        return cls(
            {
                "w": n(WIDTH, 256, FILTERS), "r": n(FILTERS), "b": np.zeros(FILTERS, np.float32),
                "v": n(2 * FILTERS, 8), "c": np.zeros(8, np.float32), "u": n(8), "d": np.zeros(1, np.float32),
            }
        )

    def tables(self) -> np.ndarray:
        """The filters as two tables over pairs of bytes, so that a window costs two look-ups."""
        w = self.params["w"]
        first = (w[0][:, None, :] + w[1][None, :, :]).reshape(65_536, FILTERS) + self.params["b"]
        return np.stack([first, (w[2][:, None, :] + w[3][None, :, :]).reshape(65_536, FILTERS)]).astype(np.float32)


def _padded(raw: bytes) -> np.ndarray:
    """The bytes, at least one window of them, padded with zeros to whole halves."""
    n = max(1, -(-max(len(raw), 1) // HALF)) * HALF
    return np.frombuffer(raw.ljust(n + WIDTH, b"\0"), np.uint8)


def repeats(x: np.ndarray) -> np.ndarray:
    """1 where the eight bytes from here on stood up to 24 bytes before, too; padding repeats nothing."""
    if len(x) < 16:
        return np.zeros(len(x), np.float32)
    eight = np.lib.stride_tricks.sliding_window_view(x, 8).copy().view("<u8")[:, 0]
    found = np.zeros(len(x), bool)
    for lag in LAGS:
        if lag < len(eight):
            found[lag : len(eight)] |= eight[lag:] == eight[:-lag]
    found[: len(eight)] &= eight != 0
    return found.astype(np.float32)


def half_peaks(x: np.ndarray, tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each half; windows start at every byte."""
    n = len(x) - WIDTH
    again = repeats(x)
    peaks = np.empty((n // HALF, FILTERS), np.float32)
    for a in range(0, n, _SEGMENT):
        b = min(n, a + _SEGMENT)
        part = x[a : b + WIDTH].astype(np.int32)
        pair = (part[:-1] << 8) | part[1:]
        y = tables[0][pair[: b - a]]
        y += tables[1][pair[2 : b - a + 2]]
        hit = np.flatnonzero(again[a:b])
        y[hit] += r
        peaks[a // HALF : b // HALF] = y.reshape(-1, HALF, FILTERS).max(1)
    return peaks


def chunk_peaks(halves: np.ndarray) -> np.ndarray:
    """Max-pooled, rectified responses of the overlapping chunks."""
    pooled = halves if len(halves) == 1 else np.maximum(halves[:-1], halves[1:])
    return np.maximum(pooled, 0)


def combine(chunks: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Document features (mean and maximum over all chunks), hidden layer, logit."""
    f = np.concatenate([chunks.mean(0), chunks.max(0)])
    h = np.tanh(f @ p["v"] + p["c"])
    return f, h, float(h @ p["u"] + p["d"][0])


def score_text(text: str, p: dict[str, np.ndarray], tables: np.ndarray) -> float:
    x = _padded(text.encode("utf-8", "surrogatepass"))
    return float(sigmoid(np.float64(combine(chunk_peaks(half_peaks(x, tables, p["r"])), p)[2])))


def train(
    rows: list[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 1, steps: int = 250
) -> ByteCnn:
    """Fit on labelled texts by Adam; each maximum passes its gradient to the one window that made it.

    Few texts are gone through more often, until ``steps`` batches have been taken.

    Without both classes there is nothing to tell apart: every score is ``UNFITTED``, and nothing is turned away.
    """
    net = ByteCnn.fresh(seed)
    p = net.params
    if len({y for _, y in rows}) < 2:
        p["u"][:] = 0
        net.fitted = False
        return net
    rng = np.random.default_rng(seed)
    data = [(_padded(t.encode("utf-8", "surrogatepass")), y) for t, y in rows]
    again = [repeats(x) for x, _ in data]
    share = np.bincount([y for _, y in rows], minlength=2) / len(rows)
    opt = Adam(p, rate)
    epochs = max(epochs, -(-steps // -(-len(rows) // batch)))
    for epoch in range(epochs):
        opt.rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            tables = net.tables()
            g = {k: np.zeros_like(v) for k, v in p.items()}
            some = order[at : at + batch]
            for i in some:
                x, y = data[i]
                n = len(x) - WIDTH
                part = x.astype(np.int32)
                pair = (part[:-1] << 8) | part[1:]
                resp = tables[0][pair[:n]] + tables[1][pair[2 : n + 2]]
                resp[np.flatnonzero(again[i][:n])] += p["r"]
                block = resp.reshape(-1, HALF, FILTERS)
                where = block.argmax(1) + np.arange(len(block))[:, None] * HALF
                halves = block.max(1)
                chunks = chunk_peaks(halves)
                f, h, z = combine(chunks, p)
                dz = (sigmoid(np.float32(z)) - y) / (2 * share[y] * len(some))
                dh = dz * p["u"] * (1 - h * h)
                g["u"] += dz * h
                g["d"] += dz
                g["v"] += np.outer(f, dh)
                g["c"] += dh
                df = p["v"] @ dh
                dchunk = np.repeat(df[None, :FILTERS] / len(chunks), len(chunks), 0)
                dchunk[chunks.argmax(0), np.arange(FILTERS)] += df[FILTERS:]
                dchunk *= chunks > 0
                if len(halves) == 1:
                    spots, grads = where, dchunk
                else:
                    left = halves[:-1] >= halves[1:]
                    spots, grads = np.where(left, where[:-1], where[1:]), dchunk
                filters = np.broadcast_to(np.arange(FILTERS), spots.shape)
                for j in range(WIDTH):
                    np.add.at(g["w"][j], (x[spots + j], filters), grads)
                g["b"] += grads.sum(0)
                g["r"] += (grads * again[i][spots]).sum(0)
            g["w"] += 1e-4 * p["w"]
            opt.step(g)
    return net


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 800, max_chars: int = 8_000
) -> ByteCnn:
    """Train on at most ``per_class`` texts of each class and ``max_chars`` of each text: the bound on the sample."""
    return train(labelled_sample(docs, labels, label, learn, per_class, max_chars))


def score(docs: DataFrame, net: ByteCnn, text: str = "text", out: str = "score", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of good quality of every whole text, replacing a column named ``out``.

    ``carry`` names the columns kept, all by default.

    A null text is an empty one; an empty text is one chunk of padding. Texts of any length are worked through in
    segments. The network (some 100 KB) is sent with the task.
    """
    names = [c for c in carry or docs.columns if c != out]
    if not net.fitted:
        return docs.select(*names, F.lit(UNFITTED).alias(out))
    [body] = own_names(docs, "_whole_text")
    rows = docs.select(*names, whole_text(text).alias(body))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` double"
    params = net.params

    def fn():
        tables = ByteCnn(params).tables()

        def step(c):
            values = [score_text(t, params, tables) for t in c[body].to_pylist()]
            yield record_batch(**{k: c[k] for k in names}, **{out: pa.array(values, pa.float64())})

        return step

    return map_rows(rows, schema, fn)


def accepted(threshold: float = THRESHOLD, score: str = "score") -> Column:
    """Whether the score reaches the threshold."""
    return F.col(score) >= threshold


def keep_good(docs: DataFrame, net: ByteCnn, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    [own] = own_names(docs, "_quality_score")
    return score(docs, net, text, own).where(accepted(threshold, own)).select(*docs.columns)
