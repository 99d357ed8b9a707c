"""Numpy pieces shared by the trained operators: an optimiser, word numbering, hashed letter groups."""

from __future__ import annotations

import zlib

import numpy as np


class Adam:
    """Adam on a dict of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.var = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in grads.items():
            m, v = self.mean[k], self.var[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            by = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.params[k] -= (by * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Numbering(dict):
    """Words to consecutive numbers; a new word is numbered when looked up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def cap_bytes(word: str) -> bytes:
    return f"<{word}>".encode("utf-8", "surrogatepass")


def gram_sums(words: list[str], sizes: tuple[int, ...], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table rows of every group of ``sizes`` bytes in ``<word>``, and the number of groups."""
    if not words:
        return np.zeros((0, table.shape[1]), table.dtype), np.zeros(0, np.int64)
    sums, counts = 0, 0
    for valid, row, starts in gram_rows(words, sizes, len(table)):
        sums = sums + np.add.reduceat(table[row] * valid[:, None], starts)
        counts = counts + np.add.reduceat(valid.astype(np.int64), starts)
    return sums, counts


def gram_rows(words: list[str], sizes: tuple[int, ...], buckets: int):
    """Per size: which byte positions start a group, the group's hash bucket, and where each word starts."""
    raw = [cap_bytes(w) for w in words]
    lengths = np.array([len(w) for w in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(buf))  # bytes from here to the end of the word
    code, wide = np.zeros(len(buf), np.uint32), 0
    padded = np.concatenate([buf, np.zeros(max(sizes), np.uint32)])
    for n in sizes:
        while wide < n:
            code = (code ^ padded[wide : wide + len(buf)]) * np.uint32(16_777_619)
            wide += 1
        mixed = (code + np.uint32(n)) * np.uint32(2_654_435_761)
        yield left >= n, ((mixed >> np.uint32(15)) % np.uint32(buckets)).astype(np.int64), ends - lengths


def word_rows(words: list[str], buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(cap_bytes(w)) % buckets for w in words], np.int64)
