"""BPE encoding by speculate and verify, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch, whole_text

# How byte-level vocabularies cut text into words before merging (fixed value of the public format).
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_CACHED = 200_000  # distinct words a task remembers; they are looked up again beyond that
BEYOND_PLANE = re.compile("[\U00010000-\U0010ffff]")
SHORT_WORD = 48  # words of up to so many bytes are merged together, longer ones by a heap
TOGETHER = 4_096
MAX_CACHED_LETTERS = 64  # longer words are encoded anew each time


def _word_cutter(above: int) -> re.Pattern:
    """WORD_CUT for texts of characters below ``above``, its classes spelled out as ranges for ``re``."""
    every = "".join(map(chr, (c for c in range(above) if not 0xD800 <= c < 0xE000)))
    span = lambda p: "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(p, every))
    letter, digit, space = (span(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+"))
    cut = WORD_CUT.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]")
    return re.compile(cut.replace(r"\p{N}", f"[{digit}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library, with its merges in order of rank.

    Only files without normalizer, prefix space, dropout, and with plain special tokens are taken; others
    raise ValueError, since their results would differ.
    """

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (
            model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
            or not pre["use_regex"] or model["dropout"] or model["ignore_merges"] or model["byte_fallback"]
        ):
            raise ValueError("not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip, single-word or normalized flags are not supported")
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*ids.values(), *self.special.values())
        self.token = [b""] * self.size
        for word, i in ids.items():
            self.token[i] = word
        for word, i in self.special.items():
            self.token[i] = word.encode()
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.ids, self.byte_ids = ids, self.of_byte.tolist()
        # merge ranks; a token that no merge makes (a byte) has rank -1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        halves = [(ids[bytes(letters[c] for c in a)], ids[bytes(letters[c] for c in b)]) for a, b in pairs]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = np.full(self.size, -1, np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        for r, (a, b) in enumerate(halves):
            whole = ids[self.token[a] + self.token[b]]
            self.rank.setdefault((a, b), (r, whole))
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = r, a, b
        self.none = len(halves)
        self.whole = np.array([ids[self.token[a] + self.token[b]] for a, b in halves], np.int64)
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        # a token proposed by longest match must be what merging its own bytes gives
        self.proposed = {w for w, i in ids.items() if len(w) == 1 or self.merge(w) == [i]}
        # beginnings of proposed tokens, with the token's id where one ends there
        self.prefixes = dict.fromkeys((w[:k] for w in self.proposed for k in range(1, len(w))), -1)
        self.prefixes |= {w: ids[w] for w in self.proposed}
        self.cut, self.cut_plane = _word_cutter(0x110000), _word_cutter(0x10000)
        self.parts = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals, by a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, p))
        return [t for t in ids if t >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or the number of merges where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], self.none)

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words of similar length at once: one merge of each word per step."""
        size = np.array([len(w) for w in words])
        width = int(size.max()) + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        cols = np.arange(width)
        ids = self.of_byte[raw]
        ids[cols[None, :] >= size[:, None]] = self.size - 1  # behind the word, where no merge starts or ends
        rank = np.full(ids.shape, self.none)
        inside = cols[None, :] < size[:, None] - 1
        y, x = np.nonzero(inside)
        rank[y, x] = self.ranks_of(ids[y, x], ids[y, x + 1])
        out, live = [np.zeros(0, np.int64)] * len(words), np.arange(len(words))
        while len(live):
            i = rank.argmin(1)
            low = np.take_along_axis(rank, i[:, None], 1)[:, 0]
            done = low == self.none
            for k in np.flatnonzero(done).tolist():
                out[live[k]] = ids[k, : size[k]]
            go = ~done
            live, ids, rank, size, i, low = live[go], ids[go], rank[go], size[go] - 1, i[go], low[go]
            if not len(live):
                break
            n, gap = len(live), cols[None, :] + (cols[None, :] > i[:, None])
            gap[:, -1] = width - 1
            ids, rank = np.take_along_axis(ids, gap, 1), np.take_along_axis(rank, gap, 1)
            row = np.arange(n)
            ids[row, i] = self.whole[low]
            rank[row, i] = np.where(i + 1 < size, self.ranks_of(ids[row, i], ids[row, i + 1]), self.none)
            k = np.flatnonzero(i > 0)
            rank[k, i[k] - 1] = self.ranks_of(ids[k, i[k] - 1], ids[k, i[k]])
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over the proposed tokens."""
        out, at, n, look = [], 0, len(word), self.prefixes.get
        while at < n:
            end, best = at + 1, self.byte_ids[word[at]]
            stop = end
            while end < n and (token := look(word[at : end + 1])) is not None:
                end += 1
                if token >= 0:
                    best, stop = token, end
            out.append(best)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: merging the bytes of both leaves them as they are.

        The merges of either token are undone, the latest first, along the edge between the two. At each step the
        tokens that then meet must have no merge earlier than the one undone last, which would have taken
        its place. Ties go to the left pair, as in merging. All pairs step together.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        until = np.full(len(a), self.none, np.int64)  # rank of the merge undone last
        left_last = np.zeros(len(a), bool)  # it was made on the left of the edge
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks_of(x, y)
            # a pair across the edge of the same rank wins against a merge to its right, not to its left
            broken = (rank < until[live]) | ((rank == until[live]) & (rank < self.none) & ~left_last[live])
            ok[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            rx, ry = self.made[x], self.made[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            # equal ranks: the left one is made first, so the right one is undone first
            undo_left = rx > ry
            a[live[undo_left]] = self.right[x[undo_left]]
            b[live[~undo_left]] = self.left[y[~undo_left]]
            until[live] = np.maximum(rx, ry)
            left_last[live] = undo_left
        return ok

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        tokens = [self.propose(w) for w in words]
        flat = np.fromiter((t for w in tokens for t in w), np.int64)
        ends = np.cumsum([len(w) for w in tokens])
        good = np.ones(len(flat), bool)  # good[i]: token i goes with the one before it
        inner = np.ones(len(flat), bool)
        inner[0] = False
        inner[ends[:-1]] = False
        at = np.flatnonzero(inner)
        if len(at):
            pairs, back = np.unique(flat[at - 1] * self.size + flat[at], return_inverse=True)
            good[at] = self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(np.searchsorted(ends, np.flatnonzero(~good), side="right"))
        by_length = sorted(failing.tolist(), key=lambda i: len(words[i]))
        long = next((k for k, i in enumerate(by_length) if len(words[i]) > SHORT_WORD), len(by_length))
        for k in range(0, long, TOGETHER):
            some = by_length[k : min(k + TOGETHER, long)]
            for i, merged in zip(some, self.merge_all([words[i] for i in some]), strict=True):
                tokens[i] = merged
        for i in by_length[long:]:
            tokens[i] = self.merge(words[i])
        return [np.array(w, "<u4").tobytes() for w in tokens]

    def pieces(self, text: str) -> Iterable[str | int]:
        """Words of the text in order; a special token is given as its id."""
        cut = self.cut if BEYOND_PLANE.search(text) else self.cut_plane
        if self.parts is None or not self.parts.search(text):
            return cut.findall(text)
        out: list[str | int] = []
        for part in self.parts.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += cut.findall(part)
        return out

    def encode_batch(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each text; ``known`` maps words to their ids and is filled, and emptied when it grows too large."""
        if len(known) > MAX_CACHED:
            known.clear()
        cut = [self.pieces(t) for t in texts]
        found: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in self.special.values()}
        distinct = set().union(*cut) - found.keys()
        new = [w for w in distinct if w not in known]
        if new:
            found.update(zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        found.update((w, known[w]) for w in distinct if w in known)
        known.update((w, found[w]) for w in new if len(w) <= MAX_CACHED_LETTERS)
        return [b"".join(map(found.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if ``keep``, ids and decoded of every whole text.

    ``path`` names a vocabulary file that the driver reads; its parsed tables (a few MB) are broadcast. A null text
    is an empty one, with no tokens. Repeated rows each give a row; an empty table gives none. A task works through
    its rows in pieces of about a million characters, and remembers a bounded number of words.
    """
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def fn():
        bpe, known = _loaded(spec.value), {}

        def some(doc_ids, texts):
            coded = bpe.encode_batch(texts, known)
            arrays = [np.frombuffer(c, "<u4") for c in coded]
            decoded = [bpe.decode(a) for a in arrays]
            more = {}
            if keep:
                more = {
                    "ids": pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())),
                    "decoded": pa.array(decoded, pa.string()),
                }
            return record_batch(
                doc_id=doc_ids,
                n_tokens=pa.array([len(a) for a in arrays], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                decoded_sha256=pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                **more,
            )

        def step(c):
            sizes = np.cumsum([len(v) for v in c["text"].to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // 1_000_000)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield some(c["doc_id"][a:b], c["text"][a:b].to_pylist())

        return step

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return map_rows(rows, schema + (", ids array<int>, decoded string" if keep else ""), fn)


_LOADED: dict[str, ByteBpe] = {}


def _loaded(spec: str) -> ByteBpe:
    """One parsed vocabulary per Python worker, which serves many tasks."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(json.loads(spec))
    return _LOADED[key]


def decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded) of an array of ids; null arrays give null, unknown ids raise IndexError."""
    with open(path, encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[doc_id].dataType.simpleString()

    def fn():
        bpe = _loaded(spec.value)

        def step(c):
            text = [None if v is None else bpe.decode(np.array(v, np.int64)) for v in c["ids"].to_pylist()]
            yield record_batch(doc_id=c["doc_id"], decoded=pa.array(text, pa.string()))

        return step

    return map_rows(rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), f"doc_id {kind}, decoded string", fn)
