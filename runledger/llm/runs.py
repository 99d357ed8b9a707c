"""Runs of repeated words, by the grouping phase of Baier's suffix sorter."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch

MIN_LENGTH = 6  # words of the shortest run
MIN_POWER = 4  # periods of the shortest run
_BATCH = 4 << 20  # bytes of text handled at once; a longer text is handled alone
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def lyndon_groups(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, group): the longest Lyndon word that starts at each place, and a number that equal ones share.

    ``word`` holds ranks; rank 0 parts sequences from each other and stands last, too. Suffixes start out grouped by
    their first word. Groups are taken from the greatest down. For each suffix of the group taken, the nearest
    suffix to its left in a lower group takes over the group's Lyndon word, as many times as it is met, and
    moves to a new group right above its old one. When a group's turn comes its suffixes are final. Each suffix sends one
    move, so there are as many moves as words.
    """
    n, top = len(word), int(word.max(initial=0))
    group = array("i", word.astype(np.int32).tobytes())
    order = np.argsort(word, kind="stable").astype(np.int32)
    bounds = np.searchsorted(word[order], np.arange(top + 2))
    # suffixes of a group as a doubly linked list; ends are -1
    after, ahead = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    same = word[order][1:] == word[order][:-1]
    after[order[:-1][same]] = order[1:][same]
    ahead[order[1:][same]] = order[:-1][same]
    after, ahead = array("i", after.tobytes()), array("i", ahead.tobytes())
    first = array("i", [int(order[a]) if a < b else -1 for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    size = array("i", [1]) * (top + 1)
    below, above = array("i", range(-1, top)), array("i", range(1, top + 2))
    above[top] = -1
    left = array("i", range(n))  # the nearest place at or left of this one that is not final

    g = top
    while g > 0:
        members = []
        i = first[g]
        while i >= 0:
            members.append(i)
            left[i] = i - 1
            i = after[i]
        met: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and left[j] != j:  # halve the path on the way
                k = left[j]
                left[j] = j = left[k] if k >= 0 else k
            if j >= 0 and group[j]:
                met[j] = met.get(j, 0) + 1
        length = size[g]
        times = sorted(set(met.values()), reverse=True) if met else ()
        for t in times:
            new: dict[int, int] = {}
            for j, m in met.items():
                if m != t:
                    continue
                old = group[j]
                into = new.get(old)
                if into is None:
                    into = new[old] = len(first)
                    first.append(-1)
                    size.append(size[old] + t * length)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = into
                    below[up] = into
                a, b = ahead[j], after[j]
                if a >= 0:
                    after[a] = b
                else:
                    first[old] = b
                if b >= 0:
                    ahead[b] = a
                head = first[into]
                ahead[j], after[j] = -1, head
                if head >= 0:
                    ahead[head] = j
                first[into] = j
                group[j] = into
        g = below[g]
    groups = np.frombuffer(group, np.int32)
    return np.frombuffer(size, np.int32)[groups], groups


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Leading places in which two arrays agree."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(n, at + step)
        unlike = np.flatnonzero(a[at:end] != b[at:end])
        if len(unlike):
            return at + int(unlike[0])
        at, step = end, step * 2
    return n


def runs_of(word: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``MIN_LENGTH`` words and ``MIN_POWER`` periods.

    ``word`` is as for ``lyndon_groups``. By one of the two orders of the words, every period of a run begins a Lyndon
    root that is the longest Lyndon word at its place, so a run is a chain of places that share a group, each a root's length
    from the next. A run of four periods holds three whole roots. Chains are extended to both sides as long as words a period
    apart agree.
    """
    found = set()
    top = int(word.max(initial=0))
    for ranks in (word, np.where(word > 0, top + 1 - word, 0)):
        length, group = lyndon_groups(ranks)
        at = np.flatnonzero(ranks > 0)
        to = at + length[at]
        linked = np.zeros(len(word), bool)
        linked[at] = group[to] == group[at]  # a place that begins no word has a group of its own kind
        entered = np.zeros(len(word), bool)
        entered[(np.arange(len(word)) + length)[linked]] = True
        for i in np.flatnonzero(linked & ~entered).tolist():
            p, j = int(length[i]), i
            while linked[j]:
                j += p
            end = j + p
            if end - i < (MIN_POWER - 1) * p:
                continue
            end += _common(word[end:], word[end - p :])
            start = i - _common(word[:i][::-1], word[: i + p][::-1])
            if end - start >= max(MIN_LENGTH, MIN_POWER * p):
                found.add((start, end - start, p))
    return found


def _stretches(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of words in which runs can lie, as starts and ends; no run reaches over a bound.

    A run holds each of its triples of neighbouring words three times or more, so a triple met less often ends a stretch.
    Triples are counted by hash; a collision can only lengthen a stretch.
    """
    n = len(code)
    if n < MIN_LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = code.astype(np.uint64) + np.uint64(1)
    key = x[:-2] * _MIX[0] ^ x[1:-1] * _MIX[1] ^ x[2:] * _MIX[2] ^ doc[:-2].astype(np.uint64) * _MIX[3]
    key *= _MIX[0]
    key >>= np.uint64(64 - n.bit_length() - 1)
    inside = doc[:-2] == doc[2:]
    met = np.bincount(key[inside].astype(np.int64), minlength=1)
    live = np.zeros(n - 2, bool)
    live[inside] = met[key[inside].astype(np.int64)] >= MIN_POWER - 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2] + 2
    long = ends - starts >= MIN_LENGTH
    return starts[long], ends[long]


def _found(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs in a concatenation of texts."""
    starts, ends = _stretches(code, doc)
    rows: list[tuple[int, int, int]] = []
    at = 0
    while at < len(starts):  # stretches are handled together up to a size, since each alone costs a pass
        room = np.cumsum(ends[at:] - starts[at:])
        till = at + max(1, int(np.searchsorted(room, 1 << 18, "right")))
        sizes = ends[at:till] - starts[at:till]
        first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 follows each stretch
        place = np.zeros(first[-1], np.int64)
        word = np.zeros(first[-1], np.int64)
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        place[inner] = np.repeat(starts[at:till] - first[:-1], sizes) + np.flatnonzero(inner)
        word[inner] = np.unique(code[place[inner]], return_inverse=True)[1] + 1
        rows += [(int(place[s]), size, period) for s, size, period in runs_of(word)]
        at = till
    return np.array(sorted((s, p, size) for s, size, p in rows), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _repeated(words: int, h: int) -> tuple[int, int]:
    """First word and period of the stretch that becomes periodic in a text of so many words."""
    g = h // 10
    a = g % words
    return a, 1 + (words - a) // (3 + g % 8)


def describe(texts: list[bytes], marks: list[int | None]) -> dict[str, list]:
    """The columns of ``word_runs`` for some texts; a mark that 10 divides makes its text periodic from some word on."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = raw[~space]
    tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    code = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bounds = np.searchsorted(starts, begins)  # first word of each text
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))

    source = np.arange(n)
    for k, h in enumerate(marks):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        if h is not None and h % 10 == 0 and hi > lo:
            a, p = _repeated(hi - lo, h)
            source[lo + a : hi] = lo + a + np.arange(hi - lo - a) % p
    code = code[source]

    runs = _found(code, doc)
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(drop[:-1]) == 0
    counts = np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(counts), tokens.take(pa.array(source[kept])))
    joined = pc.binary_join(lists, b" ")

    of_doc = np.searchsorted(runs[:, 0], bounds)
    out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for k in range(len(texts)):
        own = [(int(s - bounds[k]), int(size), int(p)) for s, size, p in runs[of_doc[k] : of_doc[k + 1]]]
        out["n_runs"].append(len(own))
        s, size, p = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
        for name, value in (("start", s), ("length", size), ("period", p), ("exponent_milli", size and 1000 * size // p)):
            out[name].append(value)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in own).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(joined[k].as_buffer()).hexdigest())
    return out


_COLUMNS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """One row per document: its maximal runs of repeated words, and the digest of the text with runs cut to one period.

    A run is a stretch of words of smallest period q, at least six words and four periods long, that no neighbouring word
    extends. Columns: doc_id, n_runs; start, length, period, exponent_milli of the longest (ties: first, then
    shortest period; null without a run); runs_sha256 over all runs; collapsed_sha256 over the words no run drops, joined by one space.

    With ``repeat`` a tenth of the texts is made periodic from some word on, by the crc32 of the id; a null id marks none.
    A null text has no words. Repeated rows each give a row; an empty table gives none. A text is handled whole, in numbers
    of four bytes a word; other columns of ``docs`` are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    mark = F.crc32(F.col(doc_id).cast("string").cast("binary")) if repeat else F.lit(None).cast("bigint")

    def fn():
        def step(c):
            ids, texts, marks = c["doc_id"], c["text"], c["mark"].to_pylist()
            at, n = 0, len(ids)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            while at < n:
                till = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BATCH, "right")))
                rows = describe(texts[at:till].to_pylist(), marks[at:till])
                columns = {name: pa.array(rows[name], t) for name, t in _COLUMNS.items()}
                yield record_batch(doc_id=ids[at:till], **columns)
                at = till

        return step

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), mark.alias("mark"))
    schema = (
        f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return map_rows(rows, schema, fn)
