"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import xxhash


def components(nodes, linked):
    """Smallest node reachable, by repeated passes over all pairs given."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text: str | None, k: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = components(ids, pairs)
    return {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def removed(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) per text."""
    raws = [(t or "").encode() for t in texts]
    met = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if met[r[s : s + length]] > 1:
                gone[s : s + length] = True
        rest = bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), len(r) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def exact_groups(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    return {
        i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(bare.encode()).hexdigest()) for bare, g in groups.items() for _, i in g
    }


def mix_targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.remove(s)
    return target
