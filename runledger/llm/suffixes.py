"""Suffix-array dedup: repeated byte strings, found by blockwise suffix sorting over a difference cover."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch, whole_text
from runledger.session import settle

PERIOD = 80  # of the difference cover; a string is compared as 80 bytes, four periods from a sample, 80 bytes
SEGMENT = 1 << 18  # starts hashed at once
BLOCK_BYTES = 1 << 20  # text sorted at once
HOT_RUNS = 1_000  # distinct runs of one bucket beyond which it is dealt out by cells of starts
MAX_SEEN = 50_000  # texts a fetching task remembers
CELLS = (16, 1)  # starts of a cell, and of a cell of a cell
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POSITION = np.uint64((1 << 20) - 1)


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), out=up)
    np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), out=down)
    return up, down


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of the ``gram`` bytes from each position."""
    up, down = _powers(SEGMENT + (1 << 14))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(x) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(raw: bytes, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(bucket hash, offset of the bucket's gram, first start, number of starts) for all starts of a text.

    A start belongs to the bucket of the least hashed gram of its ``length`` bytes, the first of equals. Equal
    strings so have equal buckets and offsets, and neighbouring starts mostly share one.
    """
    if len(raw) < length:
        return []
    if length > 1 << 13 or not 0 < gram <= length:
        raise ValueError("strings of up to 8,192 bytes, and grams no longer than they, are supported")
    out = []
    whole = np.frombuffer(raw, np.uint8)
    width = length - gram + 1
    for at in range(0, len(raw) - length + 1, SEGMENT):
        x = whole[at : at + SEGMENT + length - 1].astype(np.uint64)
        h = gram_hashes(x, gram)
        low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        anchor = (low & _POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        sizes = np.diff(np.append(first, len(anchor)))
        buckets = h[anchor[first]].view(np.int64)
        out += zip(buckets.tolist(), (anchor[first] - first).tolist(), (first + at).tolist(), sizes.tolist(), strict=True)
    return out


@lru_cache
def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues such that any two positions reach them by one common shift, and that shift for each two residues."""
    cover, missing = [0], set(range(1, period))
    reached = lambda c: {(c - d) % period for d in cover} | {(d - c) % period for d in cover}
    while missing:
        new = max(range(period), key=lambda c: (len(missing & reached(c)), -c))
        missing -= reached(new)
        cover.append(new)
    inside = np.isin(np.arange(period), cover)
    shift = np.zeros((period, period), np.int64)
    r = np.arange(period)
    for delta in range(period - 1, -1, -1):
        both = inside[(r[:, None] + delta) % period] & inside[(r[None, :] + delta) % period]
        shift[both] = delta
    return np.flatnonzero(inside), shift


def _ranks(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rank of the ``n`` bytes from each position among those given."""
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, n)[at]).view(f"S{n}")[:, 0]
    return np.unique(strings, return_inverse=True)[1].astype(np.int64)


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start whether its ``length`` bytes also begin at another of the starts.

    The suffixes are sorted by their first 80 bytes and by the 80 bytes that end the string; what still ties is told
    apart by the ranks of the cover sample, which hold for the bytes between and are computed once for the block.
    Two tied suffixes reach the sample by one common shift, so a comparison costs one look-up however long
    the strings; memory is a few words per byte of the block.
    """
    found = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return found
    x = np.concatenate([x, np.zeros(length + PERIOD, np.uint8)])
    head, tail = _ranks(x, starts, PERIOD), _ranks(x, starts + length - PERIOD, PERIOD)
    tie = _pair_ranks(head, tail)
    many = np.bincount(tie)[tie] > 1
    live = np.flatnonzero(many)
    if not len(live):
        return found
    cover, shift = difference_cover(PERIOD)
    middle = _middle_ranks(x, starts[live], length, cover)
    live = live[np.argsort(tie[live], kind="stable")]
    while len(live) > 1:
        groups = tie[live]
        new = np.concatenate([[True], groups[1:] != groups[:-1]])
        leader = live[np.flatnonzero(new)[np.cumsum(new) - 1]]
        by = shift[starts[leader] % PERIOD, starts[live] % PERIOD]
        same = middle[starts[leader] + by] == middle[starts[live] + by]
        other = same & (leader != live)
        found[live[other]] = True
        found[leader[other]] = True
        live = live[~same]  # a leader is the same as itself and leaves with its class
    return found


def _middle_ranks(x: np.ndarray, starts: np.ndarray, length: int, cover: np.ndarray) -> np.ndarray:
    """Ranks of the ``length - 80`` bytes from each sample position that a start can reach, by doubling."""
    wanted = length - PERIOD
    reach = np.zeros(len(x), np.int32)
    np.add.at(reach, starts, 1)
    np.add.at(reach, np.minimum(starts + length, len(x) - 1), -1)
    sampled = np.isin(np.arange(PERIOD), cover)[np.arange(len(x)) % PERIOD]
    at = np.flatnonzero(sampled & (np.cumsum(reach) > 0) & (np.arange(len(x)) <= len(x) - PERIOD))
    rank = np.full(len(x) + length, -1, np.int64)
    rank[at] = _ranks(x, at, PERIOD)
    done = PERIOD
    while done < wanted:  # the same residue is sampled a whole number of periods on
        step = min(done, (wanted - done) // PERIOD * PERIOD)
        if not step:
            break
        joined = _pair_ranks(rank[at], rank[at + step] + 1)
        rank[at] = joined
        done += step
    return rank


def check_length(length: int) -> None:
    if length % PERIOD or length < 2 * PERIOD:
        raise ValueError(f"the string length must be a multiple of {PERIOD}, {2 * PERIOD} at least")


def _intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _sort_buckets(length: int):
    """Sorts whole buckets, as many at once as make a block; rows come ordered by bucket and run."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def solve():
            texts = [t for *_, t in held]
            lengths = np.array([len(t) for t in texts])
            base = np.cumsum(lengths) - lengths
            n = lengths - length + 1
            starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mask = repeated(np.frombuffer(b"".join(texts), np.uint8), starts, length)
            spans = [_intervals(m) for m in np.split(mask, np.cumsum(n)[:-1])]
            keep = [i for i, s in enumerate(spans) if s]
            return record_batch(
                g=pa.array([held[i][0] for i in keep], pa.int64()),
                u1=pa.array([held[i][1] for i in keep], pa.int64()),
                u2=pa.array([held[i][2] for i in keep], pa.int64()),
                spans=pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in keep], SPANS),
            )

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for row in rows:
                if row[:3] == last:
                    continue  # one run fetched from several equal rows
                if held and size >= BLOCK_BYTES and row[0] != last[0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[:3]
        if held:
            yield solve()

    return run


def _signed(u: int) -> tuple[int, int]:
    return (u >> 64) - (1 << 63), (u & (2**64 - 1)) - (1 << 63)


def _run_rows(docs: DataFrame, id_kind: str, length: int, gram: int) -> DataFrame:
    """Every run of every text: bucket g, 128-bit hash u of the bytes its starts span, first start, starts."""

    def fn():
        def step(c):
            ids, out = [], []
            for i, raw in enumerate(c["raw"].to_pylist()):
                view = memoryview(raw)
                for g, offset, lo, n in runs(raw, length, gram):
                    u = xxhash.xxh3_128_intdigest(view[lo : lo + n + length - 1], offset)
                    out.append((g, *_signed(u), lo, n, offset))
                    ids.append(i)
                if len(out) > 200_000:
                    yield rows(c, ids, out)
                    ids, out = [], []
            if out:
                yield rows(c, ids, out)

        def rows(c, ids, out):
            take = pa.array(ids, pa.int64())
            cols = list(zip(*out, strict=True))
            return record_batch(
                id=c["id"].take(take), th=c["th"].take(take),
                **{k: pa.array(v, pa.int64()) for k, v in zip(("g", "u1", "u2", "lo", "n", "off"), cols, strict=True)},
            )

        return step

    return map_rows(docs, f"id {id_kind}, th bigint, g bigint, u1 bigint, u2 bigint, lo bigint, n bigint, off bigint", fn)


def _fetch(length: int):
    """The bytes of the wanted runs of each text; a task takes rows that repeat id and text once.

    Such rows carry one list of runs, and a run is wanted of one text only: the first of the list tells texts apart.
    """

    def fn():
        seen: set[tuple[int, int, int]] = set()

        def step(c):
            wanted = c["wanted"]
            offsets = np.asarray(wanted.offsets)
            firsts = wanted.flatten().take(pa.array(offsets[:-1] - offsets[0]))
            if len(seen) > MAX_SEEN:
                seen.clear()
            new = []
            for i, key in enumerate(zip(*(firsts.field(k).to_pylist() for k in ("g", "u1", "u2")), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if not new:
                return
            wanted = wanted.take(pa.array(new))
            flat = wanted.flatten()
            of = np.repeat(np.arange(len(wanted)), np.diff(np.asarray(wanted.offsets)))
            cols = {k: flat.field(k) for k in ("g", "u1", "u2", "off")}
            raws = c["raw"].take(pa.array(new)).to_pylist()
            lo, n = flat.field("lo").to_pylist(), flat.field("n").to_pylist()
            for a in range(0, len(of), 20_000):
                b = min(len(of), a + 20_000)
                texts = [raws[i][s : s + k + length - 1] for i, s, k in zip(of[a:b].tolist(), lo[a:b], n[a:b], strict=True)]
                yield record_batch(**{k: v[a:b] for k, v in cols.items()}, body=pa.array(texts, pa.binary()))

        return step

    return fn


RUN = "g bigint, u1 bigint, u2 bigint, off bigint, body binary"


def _cells(length: int, width: int):
    """Cuts runs into cells of ``width`` starts, counted from the bucket's gram, so that equal strings stand in like cells.

    A cell is keyed by the bytes that all its strings hold (k) and by all it spans (v).
    """

    def fn():
        def step(c):
            out = []
            for g, u1, u2, s, off, body in zip(*(c[k].to_pylist() for k in ("g", "u1", "u2", "s", "off", "body")), strict=True):
                view, n, at = memoryview(body), len(body) - length + 1, 0
                while at < n:
                    cell = (off - at) // width
                    end = min(n, off - cell * width + 1)  # starts from here to there have this cell
                    whole = view[at : end + length - 1]
                    seed = (g ^ (cell * 0x9E3779B97F4A7C15)) & (2**64 - 1)
                    shared = off - cell * width  # from the cell's last start to the end of its first string, met here or not
                    k = xxhash.xxh3_128_intdigest(view[shared : shared - width + 1 + length], seed)
                    v = xxhash.xxh3_128_intdigest(whole, end - at)
                    out.append((g, u1, u2, s + at, off - at, end - at, *_signed(k), *_signed(v), bytes(whole)))
                    at = end
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out):
            names = ("g", "u1", "u2", "s", "off", "n", "k1", "k2", "v1", "v2", "body")
            cols = dict(zip(names, zip(*out, strict=True), strict=True))
            return record_batch(**{k: pa.array(v, pa.binary() if k == "body" else pa.int64()) for k, v in cols.items()})

        return step

    return fn


def _by_cells(runs_: DataFrame, length: int) -> DataFrame:
    """(g, u1, u2, spans) of the repeated starts of hot buckets.

    A bucket is dealt out by the bytes its cells share. Cells met once are done with, cells whose whole text recurs are
    repeated as they stand, and only cells of one key and several texts are cut again, into single starts.
    """
    rows, parts = runs_.withColumn("s", F.lit(0).cast("long")), []
    for width in CELLS:
        schema = "g bigint, u1 bigint, u2 bigint, s bigint, off bigint, n bigint, k1 bigint, k2 bigint, v1 bigint, v2 bigint, body binary"
        cells = settle(map_rows(rows.select("g", "u1", "u2", "s", "off", "body"), schema, _cells(length, width)))
        place = F.struct("u1", "u2", "s")
        ends = [f(c).alias(f"{k}_{c}") for c in ("v1", "v2") for k, f in (("low", F.min), ("high", F.max))]
        mixed = (F.col("low_v1") != F.col("high_v1")) | (F.col("low_v2") != F.col("high_v2"))
        keys = cells.groupBy("k1", "k2").agg(F.min(place).alias("x"), F.max(place).alias("y"), *ends)
        keys = settle(keys.where("x <> y").select("k1", "k2", mixed.alias("mixed")))
        met = cells.join(keys, ["k1", "k2"])
        parts.append(met.where("NOT mixed").select("g", "u1", "u2", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1).alias("b")))
        rows = met.where("mixed")
    found = parts[0].union(parts[1])
    return found.groupBy("g", "u1", "u2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _merged(lows: np.ndarray, highs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [a, b) of repeated starts lows..highs."""
    order = np.argsort(lows, kind="stable")
    a, b = lows[order], np.maximum.accumulate(highs[order] + length)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], np.concatenate([b[:-1][new[1:]], b[-1:]])


def _removal(length: int, keep: bool):
    def fn():
        def step(c):
            spans = c["spans"]
            flat = spans.flatten()
            lows, highs = (np.asarray(flat.field(k).fill_null(0), np.int64) for k in ("a", "b"))
            counts = np.array([0 if s is None else s for s in pa.compute.list_value_length(spans).to_pylist()], np.int64)
            ends = np.cumsum(counts)
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_bytes": [], "removed": []}
            for raw, e, k in zip(c["raw"].to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                a = b = np.zeros(0, np.int64)
                if k:
                    a, b = _merged(lows[e - k : e], highs[e - k : e], length)
                cuts = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)) if k else raw
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(rest))
                out["n_spans"].append(len(a))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if keep:
                    out["kept_bytes"].append(rest)
                    out["removed"].append([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            more = {"kept_bytes": pa.array(out["kept_bytes"], pa.binary()), "removed": pa.array(out["removed"], SPANS)} if keep else {}
            yield record_batch(
                doc_id=c["id"],
                **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")},
                kept_sha256=pa.array(out["kept_sha256"], pa.string()),
                **more,
            )

        return step

    return fn


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 160, keep: bool = True
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep``, kept_bytes and removed spans.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in this or another document, is
    removed; overlaps count and strings are judged on the input. Matches never cross documents.

    Starts are dealt into buckets by the least hashed ``gram`` of their string, as runs of neighbouring starts
    (under one per hundred bytes). Buckets met once are done with. Runs whose whole text recurs are repeated
    as they stand. Only buckets that hold different texts fetch one copy of each, and are sorted a block of whole
    buckets at a time by ``repeated``; a bucket of more than ``HOT_RUNS`` different texts is dealt out by
    cells of starts instead and then by single starts, whose 128-bit hashes are counted, so that no bucket meets in
    one task. Documents are
    joined by id and text hash: rows that repeat both give equal rows, and share one list of spans. A null text is an empty one; texts shorter
    than ``length`` and empty tables lose nothing.
    """
    check_length(length)
    id_kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("th"), whole_text(text).cast("binary").alias("raw"))
    every = settle(_run_rows(keyed, id_kind, length, gram))
    buckets = every.groupBy("g").agg(
        F.count("*").alias("met"), *[f(c).alias(f"{k}_{c}") for c in ("u1", "u2") for k, f in (("low", F.min), ("high", F.max))]
    )
    mixed = (F.col("low_u1") != F.col("high_u1")) | (F.col("low_u2") != F.col("high_u2"))
    # written, so that the join reads two exchanges, of which a hot bucket's can be split
    buckets = settle(buckets.where("met > 1").select("g", mixed.alias("mixed")))
    again = settle(every.join(buckets, "g"))
    whole = again.where("NOT mixed").select("id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1).alias("b"))

    unclear = again.where("mixed").drop("mixed")
    texts = settle(
        unclear.groupBy("g", "u1", "u2").agg(F.count("*").alias("met"), F.min(F.struct("id", "th", "lo", "n", "off")).alias("rep"))
    )
    hot = settle(texts.groupBy("g").count().where(F.col("count") > HOT_RUNS).select("g"))
    wanted = texts.groupBy(F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")).agg(
        F.collect_list(F.struct("g", "u1", "u2", "rep.lo", "rep.n", "rep.off")).alias("wanted")
    )
    same_doc = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))
    bodies = settle(map_rows(keyed.join(wanted, same_doc).select("raw", "wanted"), RUN, _fetch(length)))
    kind = "g bigint, u1 bigint, u2 bigint, spans array<struct<a:bigint,b:bigint>>"
    cool = bodies.join(hot, "g", "left_anti").select("g", "u1", "u2", "body")
    cool = cool.repartition("g").dropDuplicates(["g", "u1", "u2"])  # in its partition; tasks may have fetched a text each
    sorted_spans = cool.sortWithinPartitions("g", "u1", "u2").mapInArrow(_sort_buckets(length), kind)
    hot_spans = _by_cells(bodies.join(hot, "g", "left_semi"), length)
    partly = sorted_spans.unionByName(hot_spans)
    met_again = texts.where("met > 1").select(
        "g", "u1", "u2", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("rep.n") - 1).alias("b"))).alias("spans")
    )
    once = texts.where("met = 1").select("g", "u1", "u2").join(partly, ["g", "u1", "u2"])
    found = unclear.join(met_again.unionByName(once), ["g", "u1", "u2"])
    parts = found.select("id", "th", "lo", F.explode("spans").alias("p")).select(
        "id", "th", (F.col("lo") + F.col("p.a")).alias("a"), (F.col("lo") + F.col("p.b")).alias("b")
    )
    spans = settle(whole.union(parts)).groupBy(F.col("id").alias("rep_id"), F.col("th").alias("rep_th")).agg(
        F.collect_set(F.struct("a", "b")).alias("spans")  # each of N rows that repeat id and text brings the same spans
    )
    ready = keyed.join(spans, same_doc, "left").select("id", "raw", "spans")
    schema = f"doc_id {id_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if keep:
        schema += ", kept_bytes binary, removed array<struct<a:bigint,b:bigint>>"
    return map_rows(ready, schema, _removal(length, keep))
