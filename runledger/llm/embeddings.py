"""Embedding near-dedup by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch
from runledger.llm.components import components
from runledger.session import settle

_SLACK = 1e-9  # above the rounding of the float64 bounds
_PAIRS = 32_768  # pairs recomputed at once


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8, their scales, and for each row the norm of what the rounding lost."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q, scale, lost


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tile_bounds(p, s, e, q, t, f) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible x[i].y[j] of unit vectors, from their codes, scales and losses.

    Of quantised forms x', y' with losses e, f, |x.y - x'.y'| <= e + f + e f. The int8 product is
    exact: sums below 2^24 come out of the float32 product unrounded up to 1,040 dimensions, blocks of dimensions
    beyond.
    """
    width = 1_024
    dots = sum(
        (p[:, k : k + width].astype(np.float32) @ q[:, k : k + width].astype(np.float32).T).astype(np.float64)
        for k in range(0, p.shape[1], width)
    ) * (s[:, None] * t[None, :])
    err = e[:, None] + f[None, :] + e[:, None] * f[None, :] + _SLACK
    return dots - err, dots + err


def exact_links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some index pairs have x[i].y[j] >= threshold in double precision."""
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), _PAIRS):
        good[k : k + _PAIRS] = np.einsum("nd,nd->n", x[i[k : k + _PAIRS]], y[j[k : k + _PAIRS]]) >= threshold
    return good


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with x[i].y[j] >= threshold in double precision; only pairs the bounds leave open are computed in full."""
    low, high = tile_bounds(*quantise(x), *quantise(y))
    i, j = np.nonzero(low >= threshold)
    u, v = np.nonzero((low < threshold) & (high >= threshold))
    good = exact_links(x, y, u, v, threshold)
    return np.concatenate([i, u[good]]), np.concatenate([j, v[good]])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile_pair(threshold: float, full: bool):
    """Task function over the vectors of two tiles: per vector its links there, the root of its star, and whether a pair stays open.

    At first only codes are at hand: pairs whose bounds both reach the threshold are links, and the vectors of pairs that the
    bounds leave open are marked. With ``full`` vectors of the marked ones, just the open pairs are decided.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i_tile, j_tile = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("node", kind="stable").reset_index(drop=True)
        nodes, copies, tile = group["node"].to_numpy(), group["copies"].to_numpy(), group["tile"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.int8) for c in group["code"]])
        scale, lost = group["scale"].to_numpy(), group["lost"].to_numpy()
        left, right = np.flatnonzero(tile == i_tile), np.flatnonzero(tile == j_tile)
        low, high = tile_bounds(codes[left], scale[left], lost[left], codes[right], scale[right], lost[right])
        if i_tile == j_tile:
            low[np.tril_indices(len(left))] = high[np.tril_indices(len(left))] = -2.0
        u, v = np.nonzero((low < threshold) & (high >= threshold))
        if full:
            x = unit_rows(group["vector"])
            good = exact_links(x[left], x[right], u, v, threshold)
            a, b = left[u[good]], right[v[good]]
            u, v = u[:0], v[:0]
        else:
            i, j = np.nonzero(low >= threshold)
            a, b = left[i], right[j]
        open_ = np.zeros(len(nodes), bool)
        open_[left[u]] = open_[right[v]] = True
        count = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        root = nodes[local_roots(len(nodes), a, b)]
        out = pd.DataFrame(
            {
                "kind": group["kind"], "i": i_tile, "j": j_tile, "tile": tile, "node": nodes,
                "links": count.astype(np.int64), "root": root, "open": open_,
            }
        )
        return out[(out["links"] > 0) | out["open"]]

    return run


_FOUND = "kind bigint, i int, j int, tile int, node bigint, links bigint, root bigint, open boolean"


def _coded(nodes: DataFrame) -> DataFrame:
    """(kind, tiles, node, copies) with the int8 code, scale and loss of each vector."""

    def fn():
        def step(c):
            sizes = np.array([len(v) for v in c["vector"]])
            codes, scale, lost = [b""] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                q, s, e = quantise(unit_rows(c["vector"].take(pa.array(at)).to_pylist()))
                scale[at], lost[at] = s, e
                for k, row in zip(at.tolist(), q, strict=True):
                    codes[k] = row.tobytes()
            yield record_batch(
                **{n: c[n] for n in ("kind", "tiles", "node", "copies")},
                code=pa.array(codes, pa.binary()), scale=pa.array(scale), lost=pa.array(lost),
            )

        return step

    return map_rows(nodes, "kind bigint, tiles int, node bigint, copies bigint, code binary, scale double, lost double", fn)


def embedding_groups(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    tile: int = 2_048,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label are linked at a cosine of ``threshold`` or more. Equal vectors of a label are
    folded into one with a count, so copies are never paired with each other. The rest of a label is dealt over
    hash tiles of about ``tile`` vectors and every pair of tiles is one group: a hot label becomes many groups
    of bounded size. What travels to the groups is each vector's int8 code with its scale and loss; bounds decide nearly all pairs, and
    the vectors of the rest are fetched in full. A group returns counts and a spanning star per vector, never its pairs. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are their own component, as are
    vectors of other dimensions. ``component_id`` is the smallest id reachable; repeated rows are vectors of their
    own. An empty table gives no row.
    """
    v = F.col(embedding).cast("array<double>")
    sound = (
        F.col(label).isNotNull()
        & F.coalesce(F.size(v) > 0, F.lit(False))
        & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    )
    rows = settle(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(vec_id).alias("vec_id"),
            F.col(label).alias("label"),
            F.when(sound, F.transform(v, lambda c: c + F.lit(0.0))).alias("vector"),
        )
    )
    whole = rows.where(F.col("vector").isNotNull()).withColumn("digest", F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256))
    nodes = settle(
        whole.groupBy("label", "digest").agg(
            F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.min("vector").alias("vector")
        )
    )
    size = F.size("vector")
    kinds = nodes.groupBy(F.col("label").alias("its_label"), size.alias("its_size")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    kinds = settle(kinds.withColumn("kind", F.monotonically_increasing_id()))
    dealt = nodes.join(kinds, (F.col("label") == F.col("its_label")) & (size == F.col("its_size")))
    coded = settle(
        _coded(dealt.select("kind", "tiles", "node", "copies", "vector")).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = coded.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    met = settle(paired.drop("tiles", "other").groupBy("kind", "i", "j").applyInPandas(_tile_pair(threshold, full=False), _FOUND))
    # only vectors of pairs that the bounds leave open are fetched in full, and meet again in their pair of tiles
    asked = met.where("open").select("kind", "i", "j", "tile", "node")
    fetched = asked.join(coded.select("node", "copies", "code", "scale", "lost"), "node").join(nodes.select("node", "vector"), "node")
    decided = settle(fetched.groupBy("kind", "i", "j").applyInPandas(_tile_pair(threshold, full=True), _FOUND))
    found = met.where("links > 0").unionByName(decided)
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = (
        nodes.select("label", "digest", "node", "copies", "first_id")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("label", "digest", "copies", "first_id", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "node").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = rooted.join(smallest, "root").select(
        "label", "digest", (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component_id"
    )
    linked = whole.select("row", "vec_id", "label", "digest").join(by_class, ["label", "digest"])
    alone = rows.where(F.col("vector").isNull())
    out = linked.select("vec_id", "n_links", "component_id").union(
        alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
