"""Exact, near and substring dedup, embeddings: brute force and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import components, embeddings, exact, simhash, suffixes
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÀÉ", "日本", "A", "b"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE\x0btwo"), (7, " x \x85 y"), (8, "a" * 3000)]
    for i in range(10, 60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))))
    for i in range(60, 90):  # near and exact copies
        base = rows[rng.randrange(8, 50)][1].split(" ")
        if i % 3:
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, ("  " if i % 2 else " ").join(base)))
    return rows


def test_components_of_a_long_chain_and_a_hot_node(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (160, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = brute.components({n for p in pairs for n in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != 5}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_fingerprints_and_links(spark):
    rows = odd_rows()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert got == brute.simhash_groups(rows)


def test_simhash_links_of_all_distances(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for n in range(5):
            y = x
            for bit in rng.sample(range(64), n):
                y ^= 1 << bit
            prints.add(y - (1 << 64) if y >> 63 else y)
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = sorted((r["a"], r["b"]) for r in simhash.links(table).collect())
    want = sorted((a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_links_is_broadcast(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("fp")).write.parquet(f"{tmp_path}/p")  # Spark takes 33 rows of each for less than one
    found = simhash.links(spark.read.parquet(f"{tmp_path}/p"))
    assert "SortMergeJoin" in plan_of(found) and "Broadcast" not in plan_of(found)
    assert found.count() == sum((a ^ b).bit_count() <= 2 for b in range(300) for a in range(b))


def test_digests_of_all_levels_are_not_broadcast_at_once(spark):
    found = exact.exact_groups(frame(spark, odd_rows()), rounds=3)
    assert plan_of(found).count("SortMergeJoin") == 4 and "Broadcast" not in plan_of(found)


def test_simhash_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text) == whole == brute.simhash(text)


def test_simhash_on_the_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert got == brute.simhash_groups(rows)


def test_near_copies_leave_one_row(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "quite other words here"), (None, "a b c d"), (None, "alone at last it is")]
    docs = frame(spark, rows)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3]
    assert simhash.drop_near_copies(frame(spark, [])).count() == 0


def test_near_copies_of_rows_that_share_an_id(spark):
    one, two, three = "a b c d", "quite other words here", "alone at last it is"
    rows = [(1, one), (None, one), (None, two), (None, two), (None, three), (5, one), (5, "and yet another text")]
    out = simhash.drop_near_copies(frame(spark, rows)).collect()
    want = [(0, three), (0, two), (1, one), (5, "and yet another text")]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == want


def test_exact_groups(spark):
    rows = odd_rows()
    docs = frame(spark, rows).withColumnRenamed("n_chars", "size")  # a clashing name
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(docs, rounds=3).collect()}
    assert got == brute.exact_groups(rows)
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_exact_copies_of_repeated_and_nameless_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab "), (None, "ab"), (None, "x"), (None, "x"), (7, "x"), (8, None), (9, "")]
    docs = frame(spark, rows)
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, "a b"), (7, "x"), (8, "")]
    assert sum(r["kept"] for r in exact.exact_groups(docs).collect()) == 3


def passages():
    rng = random.Random(2)
    letters = "abcdefgh é日"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared, edge = text(700), text(398)
    rows = [None, "", "x" * 399, "x" * 400, "y" * 1500, shared, shared, text(300) + shared + text(200), text(50) + shared[100:600]]
    rows += [edge + text(300), edge + text(300), text(900) + shared[:350] + text(10), "ab" * 500, text(3000)]
    base = text(2500)
    for i in range(6):
        cut = list(base)
        for _ in range(i):
            cut[rng.randrange(len(cut))] = "#"
        rows.append("".join(cut))
    return rows


@pytest.mark.parametrize("hot", [10**6, 2])
def test_repeats_are_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)  # every bucket sorted, or most dealt out by starts
    texts = passages()
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, want in enumerate(brute.removed(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert len(r["kept_bytes"]) == r["n_bytes"] - r["n_removed"] and len(r["removed"]) == r["n_spans"]


def test_repeats_of_segments_rows_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 9)
    texts = passages()
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(frame(spark, list(enumerate(texts))), length=240, gram=96).collect()}
    assert [got[i] for i in range(len(texts))] == [n for _, n, _, _ in brute.removed(texts, 240)]
    twice = frame(spark, [(None, "z" * 3 + "".join(map(str, range(300))))] * 2 + [(3, "q" * 20)])
    assert sorted(r["n_removed"] for r in suffixes.remove_repeats(twice).collect()) == [0, 793, 793]
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(twice, length=401)


def test_repeats_on_the_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, keep=False).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.removed([t for _, t in rows]), strict=True)}


def test_a_cover_reaches_every_pair():
    cover, shift = suffixes.difference_cover(80)
    r = np.arange(80)
    assert np.isin((r[:, None] + shift) % 80, cover).all() and np.isin((r[None, :] + shift) % 80, cover).all()


def test_quantisation_bounds_hold_and_tiles_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64))
    x = embeddings.unit_rows(list(np.repeat(base, 10, 0) + rng.normal(0, 0.12, (300, 64))))
    q, s, e = embeddings.quantise(x)
    assert (np.abs(x - q * s[:, None]) <= s[:, None] / 2 + 1e-12).all()
    i, j = embeddings.tile_links(x, x, 0.93)
    want = np.argwhere(x @ x.T >= 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_pairs_left_open_by_the_bounds_are_decided_in_full(spark):
    """Cosines on both sides of the threshold and within a hair of it, between vectors that share no tile, too."""
    rng, rows, at = np.random.default_rng(11), [], 0.93
    for k in range(60):
        a, b = np.linalg.qr(rng.normal(size=(48, 2)))[0].T
        cos = at + (0, 1e-13, -1e-13, 1e-6, -1e-6, 5e-3, -5e-3)[k % 7] * (1 if k % 7 else 0)
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, (cos * a + np.sqrt(1 - cos * cos) * b).tolist(), k)]
    rows = [(i, v, 0) for i, v, _ in rows]
    x = embeddings.unit_rows([v for _, v, _ in rows])
    low, high = embeddings.tile_bounds(*embeddings.quantise(x), *embeddings.quantise(x))
    dots = x @ x.T
    assert (low <= dots).all() and (dots <= high).all() and ((low < at) & (high >= at)).sum() > 50
    linked = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if float(np.einsum("d,d->", x[i], x[j])) >= at]
    roots = brute.components(range(len(x)), linked)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for tile in (16, 2048):
        got = {r["vec_id"]: r for r in embeddings.embedding_groups(table, tile=tile).collect()}
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (sum(i in p for p in linked), roots[i]) for i in range(len(x))}


def test_embedding_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.08, 16)).tolist(), int(i % 6 < 4)) for i in range(80)]
    rows += [(100 + i, base[0].tolist(), 1) for i in range(5)] + [(120, base[0].tolist(), None), (121, None, 1), (122, [0.0] * 16, 1)]
    rows += [(123, [float("nan")] * 16, 1), (124, [None] * 16, 1), (125, [1.0, 2.0], 1), (126, [], 1), (127, [float("inf")] * 16, 1)]
    rows += [(128, (base[0] * 1e-30).tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a, b) for a, u, y in good for b, v, z in good if a < b and y == z and len(u) == len(v) and u @ v >= 0.93]
    roots = brute.components([i for i, _, _ in rows], linked)
    for tile in (8, 2048):
        got = {r["vec_id"]: r for r in embeddings.embedding_groups(table, tile=tile).collect()}
        assert len(got) == len(rows)
        for i, _, _ in rows:
            n = sum(i in p for p in linked)
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, roots[i], roots[i] == i), i
    assert embeddings.embedding_groups(table.limit(0)).count() == 0


def test_repeated_rows_share_spans_and_bodies(spark, monkeypatch):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(1_500))
    other = body[:700] + "".join(rng.choice("xyz ") for _ in range(900))
    settled, tables = suffixes.settle, []
    monkeypatch.setattr(suffixes, "settle", lambda df: tables.append(settled(df)) or tables[-1])
    removal = suffixes._removal

    def counting(length, keep):
        def fn():
            step = removal(length, keep)()

            def counted(c):
                sizes = [0 if s is None else len(s) for s in c["spans"].to_pylist()]
                for batch in step(c):
                    yield batch.set_column(batch.schema.get_field_index("n_spans"), "n_spans", suffixes.pa.array(sizes, "int64"))

            return counted

        return fn

    seen = []
    for copies in (2, 300):
        tables.clear()
        docs = frame(spark, [(None, body)] * copies + [(1, other)])
        plain = {(r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(docs, keep=False).collect()}
        assert plain == {(None, 1_500), (1, 700)}
        bodies = [t.count() for t in tables if "body" in t.columns and "off" in t.columns and "s" not in t.columns]
        with monkeypatch.context() as m:
            m.setattr(suffixes, "_removal", counting)
            rows = suffixes.remove_repeats(docs, keep=False).collect()
        assert len(rows) == copies + 1
        seen.append((max(r["n_spans"] for r in rows), bodies))
    spans, bodies = zip(*seen, strict=True)
    assert spans[0] == spans[1] < 200
    assert len(bodies[0]) == len(bodies[1]) == 1 and 0 < bodies[1][0] <= 8 * bodies[0][0]  # at most one a task
