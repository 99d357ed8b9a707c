"""Tokens, sharding, mixing, the pipeline and the SQL twins."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from runledger.llm import bpe, exact, langid, mixing, quality, queries, sharding, simhash, toxicity
from runledger.llm.common import id_remainder
from tests.llm import brute
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe.from_file(queries.TOKENIZER)


def odd_texts(coder):
    rng = random.Random(1)
    texts = [None, "", " ", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "x" * 5000, "\x00\x01 é́ 日本語 😀👍🏽", "  \n\n\t  a  "]
    texts += ["don't I'LL we've 123 ½ Ⅷ", " 　 x  y\x85z\x1c\x1d", " ᠎", "ab" * 40, "\U0001d400" * 30]
    texts += ["".join(rng.choice("abcdetheinaorst  ABC01!'<|>\né中") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    tokens = [w.decode("utf8", "ignore") for w in rng.sample(sorted(coder.proposed), 2000)]
    return texts + ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) for _ in range(1500)]


def test_tokens_are_those_of_the_library(spark, coder):
    texts = odd_texts(coder)
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r["doc_id"]: r for r in bpe.encode(docs, queries.TOKENIZER).collect()}
    for i, ids in enumerate(want):
        r, decoded = rows[i], library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded, texts[i]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {i: r["decoded"] for i, r in rows.items()}
    assert bpe.encode(docs.limit(0), queries.TOKENIZER).count() == 0


def test_tokens_of_the_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, queries.TOKENIZER).collect()} == want


def test_pair_checks_agree_with_merging(coder):
    rng = random.Random(3)
    words = [coder.ids[w] for w in rng.sample(sorted(coder.proposed), 3000)]
    a, b = np.array(words[:1500]), np.array(words[1500:])
    got = coder.compatible(a, b)
    want = [coder.merge(coder.token[x] + coder.token[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_both_ways_of_merging_agree(coder):
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabbcdeet hin") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    assert [m.tolist() for m in coder.merge_all(words)] == [coder.merge(w) for w in words]


def test_words_beyond_the_memory_of_a_task(coder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 3)
    known = {}
    first = coder.encode_batch(["one two three four five six"], known)
    assert coder.encode_batch(["one two three four five six"], known) == first


def test_other_tokenizers_are_refused(coder):
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.ByteBpe.from_file("/opt/tokenizers/word_bpe_49k.json")


def test_lookup_table_is_a_plain_replay():
    shards, slots = [f"s{i}" for i in range(7)], 211
    orders = [[(o + k * s) % slots for k in range(slots)] for o, s in (sharding._preference(x, slots) for x in shards)]
    table, turn = {}, 0
    while len(table) < slots:
        i = turn % len(shards)
        table[next(c for c in orders[i] if c not in table)] = i
        turn += 1
    assert sharding.lookup_table(shards, slots) == [table[c] for c in range(slots)]
    counts = np.bincount(sharding.lookup_table(shards, slots))
    assert counts.max() - counts.min() <= 1
    for wrong in ((["a"], 10), (["a", "a"], 11), ([], 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*wrong)


def test_placement(spark):
    rows = [(1, "x"), (1, "x"), (None, "y"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, shard string")
    out = sharding.place(df, "doc_id", ["a", "b", "c"], 101)
    assert out.columns == ["doc_id", "slot", "shard"]
    got = out.collect()
    slot = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % 101
    assert sorted(r["slot"] for r in got) == sorted([slot("1"), slot("1"), slot(""), slot("2")])
    assert sharding.place(df.limit(0), "doc_id", ["a"], 101).count() == 0
    many = sharding.place(spark.range(50_000), "id", queries.SHARDS).groupBy("shard").count().collect()
    assert len(many) == 256 and max(r["count"] for r in many) < 300
    fewer = sharding.place(spark.range(5_000), "id", queries.SHARDS[:-1]).withColumnRenamed("shard", "after").drop("slot")
    moved = sharding.place(spark.range(5_000), "id", queries.SHARDS).join(fewer, "id").where("shard <> after").count()
    assert moved < 300


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 4000]) for s in ["b", "a", None, "Z", "é", "a1"]}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = brute.mix_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    plan = mixing.mix_plan(docs).toPandas()
    assert (plan["taken"] <= 3 * plan["size"]).all()
    by = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), biggest=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["biggest"]).all()
    assert plan.sort_values("doc_id").reset_index(drop=True).equals(mixing.mix_plan(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan["copies"].sum()


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "s"), (None, "x " * 100, "t"), (4, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS copies")
    plan = mixing.mix_plan(docs).collect()
    assert sorted(r["size"] for r in plan) == [0, 0, 2, 2, 100]
    assert {r["target"] for r in plan if r["source"] in ("s", "empty")} == {0.0}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_of_one_id_draw_for_themselves(spark):
    for rows in (
        [(None, "w " * 100, "a")] * 50 + [(i, "w " * 100, "b") for i in range(50)],
        [(None, f"{i} " * 100, "a") for i in range(50)] + [(i, "w " * 100, "b") for i in range(50)],
        [(7, "w " * 100, "a")] * 50 + [(7, f"{i} w " * 50, "b") for i in range(50)],
    ):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
        plan = mixing.mix_plan(docs).toPandas()
        by = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        assert ((by["taken"] - by["target"]).abs() <= 500).all(), by
        again = mixing.mix_plan(docs.repartition(3)).toPandas()
        key = ["doc_id", "source", "text_key", "copies"]
        assert plan.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
        mixed = mixing.mix(docs)
        assert mixed.groupBy("source").count().toPandas().set_index("source")["count"].to_dict() == (by["taken"] // 100).to_dict()


def test_columns_of_any_name_come_through(spark):
    """Columns named as those that operators add for themselves are neither lost nor in the way."""
    names = ["_text_key", "_copy", "_kept_id", "_kept_key", "_digest", "_n_bytes", "_n_chars", "_kept_digest", "_kept_n_bytes", "_key_slot", "_slot",
             "_shard", "_copies", "_id", "_source", "_time", "_whole_text", "_quality_score", "_key", "_equal", "_times", "_nth", "_row", "_slice", "_at", "_COPY"]
    rows = [(i, f"some words {i // 2} " * 5, "s", *[f"{n}{i}" for n in names[:-1]]) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names[:-1]])
    net, gru, crf = quality.train([]), toxicity.train([("a b", 1), ("c d", 0)], steps=2), langid.train([("a b", "x")])
    want = {tuple(r) for r in docs.collect()}
    for out in (
        simhash.drop_near_copies(docs), exact.drop_exact_copies(docs), mixing.mix(docs), quality.keep_good(docs, net),
        mixing.mix(docs.unionByName(docs)), sharding.place(docs, "doc_id", ["a", "b"], 11).drop("slot", "shard"),
        toxicity.score(docs, gru, out="tox").drop("tox"), langid.identify(docs, crf).drop("lang_pred", "score"),
        quality.score(docs, quality.train([("a", 1), ("b", 0)], epochs=1, steps=1), out="q").drop("q"),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and {tuple(r) for r in got} <= want
    assert exact.drop_exact_copies(docs).count() == 4 and quality.keep_good(docs, net).count() == 8


def test_native_operators_run_no_python(spark, small):
    for name in ("op6_exact_dedup", "op8_sharding"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, medium, name):
    got = queries.QUERIES[name](spark, medium).toPandas()
    assert len(got)
    assert not compare(got, connect(medium).execute(queries.ORACLES[name]).df())


def test_pipeline_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    net = quality.fit(docs, labels, id_remainder(4) != 2)
    rows = {r["doc_id"]: r for r in docs.collect()}
    tables = net.tables()
    kept = {i: r for i, r in rows.items() if quality.score_text(r["text"], net.params, tables) >= 0.7}
    groups = brute.exact_groups([(i, r["text"]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if groups[i][2]}
    near = brute.simhash_groups([(i, r["text"]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    got: dict[int, int] = {}
    library = Tokenizer.from_file(queries.TOKENIZER)
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r["n_tokens"] == len(library.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids)
    assert got == {i: n for i, n in plan.items() if n}


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert exact.drop_exact_copies(docs).count() == sum(r["kept"] for r in exact.exact_groups(docs).collect())
