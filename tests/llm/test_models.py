"""Trained operators: held-out accuracy, exact inference, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import langid, quality, queries, toxicity
from runledger.llm.common import bounded_text, class_sample, id_remainder, labelled_sample


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def odd(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !!", None), (4, "word " * 30_000, "c"), (5, "Ü", "d"), (5, "Ü", "d"), (None, "x y", "e")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string")


def test_ids_part_as_crc32(spark):
    got = [r[0] for r in spark.range(200).select(id_remainder(5, "id")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(200)]


def test_samples_are_bounded(spark, tables):
    docs, labels = tables
    learn = id_remainder(5) != 0
    rows = labelled_sample(docs, labels, "toxic", learn, 20, 500)
    assert [sum(y == v for _, y in rows) for v in (0, 1)] == [20, 20] and all(len(t) <= 500 for t, _ in rows)
    assert rows == labelled_sample(docs, labels, "toxic", learn, 20, 500)
    some = class_sample(docs, "lang", learn, 15, 500)
    assert all(sum(y == v for _, y in some) <= 15 for v in ("de", "en", "es", "fr")) and len(some) > 40
    assert labelled_sample(docs, labels.limit(0), "toxic", learn, 20, 500) == []


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where("held_out").select(label, "score").collect()
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return ((s >= threshold) == y).mean(), (s[y == 1] >= threshold).mean(), (s[y == 0] < threshold).mean()


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    held_out = id_remainder(4) == 2
    net = quality.fit(docs, labels, ~held_out, per_class=400)
    scored = quality.score(docs, net).withColumn("held_out", held_out)
    assert all(v > 0.97 for v in accuracy(scored, labels, "quality", 0.7))
    out = quality.score(odd(spark), net)
    assert out.columns == ["doc_id", "text", "score"]
    assert out.count() == 7 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.keep_good(odd(spark).limit(0), net).count() == 0
    assert set(quality.keep_good(docs, net).columns) == set(docs.columns)


def test_quality_sees_the_end_of_a_long_text():
    net = quality.train([("plain words here " * 9, 1), ("## !! ## !! " * 9, 0)] * 20, epochs=20)
    tables = net.tables()
    clean = "plain words here " * 6_000
    chunks = lambda t: quality.half_peaks(quality._padded(t.encode()), tables, net.params["r"])
    assert len(chunks(clean)) == -(-len(clean) // quality.HALF)
    assert chunks(clean + "## !! ## !! " * 3)[-1].tolist() != chunks(clean)[-1].tolist()


def test_quality_peaks_match_a_plain_convolution():
    rng = np.random.default_rng(0)
    net = quality.ByteCnn.fresh()
    raw = bytes(rng.integers(97, 103, 700).astype(np.uint8))
    x = quality._padded(raw)
    again, p = quality.repeats(x), net.params
    want = np.array([
        sum(p["w"][j][x[i + j]] for j in range(4)) + p["b"] + p["r"] * again[i] for i in range(len(x) - quality.WIDTH)
    ]).reshape(-1, quality.HALF, quality.FILTERS).max(1)
    assert np.allclose(quality.half_peaks(x, net.tables(), p["r"]), want, atol=1e-4)
    for i in range(len(x) - 8):
        assert again[i] == any(i >= g and (x[i - g : i - g + 8] == x[i : i + 8]).all() and x[i : i + 8].any() for g in quality.LAGS)


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    held_out = id_remainder(5) == 0
    net = toxicity.fit(docs, labels, ~held_out)
    scored = toxicity.score(docs, net).withColumn("held_out", held_out)
    assert all(v > 0.85 for v in accuracy(scored, labels, "toxic", 0.5))
    out = toxicity.score(odd(spark), net)
    assert out.columns == ["doc_id", "text", "score"]
    assert out.count() == 7 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.score(odd(spark).limit(0), net).count() == 0


def test_toxicity_gradients_are_those_of_the_loss():
    net = toxicity.GruNet.fresh()
    p = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(9, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))])
    ids = np.array([[0, 1, 2, 3, 4], [5, 6, 7, -1, -1]])
    gates = lambda: {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
    trace = {}
    z = toxicity.run_windows(p, gates(), ids, trace)
    g, dx = toxicity.gradients(p, x, ids, trace, np.ones(2, np.float32))
    for name in ("wf", "rb", "a", "o", "cf"):
        at = np.unravel_index(3, p[name].shape)
        p[name][at] += 1e-3
        moved = toxicity.run_windows(p, gates(), ids)
        p[name][at] -= 1e-3
        assert abs((moved - z).sum() / 1e-3 - g[name][at]) < 2e-2, name
    x[6, 2] += 1e-3
    assert abs((toxicity.run_windows(p, gates(), ids) - z).sum() / 1e-3 - dx[6, 2]) < 2e-2


def test_windows_cover_every_word():
    for n in (0, 1, 24, 25, 42, 43, 100, 1000):
        w = toxicity.windows(np.arange(n))
        assert set(w[w >= 0].ravel().tolist()) == set(range(n)) and w.shape[1] == toxicity.WINDOW


def test_marginals_match_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths, k = np.array([1, 5, 16, 17, 40, 33, 0, 100]), 3
    scores, moves = rng.normal(0, 2, (lengths.sum(), k)), rng.normal(0, 1, (k, k))
    got, at = langid.forward_backward(scores, lengths, moves), 0
    for n in lengths:
        if not n:
            continue
        e, a = np.exp(scores[at : at + n]), np.exp(moves)
        alpha, beta = [e[0]], [np.ones(k)]
        for t in range(1, n):
            alpha.append((alpha[-1] @ a) * e[t])
        for t in range(n - 1, 0, -1):
            beta.append(a @ (e[t] * beta[-1]))
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_language_on_held_out_rows_and_switched_text(spark, tables):
    docs, _ = tables
    held_out = id_remainder(5) == 0
    model = langid.fit(docs, ~held_out)
    rows = langid.identify(docs, model).where(held_out).select("lang", "lang_pred").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.97
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(odd(spark), model, spans=True).collect()}
    assert [out[k]["lang_pred"] for k in ((1, None), (2, ""), (3, "123 !!"))] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in out.values())
    texts = {r["lang"]: r["text"] for r in docs.where(held_out & (docs.n_chars > 800)).select("lang", "text").collect()}
    half = lambda t: langid.words_of(t)[:60]
    words, p = langid.Labeller(model).marginals([" ".join(half(texts["de"]) + half(texts["es"]))])[0]
    got = [model.labels[i] for i in p.argmax(1)]
    assert got[:60].count("de") > 45 and got[60:].count("es") > 45


def test_nothing_to_learn_from(spark):
    none = odd(spark).limit(0).withColumn("lang", F.col("score"))
    model = langid.train([])
    assert {r["lang_pred"] for r in langid.identify(odd(spark), model).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
    for net in (quality.train([("a", 1)]), quality.train([])):
        assert {r["score"] >= quality.THRESHOLD for r in quality.score(odd(spark), net).collect()} == {True}
    scored = toxicity.score(odd(spark), toxicity.train([]))
    assert {r["score"] < toxicity.THRESHOLD for r in scored.collect()} == {True} and scored.columns == ["doc_id", "text", "score"]


def test_only_letters_make_words(spark):
    assert langid.words_of("½ ² Ⅷ ① 12 _ x²y ÄÖ ñ 日本 é１") == ["x", "y", "äö", "ñ", "日本", "é"]
    model = langid.train([("der hund und die katze", "de"), ("the dog and the cat", "en")])
    docs = spark.createDataFrame([(1, "½ ② Ⅷ"), (2, "the ½ dog")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {1: "und", 2: "en"}


def test_a_language_of_long_texts_only_is_learned(spark):
    texts = {"de": "der hund und die katze schlafen ", "en": "the dog and the cat are sleeping "}
    docs = spark.createDataFrame([(2 * i + (k == "de"), texts[k] * (2_000 if k == "de" else 3), k) for i in range(30) for k in texts], "doc_id bigint, text string, lang string")
    some = class_sample(docs, "lang", F.lit(True), 200, 4_000)
    assert {y for _, y in some} == {"de", "en"} and all(len(t) <= 4_000 for t, _ in some)
    model = langid.fit(docs, F.lit(True))
    got = {(r["lang"], r["lang_pred"]) for r in langid.identify(docs, model).collect()}
    assert got == {("de", "de"), ("en", "en")}


def test_long_texts_are_labelled_in_pieces_like_one_chain(monkeypatch):
    rng = np.random.default_rng(2)
    model = langid.train([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("el perro y el gato", "es")])
    words = "der hund und die katze the dog and cat el perro y gato".split()
    texts = [" ".join(rng.choice(words, n)) + " 12 !" for n in (1, 30, 400, 2_000)] + ["x" * 300, " 1" * 200]
    whole = langid.Labeller(model).languages(texts)
    for size in (7, 90, 1_000):
        monkeypatch.setattr(langid, "LONG", size)
        pieces = langid.Labeller(model).languages(texts)
        assert [p[0] for p in pieces] == [w[0] for w in whole]
        assert np.allclose([p[1] for p in pieces], [w[1] for w in whole], atol=1e-9)


def test_toxic_passage_scores_alike_wherever_it_stands():
    clean = "plain words that say nothing bad stand here and there in a quiet row of text".split()
    bad = "you horrid stupid fool get lost you worthless idiot nobody wants you here".split()[: toxicity.STRIDE]
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        words = list(rng.choice(clean, 60))
        if i % 2:
            at = int(rng.integers(0, 50))
            words[at:at] = bad
        rows.append((" ".join(words), i % 2))
    scorer = toxicity.Scorer(toxicity.train(rows))
    base = list(rng.choice(clean, 200))
    z = scorer.logits([" ".join(base[:at] + bad + base[at:]) for at in range(200)] + [" ".join(base)])
    assert (z[:-1] > 0).all() and z[-1] < 0


def test_scores_match_plain_versions(spark, tables):
    docs, labels = tables
    some = docs.where("doc_id < 60")
    net = toxicity.train([(r["text"], r["doc_id"] % 2) for r in some.collect()], steps=20)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(some, net).collect()}
    p = net.params
    for r in some.where("doc_id < 12").collect():
        words = toxicity.words_of(r["text"])
        x = net.inputs(words).astype(np.float64)
        best = -np.inf
        starts = [0] if len(words) <= toxicity.WINDOW else sorted({*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW})
        for s in starts:
            part = x[s : s + toxicity.WINDOW]
            states = np.zeros((len(part), 2 * toxicity.HIDDEN))
            for k, d in enumerate("fb"):
                h, n = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
                for t in range(len(part)) if d == "f" else range(len(part) - 1, -1, -1):
                    g = part[t] @ p[f"w{d}"] + p[f"c{d}"]
                    zr = 1 / (1 + np.exp(-(g[: 2 * n] + h @ p[f"r{d}"][:, : 2 * n])))
                    new = np.tanh(g[2 * n :] + (zr[n:] * h) @ p[f"r{d}"][:, 2 * n :])
                    h = h + zr[:n] * (new - h)
                    states[t, k * n : (k + 1) * n] = h
            e = np.exp(states @ p["a"] - (states @ p["a"]).max())
            best = max(best, float((states * (e / e.sum())[:, None]).sum(0) @ p["o"] + p["d"][0]))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-best))) < 1e-3
    cnn = quality.train([(r["text"], r["doc_id"] % 2) for r in some.collect()], epochs=2, steps=10)
    got = {r["doc_id"]: r["score"] for r in quality.score(some, cnn).collect()}
    q = cnn.params
    for r in some.where("doc_id < 6").collect():
        x = quality._padded(r["text"].encode())
        again, n = quality.repeats(x), len(x) - quality.WIDTH
        resp = np.array([sum(q["w"][j][x[i + j]] for j in range(quality.WIDTH)) + q["b"] + q["r"] * again[i] for i in range(n)])
        halves = resp.reshape(-1, quality.HALF, quality.FILTERS).max(1)
        chunks = np.maximum(halves if len(halves) == 1 else np.maximum(halves[:-1], halves[1:]), 0)
        f = np.concatenate([chunks.mean(0), chunks.max(0)])
        logit = np.tanh(f @ q["v"] + q["c"]) @ q["u"] + q["d"][0]
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-logit))) < 1e-3


def test_long_labelled_texts_are_learned_from_by_pieces(spark):
    words = {1: "plain words stand here", 0: "## !! @@ $$"}
    rows = [(i, f"{words[i % 2]} " * (900 if i % 2 else 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    some = labelled_sample(docs, labels, "quality", F.lit(True), 50, 800)
    assert sorted(y for _, y in some) == [0] * 20 + [1] * 20 and all(len(t) <= 800 for t, _ in some)
    assert all(len(t) > 600 and set(t.split()) == set(words[1].split()) for t, y in some if y)
    assert sum(y for _, y in labelled_sample(docs, labels, "quality", F.lit(True), 7, 800)) == 7
    net = quality.fit(docs, labels, F.lit(True))
    assert {r["doc_id"] % 2 for r in quality.keep_good(docs, net).collect()} == {1}
    assert quality.keep_good(docs, net).count() == 20


def test_pieces_of_a_long_text_lie_all_over_it(spark):
    docs = spark.createDataFrame([(i, " ".join(map(str, range(100_000, 110_000)))) for i in range(30)], "doc_id bigint, text string")
    got = [list(map(int, r[0].split())) for r in docs.select(bounded_text(4_000)).collect()]
    assert all(g == sorted(g) and {(x - 100_000) // 1_250 for x in g} >= set(range(8)) for g in got)
    assert len(set().union(*got)) > 5_000


def test_one_class_keeps_every_document_and_marks_none(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * (i + 1)) for i in range(12)], "doc_id bigint, text string")
    for n, marks in enumerate(([], [0], [1])):
        folder = tmp_path / str(n)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels = spark.createDataFrame([(i, m, m) for i in range(12) for m in marks], "doc_id bigint, quality int, toxic int")
        labels.write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.keep_good(spark, docs, str(folder)).count() == 12
        assert {(r["predicted"], r["score"] >= 0.7) for r in queries.op9_quality(spark, str(folder)).collect()} == {(1, True)}
        assert {(r["predicted"], r["score"] >= 0.5) for r in queries.op3_toxicity(spark, str(folder)).collect()} == {(0, False)}
