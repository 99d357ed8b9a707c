"""Runs of words, url filters and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from runledger.llm import queries, runs, spelling, urlfilter

# -- runs


def plain_runs(w):
    found = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                found.add((s, i - s + p, p))
    inner = lambda r: any(s <= r[0] and r[0] + r[1] <= s + n and p < r[2] for s, n, p in found)
    return sorted((r for r in found if not inner(r)), key=lambda r: (r[0], r[2]))


def plain_row(text, h):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if h is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (
        len(found), *best, best[1] and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def rhythmic_texts(n, seed=5):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdé"[: rng.choice([1, 2, 2, 3, 5])]
        some = lambda k: [rng.choice(letters) for _ in range(rng.randint(0, k))]
        unit = some(5) + ["a"]
        words = some(60) if rng.random() < 0.3 else some(5) + unit * rng.randint(1, 7) + unit[: rng.randint(0, 4)] + some(4) + unit * rng.randint(0, 5)
        yield rng.choice(["", " "]) + rng.choice([" ", "\n", " \t "]).join(words)


def test_lyndon_arrays_under_both_orders():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 25)), 0)
        length, group = runs.lyndon_groups(w)
        want = [1] * len(w)
        for i in range(len(w) - 1):  # the next smaller suffix ends the longest Lyndon word
            want[i] = next(j for j in range(i + 1, len(w)) if list(w[j:]) < list(w[i:])) - i
        assert length[:-1].tolist() == want[:-1]
        roots = {}
        for i in range(len(w) - 1):
            assert roots.setdefault(int(group[i]), tuple(w[i : i + want[i]])) == tuple(w[i : i + want[i]])
        assert len(set(roots.values())) == len(roots)


def test_runs_of_odd_texts(spark):
    odd = [None, "", "  \n", "a", "a " * 6, "a " * 5, "x y " * 4, "x y " * 3, "a " * 4_000, " ".join(f"w{i % 500}" for i in range(3000)), " a　a" * 9]
    texts = odd + list(rhythmic_texts(2500))
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(5, "x y " * 9, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int").repartition(5)
    for repeat in (True, False):
        got = sorted(map(tuple, runs.word_runs(docs, repeat=repeat).collect()), key=str)
        mark = lambda i: zlib.crc32(str(i).encode()) if repeat and i is not None else None
        assert got == sorted(((i, *plain_row(t, mark(i))) for i, t, _ in rows), key=str)
    assert runs.word_runs(docs.limit(0)).count() == 0


def test_runs_of_the_sample(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_word_runs(spark, small).collect()}
    want = {r["doc_id"]: plain_row(r["text"], zlib.crc32(str(r["doc_id"]).encode())) for r in docs.collect()}
    assert got == want and any(r[0] for r in want.values())


# -- spelling


def plain_variants(rows, every=97, letters=5, least=3, factor=2):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w, n in kept.items():
        close = [v for v in kept if near(v, w)]
        best = min(close, key=lambda v: (-kept[v], v)) if close else None
        forms[w] = best if best and kept[best] >= factor * n else None
        out[w] = [forms[w], None, n, len(close), forms[w] and kept[forms[w]]]
    for w in kept:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(r) for w, r in out.items()}


def test_spelling_variants_of_odd_texts(spark):
    rng = random.Random(3)
    words = ["colour", "color", "COLOR", "colours", "Éclair", "éclair", "straße", "strasse", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "edcba", "×÷×÷×"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "1 2 3"), (4, "colour" * 400_000)]
    rows += [(7, "chain1chainschainsschain" * 3)] * 2
    for k in range(6):  # a chain of forms, each met twice as often as the one before
        rows.append((1000 + k, " ".join(["zz" + "b" * k + "yyyyyy"[k:] + "qq"] * 4 * 2**k)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n int").repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_groups(spelling.word_counts(docs, every=97)).collect()}
    want = plain_variants(rows)
    assert got == want
    assert len({r[1] for r in want.values() if r[0]}) < sum(bool(r[0]) for r in want.values())
    none = spelling.spelling_groups(spelling.word_counts(docs.limit(0)))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_variants_of_the_sample(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["word"]: tuple(r)[1:] for r in queries.op13_spelling_variants(spark, small).collect()}
    assert got == plain_variants(rows)


def test_no_side_of_the_word_joins_is_broadcast(spark, tmp_path):
    spark.createDataFrame([("prairie", 9), ("prarie", 3), ("prairies", 4), ("unlike", 5)], "word string, n bigint").write.parquet(f"{tmp_path}/w")
    words = spark.read.parquet(f"{tmp_path}/w")
    pairs, groups = spelling.near_pairs(words), spelling.spelling_groups(words)
    for df in (pairs, groups):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, pairs.collect())) == [("prairie", "prairies"), ("prairie", "prarie")]
    assert {r["word"]: r["root"] for r in groups.collect()} == {"prairie": "prairie", "prarie": "prairie", "prairies": "prairie", "unlike": "unlike"}


def test_words_an_edit_apart_share_a_signature():
    rng = random.Random(9)
    sign = spelling.signer()
    for _ in range(3000):
        w = "".join(rng.choice("abcdéß") for _ in range(rng.randint(2, 12)))
        at, c = rng.randrange(len(w)), rng.choice("abcdéß")
        edits = {w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]}
        assert all(set(sign(w)) & set(sign(v)) for v in edits)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "one two  three-four " * 50 + "five" * 30
    want = spelling.words_of(text)
    monkeypatch.setattr(spelling, "_CHUNK", 7)
    assert spelling.words_of(text) == want and want["five" * 30] == 1


# -- urls

RULES = queries.URL_RULES


def plain_judge(rows, rules):
    counts = Counter()
    for _, h in rows:
        counts.update(re.findall("[a-zß-ÿ]+", re.sub("<[^<>]*>", " ", h or "").lower()))
    total = max(1, sum(counts.values()))

    def split(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - 24), end):
                w = name[start:end]
                p = math.log(counts[w] / total) if counts[w] else math.log(10 / total) - len(w) * math.log(10)
                options.append((best[start][0] - p, best[start][1] + [w]))
            least = min(o[0] for o in options)
            best.append(next(o for o in options if o[0] <= least + 1e-9))
        return best[-1][1]

    def parse(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]

    def features(host, path):
        names = ["h:" + w for n in re.findall("[a-zß-ÿ]+", host) for w in split(n)]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), path)
        return names + ["p:" + w for w in re.findall("[a-zß-ÿ]+|0", re.sub("[0-9]+", "0", low))]

    def rule(host, path):
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda r: len(r[0]), default=(None, None))

    parts = [parse(u) for u, _ in rows]
    seen, urls = {"allow": Counter(), "block": Counter()}, Counter()
    for host, path in parts:
        if v := rule(host, path)[1]:
            seen[v].update(features(host, path))
            urls[v] += 1
    kinds = len(set(seen["allow"]) | set(seen["block"]))

    def score(host, path):
        odds = math.log((urls["block"] + 1) / (urls["allow"] + 1))
        for f in features(host, path):
            odds += math.log((seen["block"][f] + 1) / (seen["block"].total() + kinds + 1))
            odds -= math.log((seen["allow"][f] + 1) / (seen["allow"].total() + kinds + 1))
        return 1 / (1 + math.exp(-round(odds, 9)))

    out = []
    for host, path in parts:
        r, v = rule(host, path)
        s = None if r else score(host, path)
        out.append((host, path, r, v or ("block" if s > 0.5 else "allow"), s))
    return out


def check_judge(spark, rows, rules=RULES):
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages.repartition(3), rules).collect()}
    want = plain_judge(rows, rules)
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i][:4] == w[:4], (rows[i][0], got[i], w)
        assert (w[4] is None) == (got[i][4] is None) and (w[4] is None or abs(w[4] - got[i][4]) < 1e-6)
    return got


def test_urls_are_judged_as_by_a_plain_version(spark, small):
    rows = [(r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = check_judge(spark, rows)
    assert {r[3] for r in got.values() if r[2] is None} == {"allow", "block"}
    named = {r["page_id"]: r["verdict"] for r in queries.op12_url_filter(spark, small).collect()}
    assert Counter(named.values()) == Counter(r[3] for r in got.values())


def test_odd_urls(spark):
    html = "<p>red car <b>best</b> price the car</p> <"
    urls = [
        None, "", "example.com/en/", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en", "http://com/",
        "http://a.com", "http://acom/", "http://x.net/es/?a=b", "http://x.net/ES/", "http://x.net?y/fr/", "http://x.net#://b.com/", "ftp://redcar.org/best/1",
        "https://bestprice.org/fr/12", "https://ÄÖ.org/é", "x://" + "redcar" * 60 + ".org/" + "1" * 3000, "http://net/fr/a://b.com/", "http://redcar.org/best/1",
    ]
    check_judge(spark, [(u, html if i % 3 else None) for i, u in enumerate(urls)] * 2)
    check_judge(spark, [("http://one.org/a", None), (None, None)])  # nothing to learn from
    check_judge(spark, [("http://one.org/a", html), ("http://two.com/a", html)])  # one class
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urlfilter.judge(none, RULES).count() == 0


def test_names_are_split_into_words():
    known = {"best": 50, "price": 40, "car": 30, "red": 20, "bestprice": 0}
    assert urlfilter.split_name("bestpricecar", known, 200) == ["best", "price", "car"]
    assert "".join(urlfilter.split_name("x" * 100, known, 200)) == "x" * 100
    assert urlfilter.split_name("redqqcar", known, 200)[0] == "red"
