"""URL filters: rules by host and path, and naive Bayes over segmented hosts and path words for what no rule fits."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch
from runledger.session import settle

ALLOW, BLOCK = "allow", "block"
LONGEST = 24  # letters of the longest word a name is split into
_LETTERS = r"[a-zß-ÿ]+"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame, url: str = "url") -> dict[str, Column]:
    """Host and path of a url: after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?``, ``#``.

    A url that is null or holds no ``://`` has neither; both are then empty.
    """
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + F.lit(3), F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return {"host": _lower(host), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)}


def rule_of(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest of the rules (verdict, host, path) that fits, null where none does.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Of rules as long as each other the
    first by text wins, and of two verdicts for one rule, block.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]], r[0])):
        under = (host == name) | F.endswith(host, F.lit("." + name))
        this = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(under & F.startswith(path, F.lit(start)), this).otherwise(fits)
    return fits


def page_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): how often each word stands in the text between the tags of all pages; null pages have none."""
    text = F.lower(F.regexp_replace(F.col(html).cast("string"), "<[^<>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(_LETTERS), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, known: dict[str, int], total: int, longest: int = LONGEST) -> list[str]:
    """The most probable split of a name into words, by Viterbi's algorithm over word frequencies.

    A word costs the negative logarithm of its share of all words. An unknown one of k letters counts as met 10 / 10^k times. Of
    splits as probable as each other the one whose last word is longest wins.
    """
    total = max(1, total)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        least, at = math.inf, 0
        for start in range(max(0, end - longest), end):
            n = known.get(name[start:end])
            share = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            cost = best[start] - share
            if cost < least - 1e-9:
                least, at = cost, start
        best.append(least)
        back.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def split_names(names: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(name, words): every different name split into the most probable words of (word, n).

    A name meets the counts of the words it holds by a join on its substrings, so no vocabulary is sent to all tasks; what is
    gathered for a name is bounded by its own length times ``longest``.
    """
    spots = F.expr(
        "flatten(transform(sequence(1, length(name)), i -> "
        f"transform(sequence(1, least({int(longest)}, length(name) - i + 1)), k -> substring(name, i, k))))"
    )
    name = names.where("name <> ''").select("name").distinct()
    parts = name.select("name", F.explode(F.array_distinct(spots)).alias("word"))
    met = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = words.agg(F.sum("n")).first()[0] or 0

    def fn():
        def step(c):
            found = [
                split_name(n, {k["word"]: k["n"] for k in known or ()}, total, longest)
                for n, known in zip(c["name"].to_pylist(), c["known"].to_pylist(), strict=True)
            ]
            yield record_batch(name=c["name"], words=pa.array(found, pa.list_(pa.string())))

        return step

    return map_rows(name.join(met, "name", "left").select("name", "known"), "name string, words array<string>", fn)


def _path_words(path: Column) -> Column:
    """Runs of letters, and ``0`` for each run of digits, of a lower-cased path, sorted."""
    return F.array_sort(F.regexp_extract_all(F.regexp_replace(_lower(path), "[0-9]+", "0"), F.lit(r"[a-zß-ÿ]+|0"), F.lit(0)))


def _weights(seen: DataFrame) -> tuple[DataFrame, float, float]:
    """Naive Bayes from rows (features, n_allow, n_block): (feature, weight), the prior, and the weight of a feature no labelled url has.

    Weights are log odds for block with one added to each count. Only sums over all features and urls reach the driver.
    """
    each = settle(
        seen.select(F.explode("features").alias("feature"), "n_allow", "n_block").groupBy("feature").agg(
            F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")
        )
    )
    allow, block, kinds = each.agg(F.sum("n_allow"), F.sum("n_block"), F.count("*")).first()
    allowed, blocked = seen.agg(F.sum("n_allow"), F.sum("n_block")).first()
    shift = math.log(((allow or 0) + kinds + 1) / ((block or 0) + kinds + 1))
    weight = F.log(F.col("n_block") + 1.0) - F.log(F.col("n_allow") + 1.0) + F.lit(shift)
    prior = math.log(((blocked or 0) + 1) / ((allowed or 0) + 1))
    return each.select("feature", weight.alias("weight")), prior, shift


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], carry: Sequence[str] = ("page_id",), url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: the ``carry`` columns, then host, path, rule, verdict and score.

    A rule decides where one fits (``rule_of``). All other urls get the verdict of multinomial naive Bayes, which learns from the urls that rules decide:
    from the words of the host, its names split by the word frequencies of all pages (``split_names``), and the words of the path. ``score``
    is the probability of block; over one half blocks. A class of which no rule decides a page only counts the one
    added to it; with no decided page at all every score is one half and allows.

    Urls of the same host words and path words are one row when they teach and when they are scored. Repeated pages
    each give a row, an empty table gives none; null urls have an empty host and path and are scored like any other. Carried columns must not
    be named as those of the result.
    """
    at = parsed(pages, url)
    rows = pages.select(*carry, at["host"].alias("host"), at["path"].alias("path"))
    hit = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("_hit", hit).withColumn("_shape", _path_words(F.col("path")))
    kinds = settle(
        rows.groupBy("host", "_shape").agg(
            F.count_if(F.col("_hit.verdict") == ALLOW).alias("n_allow"), F.count_if(F.col("_hit.verdict") == BLOCK).alias("n_block"),
            F.count_if(F.col("_hit").isNull()).alias("n_open"),
        )
    )
    hosts = kinds.select("host").distinct()
    named = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"[a-zß-ÿ]+"), F.lit(0))).alias("at", "name"))
    split = settle(split_names(named, settle(page_words(pages, html))))
    of_host = named.join(split, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    tag = lambda kind, words: F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit(kind), w))
    features = F.array_sort(F.concat(tag("h:", F.col("words")), tag("p:", F.col("_shape"))))
    told = settle(
        kinds.join(of_host, "host", "left").select("host", "_shape", features.alias("features"), "n_allow", "n_block", "n_open")
    )
    weights, prior, unseen = _weights(told.where("n_allow + n_block > 0"))
    # one row per kind of url is scored, and only kinds that some undecided page has
    asked = told.where("n_open > 0").select("host", "_shape", F.explode_outer("features").alias("feature"))
    logit = asked.join(weights, "feature", "left").groupBy("host", "_shape").agg(
        F.sum("weight").alias("weight"), F.count_if(F.col("weight").isNull() & F.col("feature").isNotNull()).alias("n_unseen")
    )
    total = F.round(F.coalesce("weight", F.lit(0.0)) + F.col("n_unseen") * F.lit(unseen) + F.lit(prior), 9)
    # written, so that the join reads two exchanges, of which a hot host's can be split
    scored = settle(
        logit.select(F.col("host").alias("_host"), F.col("_shape").alias("_words"), (1 / (1 + F.exp(-total))).alias("score"))
    )
    same = (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_words")) & F.col("_hit").isNull()
    return rows.join(scored, same, "left").select(
        *carry, "host", "path", F.col("_hit.rule").alias("rule"),
        F.coalesce("_hit.verdict", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(F.col("_hit").isNull(), F.col("score")).alias("score"),
    )
