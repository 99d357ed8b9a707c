"""Spelling variants: words an edit apart, by partition-and-enumerate signatures of their letter multisets."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, record_batch, whole_text
from runledger.session import settle

LETTERS = "[A-Za-zÀ-ÿ]+"
DAMAGE = 97  # one in so many (document, word) pairs loses a letter
PARTS = 7  # parts the letters are dealt to
DISTANCE = 2  # an edit changes at most two places of a letter multiset written as a binary vector
_WORD, _GAP = re.compile(LETTERS), re.compile("[^A-Za-zÀ-ÿ]")
_CHUNK = 1 << 20  # letters of a long text counted at once
_HELD = 200_000  # different words a task holds before it hands its counts on


def _chunks(text: str) -> Iterator[str]:
    """The text in pieces of bounded size that cut no word."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def words_of(text: str) -> Counter:
    """How often each word, A-Z lower-cased, stands in a text."""
    met: Counter = Counter()
    for part in _chunks(text):
        met.update(_WORD.findall(part.encode().lower().decode()))  # on bytes, lower() changes A-Z only
    return met


def damaged(name: str, word: str, every: int = DAMAGE) -> str:
    """The word, less one letter where ``every`` divides the crc32 of ``name:word``."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{name}:".encode()))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = None) -> DataFrame:
    """(word, n): how often each word stands in the whole texts.

    With ``every``, a word of a document loses a letter as ``damaged`` says; rows without an id lose none. Words that
    have lost their only letter are left out, and null texts have no words. Tasks add up equal words before the shuffle.
    """

    def fn():
        held: Counter = Counter()

        def step(c):
            for name, body in zip(c["name"].to_pylist(), c["text"].to_pylist(), strict=True):
                for word, n in words_of(body).items():
                    held[word if every is None or name is None else damaged(name, word, every)] += n
                if len(held) > _HELD:
                    yield flush()

        def flush():
            found = {w: n for w, n in held.items() if w}
            held.clear()
            return record_batch(word=pa.array(list(found), pa.string()), n=pa.array(list(found.values()), pa.int64()))

        step.rest = lambda: iter([flush()] if held else [])
        return step

    rows = docs.select(F.col(doc_id).cast("string").alias("name"), whole_text(text).alias("text"))
    return map_rows(rows, "word string, n bigint", fn).groupBy("word").agg(F.sum("n").alias("n"))


def _part(letter: str, k: int, parts: int) -> int:
    """The part to which the k-th copy of a letter belongs."""
    return xxhash.xxh64_intdigest(f"{letter}{k}".encode("utf-8", "surrogatepass")) % parts


def signer(parts: int = PARTS, distance: int = DISTANCE):
    """A function of a word: one 64-bit signature per choice of all but ``distance`` of the parts.

    A word's letters as a multiset are the binary vector with a one for (letter, k) where the letter stands at least k
    times. Its places are dealt to ``parts`` parts. Two vectors that differ in at most ``distance`` places agree on some
    choice of ``parts - distance`` parts, and so share that signature.
    """
    choices = list(combinations(range(parts), parts - distance))
    dealt: dict[tuple[str, int], int] = {}

    def signatures(word: str) -> list[int]:
        held: list[list[str]] = [[] for _ in range(parts)]
        seen: dict[str, int] = {}
        for letter in sorted(word):
            k = seen[letter] = seen.get(letter, 0) + 1
            place = dealt.get((letter, k))
            if place is None:
                place = _part(letter, k, parts)
                if len(dealt) < _HELD:
                    dealt[letter, k] = place
            held[place].append(letter)
        texts = ["".join(p) for p in held]
        return [xxhash.xxh64_intdigest("\0".join([str(i), *[texts[p] for p in c]])) for i, c in enumerate(choices)]

    return signatures


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, choice, sig): the signatures of every word, a row each."""

    def fn():
        signatures = signer(parts)

        def step(c):
            words = c["word"]
            rows = np.array([signatures(w) for w in words.to_pylist()], np.uint64)
            each = rows.shape[1]
            yield record_batch(
                word=words.take(pa.array(np.repeat(np.arange(len(words)), each))),
                choice=pa.array(np.tile(np.arange(each, dtype=np.int32), len(words))),
                sig=pa.array(rows.view(np.int64).ravel()),
            )

        return step

    return map_rows(words.select("word"), "word string, choice int, sig bigint", fn)


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b): all pairs of different words, a < b, that one inserted, deleted or replaced code point turns into each other.

    Words meet by equality of signatures, and the join condition checks the edit distance, so that only near words leave
    the join, and adaptive execution splits a signature that many words share. A pair that meets under several is kept once.
    The join is a sort merge: Spark sizes the signatures like the words they are made of, and would broadcast 21 rows a word for one.
    """
    rows = signed(words, parts)
    left, right = rows.alias("l"), rows.alias("r")
    meet = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.choice") == F.col("r.choice")) & (F.col("l.word") < F.col("r.word"))
    close = F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1
    return left.join(right.hint("merge"), meet & close).select(F.col("l.word").alias("a"), F.col("r.word").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form followed to the last, by pointer doubling.

    A form is met at least twice as often as its word, so a chain over counts of three and more has a length within the
    logarithm of the largest count, and the rounds are the logarithm of that. Joins are sort merges: a file of words takes
    13 times its size as a broadcast table.
    """
    least, most = forms.agg(F.min("n"), F.max("form_n")).first()
    steps = max(1, int(math.log2(most / least)) + 1) if most else 1
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        at = settle(at.join(on.hint("merge"), F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root")))
    return at


def spelling_groups(counts: DataFrame, min_letters: int = 5, min_count: int = 3, factor: int = 2, parts: int = PARTS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``counts`` has (word, n); words of under ``min_letters`` code points or under ``min_count`` occurrences are left out, as are
    null ones, and repeated words add up. ``n_near`` counts the other words an edit away. The form is the near word met most often (ties: the
    smallest by code points) if met at least ``factor`` times as often as the word, else null; the root
    follows forms to the last, and is the word itself without one. An empty table gives no rows; other columns of ``counts`` are not read.
    """
    kept = counts.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = settle(kept.where(F.col("n") >= min_count))
    pairs = settle(near_pairs(words, parts))
    sides = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    # a sort merge: both sides of every pair, exploded and read from coded words, are far more than Spark takes them for
    found = sides.select(F.col("p.a").alias("of"), F.col("p.b").alias("near")).join(other.hint("merge"), "near").groupBy("of").agg(
        F.count("*").alias("n_near"), best.alias("best")
    )
    enough = -F.col("best.less") >= factor * F.col("n")
    rows = settle(
        words.join(found, F.col("word") == F.col("of"), "left").select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form is not null")).withColumnRenamed("word", "_word")
    return rows.join(roots.hint("merge"), F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
