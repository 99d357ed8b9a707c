"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import map_rows, own_names, record_batch, whole_text
from runledger.llm.components import components
from runledger.session import settle

SEED = 42
HALF = 32
_BLOCK = 65_536  # words hashed at once, so that memory stays bounded on very long texts


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half the shingles' hashes. A text without words has 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + shingle_words - 1]
        if len(part) < shingle_words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_key(text: str) -> Column:
    """64 bits that tell rows of the same id apart."""
    return F.xxhash64(whole_text(text))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, text_key): the fingerprint of every whole text as a signed 64-bit number, and another hash of the text.

    A null text is an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def fn():
        def step(c):
            values = np.array([fingerprint(t, shingle_words) for t in c["text"].to_pylist()], np.uint64)
            yield record_batch(doc_id=c["doc_id"], fp=pa.array(values.view(np.int64)), text_key=c["text_key"])

        return step

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), text_key(text).alias("text_key"))
    return map_rows(rows, f"doc_id {kind}, fp bigint, text_key bigint", fn)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints, a < b, that differ in at most two bits, each once.

    A fingerprint is cut into two halves. Of two that differ in at most two bits, either the lower halves
    are equal, or the upper halves differ in at most one. So each is indexed under its lower half and under the
    32 variants of its upper half with one bit deleted: 33 keys, one equality join. The join condition checks
    the distance and lets a pair pass under one key only: under the deleted bit in which the upper halves differ,
    under the lower half if they differ in two, under variant 0 if the upper halves are equal. No pairs
    beyond true links leave the join, and adaptive execution splits a hot key. The join is a sort merge: Spark sizes the index
    like the fingerprints it is exploded from, and would broadcast 33 times what it takes for small.
    """
    high = F.shiftrightunsigned("fp", HALF)
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    variants = F.transform(
        F.sequence(F.lit(0), F.lit(HALF - 1)),
        lambda i: F.struct(i.alias("bit"), high.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("part")),
    )
    keys = F.concat(variants, F.array(F.struct(F.lit(HALF).alias("bit"), low.alias("part"))))
    index = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.bit", "k.part")
    left, right = index.alias("l"), index.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    top = F.shiftrightunsigned(x, HALF)
    first = (
        F.when(F.col("l.bit") == HALF, F.bit_count(top) == 2)
        .when(top == 0, F.col("l.bit") == 0)
        .otherwise(top == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l.bit")))
    )
    same = (F.col("l.bit") == F.col("r.bit")) & (F.col("l.part") == F.col("r.part"))
    return left.join(right.hint("merge"), same & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(x) <= 2) & first).select(
        F.col("l.fp").alias("a"), F.col("r.fp").alias("b")
    )


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (16 hex digits), component_id, root and text_key.

    Documents are linked when their fingerprints differ in at most two bits; ``component_id`` is the smallest
    id reachable by links (null only where a component has no id at all), ``root`` the component's own number. Copies share a fingerprint, which
    stands once in the index. Texts without words have fingerprint zero and are linked like any other. Repeated
    rows each give a row; an empty table gives none.
    """
    rows = settle(fingerprints(docs, doc_id, text, shingle_words))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return rows.join(of_print, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_key"
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """The documents that stay, one row of each component: the one of the smallest id, the columns as they came.

    A row without an id stays only where no document of its component has one. Of several rows with the smallest
    id one stays; rows of one id in different components are kept for each.
    """
    names = docs.columns
    kept_id, kept_key, key, copy = own_names(docs, "_kept_id", "_kept_key", "_text_key", "_copy")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("kept")
    kept = simhash_groups(docs, doc_id, text, shingle_words).groupBy("root").agg(least).select(
        F.col("kept.doc_id").alias(kept_id), F.col("kept.text_key").alias(kept_key)
    )
    same = F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    first = F.row_number().over(Window.partitionBy(doc_id, key).orderBy(key))
    joined = docs.withColumn(key, text_key(text)).join(kept, same, "left_semi")
    return joined.withColumn(copy, first).where(F.col(copy) == 1).select(*names)
