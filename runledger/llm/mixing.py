"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.ordered import scan
from runledger.llm.common import WORD_PATTERN, own_names, whole_text
from runledger.session import settle


MOST_SOURCES = 100_000  # sources whose targets, a row of some 60 bytes each, are sent to all tasks

ROW = ["doc_id", "source", "text_key"]


def draw(seed: Column) -> Column:
    """A number in [0, 1) fixed by the seed, the id, the text's hash and the number among equal rows: 52 bits of an MD5."""
    parts = [seed.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key"), F.col("nth").cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size); works on one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share all words by weight. A target
    stops at ``cap`` times its source's size and the excess is shared again by weight until none is above:
    with sources ordered by cap over weight, the capped ones are a prefix, so two running sums find the level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    named = total.withColumn("place", place).withColumn("weight", weight)
    named = named.withColumn("most", F.col("source_size").cast("double") * cap)
    up_to = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    )
    levels = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    share = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)["level"]
    target = F.least(F.col("most"), F.coalesce(share * F.col("weight"), F.col("most")))
    return levels.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seeds: int = 16,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken, text_key.

    ``size`` counts words (a null text has none). The rate of a source is its target over its size; a document
    is taken floor(rate) times, plus once more where its hash-seeded draw falls below the fraction. Rows of one id are told apart by their text, and rows
    equal in id, source and text are numbered, so that each row draws for itself. Each source
    uses the one of ``seeds`` seeds whose draws land nearest its target, found in one aggregation, so that a few
    long documents don't move the mix; reruns agree. Sources without words have
    target 0 and rate 0. An empty table gives no row.

    Targets are one row per source. Up to ``MOST_SOURCES`` of them, counted, are broadcast, so that rows stay where they are; more
    are joined, and adaptive execution splits a hot source.
    """
    rows = settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.md5(whole_text(text).cast("binary")).alias("text_key"),
            F.regexp_count(whole_text(text), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        )
    )
    # equal rows are numbered by the partition that holds them, so that a row met very often is not numbered in one task
    rows = settle(scan(rows, ROW, ["row"], F.shiftright("row", 33), total={"nth": F.lit(1).cast("long")}).drop("row"))
    targets = settle(source_targets(rows, weights, cap))
    few = targets.count() <= MOST_SOURCES

    def by_source(left: DataFrame, right: DataFrame) -> DataFrame:
        """Join with one row per source."""
        right = right.withColumnRenamed("source", "_source")
        return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = by_source(rows, targets.withColumn("rate", rate))
    times = lambda seed: (F.floor("rate") + (draw(seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
    off = [F.abs(F.sum(F.col("size") * times(F.lit(k))) - F.first("target")).alias(f"off{k}") for k in range(seeds)]
    nearest = F.array_min(F.array(*[F.struct(F.col(f"off{k}").alias("off"), F.lit(k).alias("k")) for k in range(seeds)]))
    chosen = settle(rated.groupBy("source").agg(*off).select("source", nearest["k"].alias("seed")))
    seeded = by_source(rated, chosen).withColumn("copies", times(F.col("seed")))
    return seeded.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_key"
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as its plan says, with the columns it came with.

    The copies of rows equal in id, source and text are dealt evenly among them.
    """
    names = docs.columns
    key, copies, equal, times, nth, row, place, *theirs = own_names(docs, "_key", "_copies", "_equal", "_times", "_nth", "_row", "_at", *[f"_{c}" for c in ROW])
    plan = mix_plan(docs, doc_id, text, source, **options)
    groups = settle(plan.groupBy(*ROW).agg(F.sum("copies").alias(copies), F.count("*").alias(equal))).select(
        *[F.col(c).alias(t) for c, t in zip(ROW, theirs, strict=True)], copies, equal
    )
    its_id, its_source, its_key = map(F.col, theirs)
    same = F.col(doc_id).eqNullSafe(its_id) & F.col(source).cast("string").eqNullSafe(its_source) & (F.col(key) == its_key)
    joined = docs.withColumn(key, F.md5(whole_text(text).cast("binary"))).join(groups.where(F.col(copies) > 0), same)
    dealt = joined.where(F.col(equal) == 1).select(*names, F.col(copies).alias(times))
    if not groups.where((F.col(equal) > 1) & (F.col(copies) > 0)).isEmpty():
        many = settle(joined.where(F.col(equal) > 1).withColumn(row, F.monotonically_increasing_id()))
        ids = many.select(F.col(row).alias("row"), *[F.col(t).alias(c) for c, t in zip(ROW, theirs, strict=True)])
        numbered = scan(ids, ROW, ["row"], F.shiftright("row", 33), total={"nth": F.lit(1).cast("long")})
        many = many.join(numbered.select(F.col("row").alias(place), F.col("nth").alias(nth)), F.col(row) == F.col(place))
        each = F.floor(F.col(copies) / F.col(equal)) + (F.col(nth) <= F.col(copies) % F.col(equal)).cast("int")
        dealt = dealt.unionByName(many.select(*names, each.cast("long").alias(times)).where(F.col(times) > 0))
    return dealt.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*names)
