"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import prepare

# The six white-space characters that part words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
PIECES = 8  # parts of a long text that a sample reads a piece of each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, letter case aside, for columns an operator adds for itself."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def map_rows(df: DataFrame, schema: str, fn: Callable[[], Callable[[dict], Iterable[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` for a function of column lists; ``fn`` is called once per task and may keep bounded caches.

    What a step holds back, its attribute ``rest`` yields at the end of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            if batch.num_rows:
                yield from step({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
        yield from getattr(step, "rest", lambda: ())()

    return df.mapInArrow(run, schema)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def bounded_text(max_chars: int, text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, or of one longer than ``max_chars`` a piece of each of ``PIECES`` equal parts, where the id's hash falls.

    Pieces begin and end with whole words where they hold any space.
    """
    whole, size = F.col(text), max(1, max_chars // PIECES - 1)
    room = F.floor(F.length(text) / PIECES)
    pieces = []
    for k in range(PIECES):
        start = (k * room + F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), room - size + 1) + 1).cast("int")
        pieces.append(F.regexp_replace(whole.substr(start, F.lit(size)), r"^\S*\s+(?=\S)|(?<=\S)\s+\S*$", ""))
    return F.when(F.length(text) <= max_chars, whole).otherwise(F.substring(F.concat_ws(" ", *pieces), 1, max_chars))


def _texts_of(docs: DataFrame, picked: dict, max_chars: int, text: str) -> list[tuple[str, object]]:
    """(bounded text, mark) of the picked ids; the ids are few, and stand in the scan's filter."""
    if not picked:
        return []
    rows = docs.where(F.col("doc_id").isin(list(picked))).select("doc_id", bounded_text(max_chars, text).alias("_text"))
    rows = rows.groupBy("doc_id").agg(F.min("_text").alias("_text")).collect()
    return [(r["_text"], picked[r["doc_id"]]) for r in sorted(rows, key=lambda r: str(r["doc_id"])) if r["_text"] is not None]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_chars: int, text: str = "text"
) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class, those whose ids hash lowest; of longer texts at most ``max_chars`` are read.

    The bound holds the driver's share at ``2 * per_class * max_chars`` characters. Texts within ``max_chars`` go first,
    since a label is sure of what was read whole; longer ones fill up the class by pieces spread over their
    length, so that no class is lost by length. Only ids and lengths are shuffled. Rows with a null text, id or label teach nothing; a document labelled twice with different classes
    is left out.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("_low"), F.max(label).alias("_mark"))
        .where("_low = _mark")
        .select(F.col("doc_id").alias("_label_id"), "_mark")
    )
    ids = docs.where(learn & F.col(text).isNotNull()).select("doc_id", (F.length(text) > max_chars).alias("_long"))
    rows = ids.join(marks, F.col("doc_id") == F.col("_label_id")).groupBy("doc_id", "_mark").agg(F.min("_long").alias("_long"))
    rows = rows.withColumn("_order", F.xxhash64("doc_id"))
    lowest = [rows.where(F.col("_mark") == v).orderBy("_long", "_order", "doc_id").limit(per_class) for v in (0, 1)]
    return _texts_of(docs, {r["doc_id"]: r["_mark"] for r in lowest[0].union(lowest[1]).collect()}, max_chars, text)


def class_sample(
    docs: DataFrame, label: str, learn: Column, per_class: int, max_chars: int, text: str = "text"
) -> list[tuple[str, object]]:
    """About ``per_class`` texts of each value of a column, those whose ids hash lowest; of longer texts at most ``max_chars`` are read.

    The hash below which a class's ids lie is set by counting the class, so one pass finds them all. Texts of any length count
    and are drawn, long ones in pieces spread over their length, so that every value with a text is in the sample.
    """
    rows = docs.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    wanted = F.lit(False)
    for value, n in sizes.items():
        wanted = wanted | ((F.col(label) == value) & (part < 1.2 * per_class / n))
    found = rows.where(wanted).select("doc_id", label).distinct().limit(2 * per_class * max(1, len(sizes))).collect()
    picked: dict = {}
    seen: dict = {}
    for r in sorted(found, key=lambda r: zlib.crc32(str(r["doc_id"]).encode())):
        if seen.setdefault(r[label], 0) < per_class and r["doc_id"] not in picked:
            seen[r[label]] += 1
            picked[r["doc_id"]] = r[label]
    return _texts_of(docs, picked, max_chars, text)
