"""Exact dedup: a tree of merges over sorted runs of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import SPACES, own_names, whole_text
from runledger.session import settle

KEY = ["digest", "n_bytes"]


def _bare(text: str) -> Column:
    return F.translate(whole_text(text), SPACES, "")


def _digest(text: str) -> list[Column]:
    bare = _bare(text)
    return [
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
        F.octet_length(bare).alias("n_bytes"),
        F.length(whole_text(text)).alias("n_chars"),
    ]


def _merge(run: DataFrame) -> DataFrame:
    """One round of the binomial tree: each two neighbouring runs meet and are merged, one best row per digest remaining.

    The struct minimum makes this a sort aggregate: each task sorts and combines its own rows before the
    exchange, and the receiving task merges the sorted runs it is sent, as many as there are senders.
    """
    return (
        run.withColumn("run", F.shiftright("run", 1))
        .groupBy("run", *KEY)
        .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    )


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 8
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and n_chars).

    Texts are equal when they are identical after the six white-space characters are deleted. The row with
    the most code points in its original text stays, then the smallest id (null last), then one of the
    repeated rows. Rows are dealt over 2 to the power of ``rounds`` runs by a hash of their row number. In each round the runs whose
    numbers differ in the lowest bit that is left meet, which carries the best row and the count of each digest up a binomial tree; a
    digest counts as verified only together with the byte length of its text. Each round's runs are written, and the winner
    travels back down the same tree, so a merge and a join on the way see two rows of a hot digest per run, and a leaf its own run's rows.
    The way down is sort merges: as broadcasts, the digests of all levels would meet on the driver at once.
    A null text is an empty one; empty texts form a group like any other; an empty table gives no row.
    """
    rows = settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *_digest(text)
        )
    ).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(1 << rounds)))
    best = F.struct(
        (-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row"
    )
    leaves = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("size"))
    levels = [settle(leaves)]
    for _ in range(rounds):
        levels.append(settle(_merge(levels[-1])))
    found = levels[-1].select(F.col("run").alias("up"), *KEY, F.col("best").alias("winner"), F.col("size").alias("all"))
    for level in reversed(levels[:-1]):
        low = level.select("run", *KEY, F.shiftright("run", 1).alias("up"))
        found = low.join(found.hint("merge"), ["up", *KEY]).select(F.col("run").alias("up"), *KEY, "winner", "all")
    return rows.join(found.withColumnRenamed("up", "run").hint("merge"), ["run", *KEY]).select(
        "doc_id",
        F.col("winner.id").alias("keep_id"),
        F.col("all").alias("group_size"),
        (F.col("winner.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
        *KEY,
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with; one row of fully repeated rows stays."""
    names, fields = docs.columns, [*KEY, "n_chars"]
    own = own_names(docs, *[f"_{c}" for c in fields], *[f"_kept_{c}" for c in fields], "_kept_id", "_copy")
    mine, theirs, kept_id, copy = own[:3], own[3:6], own[6], own[7]
    kept = exact_groups(docs, doc_id, text).where("kept").select(
        F.col("doc_id").alias(kept_id), *[F.col(c).alias(t) for c, t in zip(fields, theirs, strict=True)]
    )
    marked = docs.select(*[F.col(c) for c in names], *[d.alias(m) for d, m in zip(_digest(text), mine, strict=True)])
    same = F.col(doc_id).eqNullSafe(F.col(kept_id))
    for m, t in zip(mine, theirs, strict=True):
        same = same & (F.col(m) == F.col(t))
    key = [*mine, doc_id]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return marked.join(kept, same, "left_semi").withColumn(copy, first).where(F.col(copy) == 1).select(*names)
