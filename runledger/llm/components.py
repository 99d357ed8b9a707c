"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import settle


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w")
    tied = edges.join(low, F.col("a") == F.col("w")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(low.select("w", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links(a, b)`` that has a link.

    Every round is one written table, so lineage stays short and a lost executor costs one task. Hot nodes
    are aggregated before the shuffle and joined to one row, which adaptive execution splits. Self links
    and null ends are ignored; an empty table gives an empty table.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _signature(edges)
    while before[0]:
        edges = settle(_small_star(_large_star(edges).distinct()).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select("b", "b").distinct())
