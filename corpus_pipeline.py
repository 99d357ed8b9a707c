"""A corpus pipeline: good documents, no copies, no near copies, mixed to target weights, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import bpe, exact, mixing, quality, simhash
from runledger.llm.common import id_remainder, table
from runledger.llm.queries import TOKENIZER
from runledger.session import prepare, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"), id_remainder(4) != 2)
    return quality.keep_good(docs, net)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest as written."""
    prepare(spark)
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints, the one of the smallest id."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    prepare(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each copy that the mix takes."""
    prepare(spark)
    return bpe.encode(docs, TOKENIZER, keep=False)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # a classifier, 64-bit hashes and merges are beyond SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
