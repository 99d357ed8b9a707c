"""Current rows per key: change folders of batches, and versioned snapshots that stand for the older ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.streaming.runner import write_batch


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path, so that every store Spark reads is reached."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers n of the entries ``prefix`` + n of a folder, ascending; names only, a few per batch since the last snapshot."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def current_version(spark: SparkSession, out: str) -> int | None:
    """The batch up to which the newest published snapshot holds everything, or none."""
    return next(iter(reversed(_numbers(spark, f"{out}/published", "v"))), None)


def _changes(spark: SparkSession, out: str, schema: T.StructType, after: int | None) -> DataFrame:
    """The rows of the change folders after a batch, with their ``batch_id``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
    ids = [n for n in _numbers(spark, out, "batch_id=") if after is None or n > after]
    if not ids:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", out).parquet(*[f"{out}/batch_id={n}" for n in ids])


def read_latest(spark: SparkSession, out: str, schema: T.StructType, key: Sequence[str], op: str = "op") -> DataFrame:
    """Current row per key, deleted keys left out: the newest snapshot and the change folders after it, nothing older."""
    version = current_version(spark, out)
    rows = _changes(spark, out, schema, version)
    if version is not None:
        kept = T.StructType([f for f in schema.fields if f.name != op])
        old = spark.read.schema(kept).parquet(f"{out}/snapshot={version}")
        rows = rows.unionByName(old.withColumn(op, F.lit("put")).withColumn("batch_id", F.lit(version)))
    rest = [c for c in rows.columns if c not in (*key, "batch_id")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return last.where(F.col(f"r.{op}") != "delete").select(*key, *[f"r.{c}" for c in rest if c != op])


def compact_latest(spark: SparkSession, out: str, schema: T.StructType, key: Sequence[str], op: str = "op") -> int | None:
    """Write the current rows as a snapshot, publish it, and remove what the snapshot before it stands for; its version.

    The snapshot is written whole under its own name first. It counts once an empty file of its version stands in ``published``, which is
    created in one step or not at all, so a run that dies leaves the older snapshot in force and is repeated by the next.
    Folders the older snapshot needs are kept until the next one, for readers that began with it.
    """
    before = current_version(spark, out)
    ids = [n for n in _numbers(spark, out, "batch_id=") if before is None or n > before]
    if not ids:
        return before
    version = ids[-1]
    read_latest(spark, out, schema, key, op).write.mode("overwrite").parquet(f"{out}/snapshot={version}")
    fs, mark = _files(spark, f"{out}/published/v{version}")
    fs.create(mark, True).close()
    if before is not None:
        for prefix, inclusive in (("batch_id=", True), ("snapshot=", False)):
            for n in _numbers(spark, out, prefix):
                if n < before or (inclusive and n == before):
                    fs.delete(_files(spark, f"{out}/{prefix}{n}")[1], True)
        for n in _numbers(spark, f"{out}/published", "v"):
            if n < before:
                fs.delete(_files(spark, f"{out}/published/v{n}")[1], True)
    return version


def keep_latest(batch: DataFrame, batch_id: int, out: str) -> None:
    write_batch(batch, batch_id, out)


def latest_sink(schema: T.StructType, key: Sequence[str], every: int = 100, op: str = "op") -> Callable[[DataFrame, int, str], None]:
    """A batch handler that keeps a batch's changes and makes a snapshot after every so many batches."""

    def handle(batch: DataFrame, batch_id: int, out: str) -> None:
        keep_latest(batch, batch_id, out)
        if (batch_id + 1) % every == 0:
            compact_latest(batch.sparkSession, out, schema, key, op)

    return handle
