"""Splitting datasets over workers, slices, batches and loss curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import micros
from runledger.functions.ordered import SLICES_PER_BLOCK
from runledger.schemas import SHARDING_POLICIES

ROWS_PER_SLICE = 65_536


def key_slice(key: str, width: int = ROWS_PER_SLICE) -> Column:
    """Slice of a whole-number key; a unique key puts at most ``width`` rows in each."""
    return F.floor(F.col(key) / width)


def hash_slice(digest: str, digits: int = 5) -> Column:
    """Slice of a hex digest: its first digits as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def global_ordinal(df: DataFrame, order: list[str], slice_by: Column) -> DataFrame:
    """Dense 0-based ``ordinal`` by ``order`` and the row count ``n_rows``, without one big partition.

    ``slice_by`` is a whole number that doesn't decrease along ``order``; nulls come first. Rows are numbered inside
    their slice, slices are summed inside blocks of neighbouring slices, and only the blocks meet in one task.
    """
    rows = df.withColumn("_slice", slice_by.cast("long"))
    slices = rows.groupBy("_slice").agg(F.count("*").alias("_n")).withColumn(
        "_block", F.floor(F.col("_slice") / SLICES_PER_BLOCK)
    )
    in_order = Window.orderBy("_block")
    blocks = slices.groupBy("_block").agg(F.sum("_n").alias("_n")).select(
        F.col("_block").alias("_b"),
        F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_first"),
        F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    before = Window.partitionBy("_block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = slices.select("_block", F.col("_slice").alias("_s"), F.sum("_n").over(before).alias("_before"))
    starts = inside.join(blocks, F.col("_block").eqNullSafe(F.col("_b"))).select(
        "_s", (F.coalesce("_first", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("_start"), "n_rows"
    )
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    placed = rows.withColumn("_place", place).join(starts, F.col("_slice").eqNullSafe(F.col("_s")))
    return placed.select(*df.columns, "n_rows", (F.col("_start") + F.col("_place")).alias("ordinal"))


def stable_bucket(key: Column, n: int) -> Column:
    """Bucket 0..n-1 from the first 8 hex digits of SHA-256, the same in any engine."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def assign_shards(df: DataFrame, n: int, policy: str, key: str, slice_by: Column | None = None) -> DataFrame:
    """Add ``shard`` 0..n-1 (full replication repeats every row once per shard)."""
    if policy not in SHARDING_POLICIES:
        raise ValueError(f"unknown sharding policy {policy!r}")
    if policy == "FULL_REPLICATION":
        return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if policy == "HASH_SHARDING":
        return df.withColumn("shard", stable_bucket(F.col(key), n))
    placed = global_ordinal(df, [key], key_slice(key) if slice_by is None else slice_by)
    if policy == "RANGE_SHARDING":
        shard = F.call_function("div", F.col("ordinal") * n, F.col("n_rows"))
    else:
        shard = F.col("ordinal") % n
    return placed.withColumn("shard", shard.cast("int")).drop("ordinal", "n_rows")


def shard_sizes(assigned: DataFrame, size: str) -> DataFrame:
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def shard_balance(assigned: DataFrame, size: str) -> DataFrame:
    """One row: shards, rows and bytes per shard (min, max, mean) and the skew max / mean."""
    sizes = shard_sizes(assigned, size)
    stats = [F.count("*").alias("n_shards")]
    for name in ("n_rows", "n_bytes"):
        stats += [
            F.min(name).alias(f"min_{name}"),
            F.max(name).alias(f"max_{name}"),
            (F.sum(name) / F.count("*")).alias(f"mean_{name}"),
            (F.max(name) * F.count("*") / F.sum(name)).alias(f"skew_{name}"),
        ]
    return sizes.agg(*stats)


def dataset_slice(
    df: DataFrame, key: str, shard_index: int, total_shards: int, offset: int = 0, limit: int = 0,
    slice_by: Column | None = None,
) -> DataFrame:
    """Rows of one range shard from ``offset``, at most ``limit`` (0 = all); ``is_last`` on the shard's end."""
    placed = global_ordinal(df, [key], key_slice(key) if slice_by is None else slice_by)
    start = F.ceil(F.col("n_rows") * shard_index / total_shards).cast("long")
    end = F.ceil(F.col("n_rows") * (shard_index + 1) / total_shards).cast("long")
    upto = end if limit == 0 else F.least(end, start + offset + limit)
    return placed.where((F.col("ordinal") >= start + offset) & (F.col("ordinal") < upto)).select(
        *df.columns,
        (F.col("ordinal") - start).alias("position"),
        (F.col("ordinal") == end - 1).alias("is_last"),
    )


def make_batches(df: DataFrame, key: str, size: int, seed: int, drop_last: bool = True, digits: int = 5) -> DataFrame:
    """Shuffle reproducibly by a seeded digest of the key and number batches of ``size`` rows."""
    mixed = df.withColumn("_mix", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256))
    placed = global_ordinal(mixed, ["_mix", key], hash_slice("_mix", digits))
    batched = placed.withColumns(
        {"batch": F.call_function("div", F.col("ordinal"), F.lit(size)), "place": F.col("ordinal") % size}
    )
    if drop_last:
        batched = batched.where(F.col("batch") < F.call_function("div", F.col("n_rows"), F.lit(size)))
    return batched.drop("_mix", "ordinal", "n_rows")


def loss_curve(steps: DataFrame, every: int = 50) -> DataFrame:
    """Mean loss per complete block of ``every`` steps, and steps per second since the run's first step."""
    block = F.call_function("div", F.col("step") - 1, F.lit(every))
    blocks = (
        steps.groupBy("run_id", block.alias("block"))
        .agg(
            F.avg("loss").alias("mean_loss"),
            F.count("*").alias("_n"),
            F.max("step").alias("step"),
            F.max("ts").alias("_until"),
            F.min("ts").alias("_since"),
            F.min("step").alias("_first"),
        )
    )
    start = blocks.groupBy("run_id").agg(F.min("_since").alias("_start"), F.min("_first").alias("_step0"))
    elapsed = (micros("_until") - micros("_start")) / F.lit(1e6)
    return (
        blocks.where(F.col("_n") == every)
        .join(start, "run_id")
        .select(
            "run_id",
            "step",
            "mean_loss",
            F.when(elapsed > 0, (F.col("step") - F.col("_step0") + 1) / elapsed).otherwise(0.0).alias("steps_per_s"),
        )
    )


def register_datasets(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datasets with defaults filled in, requests with an unknown policy)."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    filled = requests.withColumns(
        {
            "dataset_id": F.coalesce("dataset_id", F.lit("")),
            "uri": F.coalesce("uri", F.lit("")),
            "sharding_policy": F.coalesce("sharding_policy", F.lit("RANGE_SHARDING")),
            "metadata": F.coalesce("metadata", empty),
        }
    )
    known = F.col("sharding_policy").isin(SHARDING_POLICIES)
    return filled.where(known), filled.where(~known)
