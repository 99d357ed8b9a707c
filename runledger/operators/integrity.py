"""Payload chunks, digests, content-addressed keys and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.ordered import scan
from runledger.schemas import CHUNK_BYTES, MANIFEST_NAME

_SHARD = ["checkpoint_id", "shard_id"]


def chunk_payload(df: DataFrame, column: str = "payload", size: int = CHUNK_BYTES) -> DataFrame:
    """Slices of a binary column with offset, data and is_last; an empty payload has no slice."""
    n = F.octet_length(column).cast("long")
    keep = [c for c in df.columns if c != column]
    return (
        df.where(F.octet_length(column) > 0)
        .select(*keep, column, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("offset"))
        .select(
            *keep,
            "offset",
            F.substring(F.col(column), (F.col("offset") + 1).cast("int"), F.lit(size)).alias("data"),
            (F.col("offset") + size >= F.col("_n")).alias("is_last"),
        )
    )


def assemble_chunks(chunks: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Payload per (checkpoint_id, shard_id, piece), with the byte total and chunk count of the whole shard.

    A payload must fit one cell, so a shard comes in pieces: piece n holds the chunks whose offset lies in the n-th
    ``max_bytes``. Pieces in order are the whole shard, of which most have just piece 0.
    """
    totals = chunks.groupBy(*_SHARD).agg(
        F.sum(F.octet_length("data").cast("long")).alias("total_bytes"), F.count("*").alias("n_chunks")
    )
    piece = F.call_function("div", F.col("offset"), F.lit(max_bytes)).cast("long")
    pieces = chunks.groupBy(*_SHARD, piece.alias("piece")).agg(
        F.expr("listagg(data) within group (order by offset)").alias("payload")
    )
    right = totals.select(*[F.col(c).alias(f"_{c}") for c in _SHARD], "total_bytes", "n_chunks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SHARD]
    return pieces.join(right, same).select(*_SHARD, "piece", "payload", "total_bytes", "n_chunks")


def check_chunk_sequence(chunks: DataFrame, slice_bytes: int = 256 * CHUNK_BYTES) -> DataFrame:
    """Per shard: gaps, overlaps and the number of last-flags, which must be exactly one on the final chunk.

    ``chunks`` carries checkpoint_id, shard_id, offset, n_bytes and is_last.
    """
    end = F.col("offset") + F.col("n_bytes")
    ordered = scan(
        chunks,
        _SHARD,
        ["offset", "n_bytes"],
        F.floor(F.col("offset") / slice_bytes),
        prev={"_end": end},
        next={"_next": "offset"},
    )
    expected = F.coalesce("_end", F.lit(0))
    checked = ordered.groupBy(*_SHARD).agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("offset") > expected).alias("gaps"),
        F.count_if(F.col("offset") < expected).alias("overlaps"),
        F.count_if("is_last").alias("last_flags"),
        F.count_if(F.col("is_last") & F.col("_next").isNull()).alias("_closed"),
    )
    verdict = (
        F.when(F.col("gaps") > 0, "gap")
        .when(F.col("overlaps") > 0, "overlap")
        .when(F.col("last_flags") == 0, "missing_last")
        .when(F.col("last_flags") > 1, "multiple_last")
        .when(F.col("_closed") == 0, "last_not_final")
        .otherwise("ok")
    )
    return checked.withColumn("verdict", verdict).drop("_closed")


def add_digest(df: DataFrame, column: str = "payload") -> DataFrame:
    """Lower-case hex SHA-256 and length in bytes."""
    return df.withColumns({"sha256": F.sha2(column, 256), "n_bytes": F.octet_length(column).cast("long")})


def content_key(run_id: Column, checkpoint_id: Column, shard_id: Column, sha256: Column) -> Column:
    """``run/checkpoint/sha256-<first 16 hex>-<shard>.bin``"""
    file = F.concat(F.lit("sha256-"), F.substring(sha256, 1, 16), F.lit("-"), shard_id, F.lit(".bin"))
    return F.concat_ws("/", run_id, checkpoint_id, file)


def sidecar_key(run_id: Column, checkpoint_id: Column, shard_id: Column) -> Column:
    return F.concat_ws("/", run_id, checkpoint_id, F.concat(shard_id, F.lit(".sha256")))


def manifest_key(run_id: Column, checkpoint_id: Column) -> Column:
    return F.concat_ws("/", run_id, checkpoint_id, F.lit(MANIFEST_NAME))


def plan_keys(shards: DataFrame) -> DataFrame:
    """(key, sidecar) of digested shards."""
    ids = [F.col(c).cast("string") for c in ("run_id", "checkpoint_id", "shard_id")]
    return shards.select(content_key(*ids, F.col("sha256")).alias("key"), sidecar_key(*ids).alias("sidecar"))


def plan_uploads(shards: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects to write for digested shards: payloads whose key is not stored yet, and every sidecar."""
    keyed = plan_keys(shards)
    data = keyed.select("key").distinct().join(existing.select("key"), "key", "left_anti")
    sidecars = keyed.select(F.col("sidecar").alias("key")).distinct()
    return data.withColumn("kind", F.lit("shard")).unionByName(sidecars.withColumn("kind", F.lit("checksum")))


def dedup_report(digested: DataFrame) -> DataFrame:
    """Per digest: copies, bytes, and the bytes that storing it once saves."""
    return digested.groupBy("sha256").agg(
        F.count("*").alias("copies"),
        F.max("n_bytes").alias("n_bytes"),
        (F.sum("n_bytes") - F.max("n_bytes")).alias("saved_bytes"),
    )


def verify_shards(stored: DataFrame, manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Compare stored payloads with what manifest and sidecar say.

    stored (checkpoint_id, shard_id, payload), manifest (.., sha256, size_bytes), sidecars (.., sha256).
    """
    found = add_digest(stored).select(*_SHARD, F.col("sha256").alias("_digest"), F.col("n_bytes").alias("_bytes"))
    listed = manifest.select(*_SHARD, F.col("sha256").alias("_listed"), F.col("size_bytes").alias("_size"))
    noted = sidecars.select(*_SHARD, F.col("sha256").alias("_noted"))
    status = (
        F.when(F.col("_listed").isNull() & F.col("_digest").isNull(), "orphan_sidecar")
        .when(F.col("_listed").isNull(), "unlisted")
        .when(F.col("_digest").isNull(), "missing_object")
        .when(F.col("_bytes") != F.col("_size"), "size_mismatch")
        .when(F.col("_digest") != F.col("_listed"), "digest_mismatch")
        .when(F.col("_noted").isNull(), "missing_sidecar")
        .when(F.col("_digest") != F.col("_noted"), "digest_mismatch")
        .otherwise("ok")
    )
    both = listed.join(found, _SHARD, "full_outer")
    return both.join(noted, _SHARD, "full_outer").select(*_SHARD, status.alias("status"))


def audit_manifests(manifests: DataFrame, shards: DataFrame) -> DataFrame:
    """Declared shard count and bytes per checkpoint against the shard rows."""
    actual = shards.groupBy("checkpoint_id").agg(
        F.count("*").alias("actual_shards"), F.sum("size_bytes").alias("actual_bytes")
    )
    declared = manifests.select("checkpoint_id", "num_shards", "total_bytes")
    same_n = F.col("num_shards") == F.col("actual_shards")
    same_bytes = F.col("total_bytes") == F.col("actual_bytes")
    return declared.join(actual, "checkpoint_id", "full_outer").withColumn(
        "verdict",
        F.when(F.col("num_shards").isNull(), "no_manifest")
        .when(F.col("actual_shards").isNull(), "no_shards")
        .when(same_n & same_bytes, "ok")
        .when(same_bytes, "count_mismatch")
        .when(same_n, "bytes_mismatch")
        .otherwise("both_mismatch"),
    )


def latest_shard_upload(shards: DataFrame, tie_order: list[str]) -> DataFrame:
    """Newest upload per (checkpoint, shard) and how many older ones it supersedes."""
    rest = [c for c in shards.columns if c not in _SHARD]
    newest = shards.groupBy(*_SHARD).agg(
        F.max_by(F.struct(*rest), F.struct("uploaded_at", *tie_order)).alias("s"),
        (F.count("*") - 1).alias("superseded"),
    )
    return newest.select(*_SHARD, *[f"s.{c}" for c in rest], "superseded")


def shard_status(requests: DataFrame, shards: DataFrame) -> DataFrame:
    """Per requested (checkpoint, shard): whether it is stored, its size and checksum."""
    held = shards.select(*_SHARD, "size_bytes", "sha256")
    return requests.join(held, _SHARD, "left").select(
        *_SHARD,
        F.col("sha256").isNotNull().alias("is_present"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
    )
