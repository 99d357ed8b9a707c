"""Streaming forms of the live operators; each ends with the rows of its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.clock import SECOND, micros
from runledger.operators.activity import is_highlighted
from runledger.operators.integrity import add_digest, plan_keys
from runledger.operators.metrics import bucket_array, le_counts, quantile_of
from runledger.session import settle
from runledger.sources.logs import parse_event_frames, parse_training_logs
from runledger.streaming.processors import CommitProcessor as _Commit
from runledger.streaming.processors import HoldProcessor as _Hold
from runledger.streaming.processors import KnownProcessor as _Known
from runledger.streaming.processors import ReplayProcessor as _Replay
from runledger.streaming.runner import END, read_batches, write_batch
from runledger.streaming.snapshots import compact_latest, keep_latest, latest_sink, read_latest  # noqa: F401


def _gap(seconds: float) -> str:
    """Session gap that a silence of exactly ``seconds`` does not yet close."""
    return f"{int(seconds * SECOND) + 1} microseconds"


def stream_outages(heartbeats: DataFrame, dead_s: float, delay: str = "1 hour") -> DataFrame:
    """A death notice once the watermark passes a worker's last heartbeat plus ``dead_s``."""
    quiet = heartbeats.withWatermark("ts", delay).groupBy("run_id", "worker_id", F.session_window("ts", _gap(dead_s)))
    return quiet.agg(F.max("ts").alias("last_seen")).select(
        "worker_id", "run_id", "last_seen", F.timestamp_micros(micros("last_seen") + int(dead_s * SECOND)).alias("declared_at")
    )


def stream_presence(pings: DataFrame, ttl_s: float, delay: str = "1 hour") -> DataFrame:
    """Closed visits."""
    visits = pings.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", _gap(ttl_s)))
    return visits.agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ping_at"), F.count("*").alias("n_pings")
    ).drop("session_window")


def _clocked(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows with their time in whole milliseconds, ``ms``, under a watermark that does not drop late ones itself.

    The watermark follows a copy of the time that is not handed on, so that late rows reach the operator, which reports them.
    """
    copied = rows.withColumn("_clock", F.col(ts)).withWatermark("_clock", delay)
    return copied.withColumn("ms", F.unix_millis("_clock")).where(F.col("_clock") < F.lit(END).cast("timestamp")).drop("_clock")


def _arriving(rows: DataFrame) -> DataFrame:
    """Rows with the time of their batch in milliseconds, ``ms``; the watermark is the time of the batch before."""
    return rows.withColumn("_clock", F.current_timestamp()).withWatermark("_clock", "0 seconds").withColumn("ms", F.unix_millis("_clock")).drop("_clock")


def stream_latest(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, for update mode; pair with ``latest_sink`` or ``keep_latest``, and ``read_latest``."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*key, *[f"r.{c}" for c in rest])


def stream_replay(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each requested change with the state it met and whether it was accepted, taken by (ts, seq) as the watermark passes it.

    However the rows are spread over batches, those on time give the rows of ``replay_transitions``. A row at or
    behind the watermark when it comes is ``late``: it is reported with no state and changes none. Rows of one run that wait are
    state; they are bounded by ``delay``.
    """
    asked = _clocked(events, "ts", delay).select("run_id", "ms", F.unix_micros("ts").alias("us"), "seq", "to_state")
    return asked.groupBy("run_id").transformWithStateInPandas(
        _Replay(["us", "seq", "to_state"], "us long, seq long, to_state string"),
        "run_id long, seq long, from_state string, to_state string, accepted boolean, late boolean", "Append", "EventTime",
    )


def stream_rates(ops: DataFrame, by: Sequence[str], range_: str = "5 minutes", step: str = "15 seconds", delay: str = "1 hour") -> DataFrame:
    """Operations and error ratio per closed sliding window, named by its end.

    Rows are counted once, in panes as wide as the step; the sliding windows, whose length must be a multiple of it,
    are sums over closed panes.
    """
    panes = ops.withWatermark("ts", delay).groupBy(*by, F.window("ts", step).alias("pane")).agg(
        F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("total")
    )
    counted = panes.groupBy(*by, F.window(F.window_time("pane"), range_, step)).agg(
        F.sum("errors").alias("errors"), F.sum("total").alias("total")
    )
    return counted.select(
        *by, F.col("window.end").alias("tick"), "errors", "total", F.try_divide("errors", "total").alias("value")
    )


def stream_histogram(ops: DataFrame, by: Sequence[str], bounds: Sequence[float], q: float, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Quantile of a histogram per closed tumbling window."""
    windows = ops.withWatermark("ts", delay).groupBy(*by, F.window("ts", width))
    counted = windows.agg(*le_counts(F.col("duration_s"), bounds), F.count("duration_s").alias("n"))
    return counted.select(
        *by, F.col("window.end").alias("tick"), "n", quantile_of(bucket_array(bounds, "n"), q).alias("value")
    )


def stream_alerts(conditions: DataFrame, step_s: int, delay: str = "1 hour") -> DataFrame:
    """Hold-down over a stream of evaluated ticks (rule, labels, tick, value, cond, hold_s), in the order of their ticks.

    Ticks wait as state until the watermark passes them; one at or behind it when it comes is reported as ``late``, without a state.
    """
    ticks = _clocked(conditions, "tick", delay).select(
        "rule", "labels", "ms", F.unix_micros("tick").alias("us"), "value", "cond", F.col("hold_s").cast("long").alias("hold_s")
    )
    found = ticks.groupBy("rule", "labels").transformWithStateInPandas(
        _Hold(["us", "value", "cond", "hold_s"], "us long, value double, cond boolean, hold_s long", int(step_s * SECOND)),
        "rule string, labels string, us long, value double, cond boolean, since long, state string, late boolean",
        "Append",
        "EventTime",
    )
    return found.select(
        "rule", "labels", F.timestamp_micros("us").alias("tick"), "value", "cond",
        F.timestamp_micros("since").alias("active_since"), "state", "late",
    )


def stream_logs(lines: DataFrame) -> DataFrame:
    """Parsed log lines with the highlight mark."""
    return parse_training_logs(lines).withColumn("highlighted", is_highlighted(F.col("line")))


def stream_run_events(frames: DataFrame, buckets: int = 64) -> DataFrame:
    """Event frames with the bucket of their run, to partition the feed by without a folder per run."""
    return parse_event_frames(frames).withColumn("run_bucket", F.pmod(F.crc32("run_id"), F.lit(buckets)).cast("int"))


COMMIT_ROW = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("checkpoint_id", T.LongType()),
        T.StructField("num_shards", T.LongType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("listed", T.StringType()),
        T.StructField("shard_id", T.StringType()),
    ]
)


def _with_need(rows: DataFrame, expected: int | DataFrame) -> DataFrame:
    if not isinstance(expected, DataFrame):
        return rows.withColumn("need", F.lit(expected).cast("long"))
    needs = expected.groupBy("checkpoint_id").agg(F.max("expected").cast("long").alias("need"))
    return rows.join(needs, "checkpoint_id", "left").withColumn("need", F.greatest(F.coalesce("need", F.lit(1)), F.lit(1)))


def stream_commits(shards: DataFrame, expected: int | DataFrame, keep_s: float = 7 * 86_400, buckets: int = 1_024) -> DataFrame:
    """A manifest row once as many different shards of a checkpoint have arrived as it needs; rows of ``COMMIT_ROW``.

    ``shards`` has (checkpoint_id, shard_id, size_bytes, uploaded_at, rank, part_no, host_no). ``expected`` is the number of
    shards a checkpoint needs, or a table (checkpoint_id, expected); a checkpoint it doesn't name, or names with none,
    needs one shard. A row of kind ``manifest`` lists every shard that has arrived by the end of the batch that completes it;
    repeats are ignored and the earliest upload of a shard counts. A later upload gives a row of kind ``late``.

    State is one row per shard of an open checkpoint and one per checkpoint, open or committed. All go once ``keep_s`` have passed between the batch
    of the checkpoint's last upload and a later one; shards of a checkpoint given up so, and those that come once its mark is gone, end in rows of kind
    ``open``, which ``read_commits`` tells apart by the manifests written.

    Checkpoints are dealt into ``buckets``, whose batch a task holds: a group to Python costs far more than a checkpoint in it.
    The number belongs to a stream's state and must not change under one.
    """
    arriving = _arriving(_with_need(shards, expected)).withColumn("at", F.unix_micros(F.col("uploaded_at").cast("timestamp")))
    # whole numbers with nulls among them would come to Python as floating point, so unknown ones are marked apart
    unknown = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(_Commit.NUMBERS)]
    rows = arriving.select(
        F.pmod(F.xxhash64("checkpoint_id"), F.lit(buckets)).alias("bucket"), "shard_id", "ms", F.col("need").cast("long").alias("need"),
        reduce(Column.__add__, unknown).alias("unknown"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _Commit.NUMBERS],
    )
    return rows.groupBy("bucket").transformWithStateInPandas(_Commit(int(keep_s * 1000)), COMMIT_ROW, "Append", "EventTime")


def commit_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    write_batch(batch, batch_id, out)


def read_commits(spark: SparkSession, out: str) -> DataFrame:
    """What the batches wrote, with ``batch_id``; rows of kind ``open`` become ``late`` where their checkpoint has a manifest."""
    rows = read_batches(spark, out, COMMIT_ROW)
    known = rows.where("kind = 'manifest'").select(F.col("checkpoint_id").alias("_known")).distinct()
    named = rows.join(known, F.col("checkpoint_id") == F.col("_known"), "left")
    late = (F.col("kind") == "open") & F.col("_known").isNotNull()
    return named.withColumn("kind", F.when(late, "late").otherwise(F.col("kind"))).select(*rows.columns)


UPLOAD_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType())])


def payload_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Arriving payload files ``<run>/<checkpoint>/<shard>`` below ``path`` as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    files = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -3).alias("run_id"),
        F.element_at(parts, -2).alias("checkpoint_id"),
        F.element_at(parts, -1).alias("shard_id"),
        F.col("content").alias("payload"),
    )


def stream_uploads(payloads: DataFrame, keep_s: float = 86_400) -> DataFrame:
    """(key, sidecar, fresh) of every content key a batch brings; ``fresh`` unless the key was met in the last ``keep_s`` seconds.

    A key is known by keyed state that goes ``keep_s`` after it was last met, by the times of batches, so state is bounded by the keys of
    that time, and a batch costs what it holds itself. Whether a fresh key is stored all the same is for ``upload_sink`` to look up.
    """
    keyed = _arriving(plan_keys(add_digest(payloads).drop("payload"))).select("key", "sidecar", "ms")
    return keyed.groupBy("key").transformWithStateInPandas(
        _Known(int(keep_s * 1000)), "key string, sidecar string, fresh boolean", "Append", "EventTime"
    )


def stored_in(objects: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Look-up of keys in a table of stored objects (key)."""
    return lambda keys: keys.join(objects.select("key").distinct(), "key", "left_semi")


def stored_below(root: str) -> Callable[[DataFrame], DataFrame]:
    """Look-up of keys as files below ``root``, one request a key, made by tasks; it costs the keys asked for, not those stored."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            found = fs.get_file_info([f"{base}/{k}" for k in batch.column("key").to_pylist()])
            yield batch.filter(pa.array([f.type == pafs.FileType.File for f in found], pa.bool_()))

    return lambda keys: keys.select("key").mapInArrow(look, "key string")


def upload_sink(stored: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int, str], None]:
    """A batch handler that records the objects to write: payloads whose key is neither in state nor ``stored``, and every sidecar.

    ``stored`` gives those of some keys that storage holds; only keys that state doesn't know are looked up, so that a key
    forgotten by state is still skipped.
    """

    def handle(batch: DataFrame, batch_id: int, out: str) -> None:
        rows = settle(batch)
        fresh = rows.where("fresh").select("key").distinct()
        if stored is not None:
            fresh = fresh.join(stored(fresh), "key", "left_anti")
        sidecars = rows.select(F.col("sidecar").alias("key"), F.lit("checksum").alias("kind"))
        write_batch(fresh.withColumn("kind", F.lit("shard")).union(sidecars).distinct(), batch_id, out)

    return handle


upload_batch = upload_sink()
