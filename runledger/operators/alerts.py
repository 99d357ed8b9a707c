"""Alert rules as data: condition per tick, hold-down, and firing intervals, all rules in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.clock import SECOND, micros
from runledger.functions.ordered import Cut, by_time, scan, short_and_long
from runledger.operators.metrics import bucket_array, gauge_utilisation, method_windows, operation_rate, quantile_of
from runledger.schemas import COMMIT_BOUNDS, SHARD_BOUNDS
from runledger.session import settle

# Alert name, series, bound (fires above), hold in seconds, severity, summary.
RULES = [
    ("HighCheckpointWriteLatency", "shard_write_p99", 5.0, 120, "warning", "Checkpoint write p99 latency exceeds 5s"),
    ("HighCheckpointReadLatency", "shard_read_p99", 3.0, 120, "warning", "Checkpoint read p99 latency exceeds 3s"),
    # commit buckets end at 5 s and quantiles stop at the last finite bound, so this one cannot fire
    ("HighCommitLatency", "commit_p99", 10.0, 120, "warning", "Checkpoint commit p99 latency exceeds 10s"),
    ("CheckpointCommitErrorRate", "commit_error_ratio", 0.05, 120, "critical", "Checkpoint commit error rate exceeds 5%"),
    ("HighShardWriteErrorRate", "shard_write_error_ratio", 0.05, 120, "critical", "Shard write error rate exceeds 5%"),
    ("HighShardReadErrorRate", "shard_read_error_ratio", 0.05, 120, "critical", "Shard read error rate exceeds 5%"),
    ("HighAbortRate", "abort_rate", 0.1, 300, "warning", "Elevated checkpoint abort rate"),
    ("BackpressureQueueDepth", "queue_utilisation", 0.9, 60, "critical", "Backpressure queue above 90% capacity"),
    ("BackpressureQueueElevated", "queue_utilisation", 0.7, 300, "warning", "Backpressure queue above 70% capacity"),
    ("WorkerHeartbeatLag", "heartbeat_lag", 30.0, 30, "critical", "Worker heartbeat lag exceeds 30s"),
    ("WorkerHeartbeatWarning", "heartbeat_lag", 15.0, 60, "warning", "Worker heartbeat lag exceeds 15s"),
    ("HighGrpcErrorRate", "grpc_error_ratio", 0.05, 120, "critical", "gRPC error rate exceeds 5%"),
    ("GrpcMethodErrors", "grpc_error_rate", 0.5, 180, "warning", "Elevated gRPC errors"),
    ("HighGcDeletionRate", "gc_delete_rate", 100.0, 300, "warning", "Unusually high GC shard deletion rate"),
]

TICKS_PER_TASK = 250_000
FEW_TASKS = 8  # up to which Spark chooses their number

Rule = tuple[str, str, float, int, str, str]


def _rule_array(rules: Sequence[Rule]) -> Column:
    names = ("rule", "series", "bound", "hold_s", "severity", "summary")
    return F.array(
        *[F.struct(*[F.lit(float(v) if n == "bound" else v).alias(n) for n, v in zip(names, r)]) for r in rules]
    )


def default_rules(time_scale: int = 1) -> list[Rule]:
    """The 14 rules; ``time_scale`` stretches the hold times for coarser data."""
    return [(r, s, b, h * time_scale, v, m) for r, s, b, h, v, m in RULES]


def rule_table(spark: SparkSession, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Rules as a relation, for listing."""
    return spark.range(1).select(F.inline(_rule_array(rules)))


def evaluate_rules(series: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Condition per rule, label set and tick of (series, labels, tick, value); no value is false.

    The rules travel as a literal in the plan: all of them are evaluated in one pass, without a join.
    """
    matching = F.filter(_rule_array(rules), lambda r: r["series"] == F.col("series"))
    return series.withColumn("r", F.explode(matching)).select(
        "r.rule",
        "labels",
        "tick",
        "value",
        F.coalesce(F.col("value") > F.col("r.bound"), F.lit(False)).alias("cond"),
        "r.hold_s",
        "r.severity",
        "r.summary",
    )


def _streaks(conditions: DataFrame, keys: list[str], cut: Cut | None, step_s: int) -> DataFrame:
    """Add ``active_since``, the last tick up to the row at which a streak began."""
    before = scan(
        conditions, keys, ["tick"], cut, keep_slice=True, prev={"_was": F.col("cond"), "_at": "tick"}
    )
    begins = F.col("cond") & (
        ~F.coalesce("_was", F.lit(False)) | (micros("tick") - micros("_at") > step_s * SECOND)
    )
    started = before.withColumn("_start", F.when(begins, F.col("tick"))).drop("_was", "_at")
    return scan(started, keys, ["tick"], cut, known={"active_since": F.col("_start")}).drop("_start")


def hold_for(conditions: DataFrame, step_s: int, ticks_per_slice: int = 4096, tasks: int | None = None) -> DataFrame:
    """Add ``active_since`` and ``state``: inactive, pending, or firing once true for ``hold_s`` without a break.

    A missing tick breaks the streak like a false one. ``tasks`` is the number of tasks that sort the ticks, else Spark chooses it.
    """
    keys, cut = ["rule", "labels"], by_time("tick", step_s * SECOND * ticks_per_slice)
    short, long = short_and_long(conditions, keys, cut)
    held = _streaks(short.repartition(tasks, *keys) if tasks else short, keys, None, step_s)
    if long is not None:
        held = held.unionByName(_streaks(long, keys, cut, step_s))
    since = F.when(F.col("cond"), F.col("active_since"))
    lasted = micros("tick") - micros("active_since")
    state = (
        F.when(~F.col("cond"), "inactive")
        .when(lasted >= F.col("hold_s").cast("long") * SECOND, "firing")
        .otherwise("pending")
    )
    return held.withColumn("state", state).withColumn("active_since", since)


def alert_intervals(held: DataFrame) -> DataFrame:
    """One row per firing: start, end, peak value, and the message with labels and value filled in."""
    firing = held.where("state = 'firing'").groupBy("rule", "labels", "active_since").agg(
        F.min("tick").alias("fired_at"),
        F.max("tick").alias("last_tick"),
        F.max("value").alias("peak"),
        F.first("severity").alias("severity"),
        F.first("summary").alias("_summary"),
    )
    message = F.concat(
        "_summary",
        F.when(F.length("labels") > 0, F.concat(F.lit(" {"), "labels", F.lit("}"))).otherwise(""),
        F.lit(": "),
        F.round(F.col("peak").cast("decimal(20,8)"), 4).cast("string"),
    )
    return firing.withColumn("message", message).drop("_summary")


def firing_intervals(conditions: DataFrame, step_s: int, ticks_per_slice: int = 4096) -> DataFrame:
    """``alert_intervals`` of ``hold_for`` over all conditions, of which only the true ones are shuffled.

    A missing tick breaks a streak just as a false one does, and firing rows are true, so false ticks, of which healthy
    systems have little else, are dropped before the first exchange. The true ones are written once and counted: in a shuffle they
    are a tenth of their size in memory, so that the number of tasks has to follow the ticks, not the bytes shuffled.
    """
    true = settle(conditions.where("cond"))
    tasks = true.count() // TICKS_PER_TASK
    return alert_intervals(hold_for(true, step_s, ticks_per_slice, tasks if tasks >= FEW_TASKS else None))


def labelled(df: DataFrame, series: str, *labels: str) -> DataFrame:
    text = F.concat_ws(",", *[F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in labels]) if labels else F.lit("")
    return df.select(F.lit(series).alias("series"), text.alias("labels"), "tick", F.col("value").cast("double").alias("value"))


def operation_series(ops: DataFrame, range_s: int = 300, step_s: int = 15) -> DataFrame:
    """The series over operations: quantiles, error shares and rates, all from the windows of one aggregate."""
    bounds = sorted({*SHARD_BOUNDS, *COMMIT_BOUNDS})
    share = F.try_divide("errors", "total").cast("double")
    rate = (F.col("total") / F.lit(float(range_s))).cast("double")

    def entry(when: Column, series: str, value: Column, *labels: str) -> Column:
        text = F.concat_ws(",", *[F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in labels]) if labels else F.lit("")
        return F.when(when, F.struct(F.lit(series).alias("series"), text.alias("labels"), "tick", value.alias("value")))

    def of(method: str) -> Column:
        return (F.col("level") == "method") & (F.col("method") == method)

    def p99(only: Sequence[float]) -> Column:
        return quantile_of(bucket_array(bounds, "_timed", only), 0.99).cast("double")

    entries = [
        entry(of("write"), "shard_write_p99", p99(SHARD_BOUNDS)),
        entry(of("read"), "shard_read_p99", p99(SHARD_BOUNDS)),
        entry(of("commit"), "commit_p99", p99(COMMIT_BOUNDS)),
        entry(of("commit"), "commit_error_ratio", share),
        entry(of("write"), "shard_write_error_ratio", share),
        entry(of("read"), "shard_read_error_ratio", share),
        entry(of("abort"), "abort_rate", rate),
        entry(F.col("level") == "all", "grpc_error_ratio", share),
        entry((F.col("level") == "status") & (F.col("status") == "error"), "grpc_error_rate", rate, "method", "status"),
    ]
    windows = method_windows(ops, bounds, range_s, step_s)
    return windows.select(F.inline(F.array_compact(F.array(*entries))))


def rule_series(
    ops: DataFrame, depths: DataFrame, lags: DataFrame, deletions: DataFrame, range_s: int = 300, step_s: int = 15
) -> DataFrame:
    """Every series the rules look at.

    ops (ts, method, status, duration_s) with methods write, read, commit and abort; depths and lags
    (tick, value, and worker_id for lags) on the tick grid; deletions (ts, reason).
    """
    parts = [
        operation_series(ops, range_s, step_s),
        labelled(depths.withColumn("value", gauge_utilisation(F.col("value"))), "queue_utilisation"),
        labelled(lags, "heartbeat_lag", "worker_id"),
        labelled(operation_rate(deletions, ["reason"], range_s, step_s), "gc_delete_rate", "reason"),
    ]
    series = parts[0]
    for more in parts[1:]:
        series = series.unionByName(more)
    return series
