"""Workers and liveness from heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import HOUR, SECOND, micros, seconds_between
from runledger.functions.ordered import by_time, scan

# Liveness defaults in seconds.
TIMEOUT_S = 30
DEAD_S = 60


def hundredths(us: Column) -> Column:
    """Microseconds as seconds with two decimals (half up, exact)."""
    return F.round(us.cast("decimal(20,0)") / F.lit(SECOND).cast("decimal(20,0)"), 2).cast("double")


def assign_ranks(registrations: DataFrame, slice_us: int = HOUR) -> DataFrame:
    """Rank 0, 1, 2, ... per run in registration order; a rank is never given out twice."""
    return scan(
        registrations,
        ["run_id"],
        ["registered_at", "worker_id"],
        by_time("registered_at", slice_us),
        total={"_n": F.lit(1).cast("long")},
    ).select("run_id", "worker_id", "registered_at", (F.col("_n") - 1).alias("rank"))


def last_heartbeats(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("run_id", "worker_id").agg(
        F.max("ts").alias("last_heartbeat"), F.max_by("step", F.struct("ts", "step")).alias("last_step")
    )


def heartbeat_lag(heartbeats: DataFrame, now: Column, dead_s: float | None = None) -> DataFrame:
    """Seconds since the last heartbeat; workers silent for longer than ``dead_s`` are not alive and left out."""
    lag_us = micros(now) - micros("last_heartbeat")
    lags = last_heartbeats(heartbeats).withColumn("_us", lag_us)
    if dead_s is not None:
        lags = lags.where(F.col("_us") <= int(dead_s * SECOND))
    return lags.select("run_id", "worker_id", "last_heartbeat", hundredths(F.col("_us")).alias("lag_s"))


def classify_liveness(lags: DataFrame, timeout_s: float = TIMEOUT_S, dead_s: float = DEAD_S) -> DataFrame:
    lag = F.col("lag_s")
    return lags.withColumn(
        "liveness", F.when(lag > dead_s, "DEAD").when(lag > timeout_s, "UNRESPONSIVE").otherwise("ALIVE")
    )


def heartbeat_outages(heartbeats: DataFrame, dead_s: float = DEAD_S, slice_us: int = HOUR) -> DataFrame:
    """Every silence longer than ``dead_s``: declared dead once, ended by the next heartbeat."""
    return (
        scan(heartbeats, ["run_id", "worker_id"], ["ts", "step"], by_time("ts", slice_us, "step"), next={"back_at": "ts"})
        .where(micros("back_at") - micros("ts") > int(dead_s * SECOND))
        .select(
            "worker_id",
            "run_id",
            F.col("ts").alias("last_seen"),
            F.timestamp_micros(micros("ts") + int(dead_s * SECOND)).alias("declared_at"),
            "back_at",
            seconds_between(F.col("ts"), F.col("back_at")).alias("outage_s"),
        )
    )


def deaths_until(heartbeats: DataFrame, dead_s: float, now: Column, slice_us: int = HOUR) -> DataFrame:
    """Death notices declared by ``now``, also for workers that never came back."""
    dead_us = int(dead_s * SECOND)
    seen = scan(heartbeats, ["run_id", "worker_id"], ["ts", "step"], by_time("ts", slice_us, "step"), next={"_next": "ts"})
    silent = F.col("_next").isNull() | (micros("_next") - micros("ts") > dead_us)
    return (
        seen.where(silent)
        .select(
            "worker_id",
            "run_id",
            F.col("ts").alias("last_seen"),
            F.timestamp_micros(micros("ts") + dead_us).alias("declared_at"),
        )
        .where(F.col("declared_at") <= now)
    )


def drop_unknown_heartbeats(heartbeats: DataFrame, workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heartbeats of registered workers, count of ignored heartbeats per unregistered worker).

    A worker is registered for a run: its heartbeat in another run is ignored and reported like that of a stranger.
    """
    lease = ["run_id", "worker_id"]
    known = heartbeats.join(workers.select(*lease), lease, "left_semi").select(*heartbeats.columns)
    ignored = (
        heartbeats.groupBy(*lease)
        .agg(F.count("*").alias("n_ignored"), F.max("ts").alias("last_ts"))
        .join(workers.select(*lease), lease, "left_anti")
    )
    return known, ignored


def worker_state(registrations: DataFrame, heartbeats: DataFrame, deaths: DataFrame) -> DataFrame:
    """Latest step, heartbeat and status of each registered worker.

    A death notice makes the recorded status DEAD for good, while a later heartbeat revives the lease;
    both are shown.
    """
    beats = heartbeats.groupBy("run_id", "worker_id").agg(
        F.max("ts").alias("last_heartbeat"), F.max_by("step", F.struct("ts", "step")).alias("current_step")
    )
    died = deaths.groupBy("run_id", "worker_id").agg(F.max("declared_at").alias("_died"))
    return (
        registrations.join(beats, ["run_id", "worker_id"], "left")
        .join(died, ["run_id", "worker_id"], "left")
        .select(
            "worker_id",
            "run_id",
            "last_heartbeat",
            "current_step",
            F.when(F.col("_died").isNotNull(), "DEAD").otherwise("ACTIVE").alias("status"),
            (F.col("_died").isNull() | (F.coalesce(F.col("last_heartbeat") > F.col("_died"), F.lit(False)))).alias(
                "lease_alive"
            ),
        )
    )


def active_workers(workers: DataFrame) -> DataFrame:
    """Active and total workers per run, and over all runs on the row with a null run."""
    return workers.rollup("run_id").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count("*").alias("total")
    )


def top_workers(workers: DataFrame, k: int = 2) -> DataFrame:
    """The k most relevant workers per run: active ones first, then by latest heartbeat."""
    order = Window.partitionBy("run_id").orderBy(
        F.when(F.col("status") == "ACTIVE", 0).otherwise(1), F.desc("last_heartbeat"), "worker_id"
    )
    return workers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def failed_runs(deaths: DataFrame) -> DataFrame:
    """Runs hit by at least one death notice."""
    return deaths.select("run_id").distinct()


def worker_lag_join(workers: DataFrame, lags: DataFrame) -> DataFrame:
    """Workers with their lag; both sides have one row per (run_id, worker_id)."""
    return workers.join(lags.select("run_id", "worker_id", "lag_s"), ["run_id", "worker_id"], "left").withColumn(
        "lag_s", F.coalesce("lag_s", F.lit(0.0))
    )
