"""Checkpoints: recovery points, cadence, and clean-up plans over stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import DAY, micros
from runledger.functions.ordered import by_number, by_time, scan, scan_short
from runledger.schemas import OPEN_CHECKPOINT_STATES
from runledger.sources.objects import is_manifest, object_parts

_NEWEST = ("step", "created_at", "checkpoint_id")


def checkpoints_of(checkpoints: DataFrame, run_id) -> DataFrame:
    """One run's checkpoints by step."""
    return checkpoints.where(F.col("run_id") == run_id).orderBy(*_NEWEST)


def checkpoint_positions(checkpoints: DataFrame, steps_per_slice: int = 10_000) -> DataFrame:
    """Every run's checkpoints with their 1-based position by step."""
    return scan(
        checkpoints, ["run_id"], list(_NEWEST), by_number("step", steps_per_slice),
        total={"position": F.lit(1).cast("long")},
    )


def _highest(checkpoints: DataFrame, state: str) -> DataFrame:
    fields = ["checkpoint_id", "step", "created_at", "committed_at"]
    best = checkpoints.where(F.col("state") == state).groupBy("run_id").agg(
        F.max_by(F.struct(*fields), F.struct(*_NEWEST)).alias("c")
    )
    return best.select("run_id", *[f"c.{f}" for f in fields])


def recovery_point(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Highest committed checkpoint per run; null means start afresh."""
    best = _highest(checkpoints, "COMMITTED").select("run_id", "checkpoint_id", "step", "committed_at")
    return runs.select("run_id").join(best, "run_id", "left")


def recovery_point_asof(failures: DataFrame, checkpoints: DataFrame, slice_us: int = 90 * DAY) -> DataFrame:
    """For each failure the last checkpoint of the run committed at or before it."""
    commits = checkpoints.where("state = 'COMMITTED'").select(
        "run_id",
        F.col("committed_at").alias("ts"),
        F.lit(0).alias("side"),
        F.col("checkpoint_id").alias("id"),
        F.struct("checkpoint_id", "step", "committed_at").alias("point"),
    )
    asked = failures.select(
        "run_id", F.col("failed_at").alias("ts"), F.lit(1).alias("side"), F.col("failure_id").alias("id")
    )
    both = commits.unionByName(asked, allowMissingColumns=True)
    found = scan(both, ["run_id"], ["ts", "side", "id"], by_time("ts", slice_us), known={"point": F.col("point")})
    return found.where("side = 1").select(
        F.col("id").alias("failure_id"),
        "run_id",
        F.col("ts").alias("failed_at"),
        "point.checkpoint_id",
        "point.step",
        "point.committed_at",
    )


def lost_steps(workers: DataFrame, recovery: DataFrame) -> DataFrame:
    """Steps each worker repeats when its run resumes from its recovery point (step 0 without one)."""
    resume = recovery.select("run_id", F.col("step").alias("_step"))
    return workers.join(resume, "run_id", "left").select(
        "run_id",
        "worker_id",
        "current_step",
        F.coalesce("_step", F.lit(0)).cast("long").alias("resume_step"),
        F.greatest(F.col("current_step") - F.coalesce("_step", F.lit(0)), F.lit(0)).cast("long").alias("lost_steps"),
    )


def active_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint a commit request of the run would commit."""
    return _highest(checkpoints, "IN_PROGRESS").select("run_id", "checkpoint_id", "step", "created_at")


def abort_pending(checkpoints: DataFrame, failed_runs: DataFrame) -> DataFrame:
    """Open checkpoints of failed runs become FAILED; everything else stays."""
    failed = failed_runs.select("run_id").distinct().withColumn("_failed", F.lit(True))
    open_ = F.col("state").isin(OPEN_CHECKPOINT_STATES)
    return (
        checkpoints.join(failed, "run_id", "left")
        .withColumn("state", F.when(F.col("_failed") & open_, "FAILED").otherwise(F.col("state")))
        .drop("_failed")
    )


def apply_checkpoint_updates(checkpoints: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Fold update rows (null field = keep) into checkpoints; the first commit time stays.

    State, bytes, shard count and shard ids are folded, as far as the updates have them. A checkpoint that has no shard count or
    ids yet has 0 and none.
    """
    position = F.struct(*order)
    empty = F.array().cast("array<string>")
    folded = [c for c in ("state", "total_bytes", "num_shards", "shard_ids") if c in updates.columns]
    defaults = {"num_shards": F.lit(0).cast("long"), "shard_ids": empty}

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), position)).alias(f"_{name}")

    news = updates.groupBy("checkpoint_id").agg(
        *[latest(c) for c in folded], F.min(F.when(F.col("state") == "COMMITTED", F.col("ts"))).alias("_committed_at")
    )

    def field(name: str) -> Column:
        known = [F.col(f"_{name}")] if name in folded else []
        known += [F.col(name)] if name in checkpoints.columns else []
        return F.coalesce(*known, *[defaults[name] for _ in (1,) if name in defaults]).alias(name)

    return checkpoints.join(news, "checkpoint_id", "left").select(
        "checkpoint_id", "run_id", "step", "created_at", field("state"), field("total_bytes"), field("num_shards"), field("shard_ids"),
        F.coalesce("committed_at", "_committed_at").alias("committed_at"),
    )


def last_checkpoint_per_run(checkpoints: DataFrame) -> DataFrame:
    """Newest created checkpoint per run, whatever its state."""
    return checkpoints.groupBy("run_id").agg(
        F.max_by("checkpoint_id", F.struct("created_at", "checkpoint_id")).alias("last_checkpoint_id")
    )


def checkpoint_cadence(checkpoints: DataFrame, runs: DataFrame, steps_per_slice: int = 10_000) -> DataFrame:
    """Steps since the run's previous checkpoint, late when above the run's interval."""
    stepped = scan(
        checkpoints, ["run_id"], ["step", "checkpoint_id"], by_number("step", steps_per_slice),
        prev={"_before": "step"},
    )
    return (
        stepped.join(runs.select("run_id", "checkpoint_interval_steps"), "run_id")
        .withColumn("step_delta", F.col("step") - F.col("_before"))
        .select(
            "run_id",
            "checkpoint_id",
            "step",
            "step_delta",
            F.coalesce(F.col("step_delta") > F.col("checkpoint_interval_steps"), F.lit(False)).alias("late"),
        )
    )


def missing_checkpoints(checkpoints: DataFrame, runs: DataFrame, interval: Column | None = None) -> DataFrame:
    """Multiples of the interval a run has passed without a committed checkpoint at that step."""
    every = (F.col("checkpoint_interval_steps") if interval is None else interval).cast("long")
    due = runs.where(F.col("current_step") >= every).select(
        "run_id", F.explode(F.sequence(every, F.col("current_step"), every)).alias("step")
    )
    done = checkpoints.where("state = 'COMMITTED'").select("run_id", "step")
    return due.join(done, ["run_id", "step"], "left_anti")


def checkpoint_durations(saves: DataFrame, restores: DataFrame, n: int = 30) -> DataFrame:
    """The last n save times beside the restore time of the same ordinal (0 when there is none)."""

    def last(df: DataFrame, name: str) -> DataFrame:
        newest = df.orderBy(F.desc("ts"), F.desc("op_id")).limit(n)
        place = Window.orderBy("ts", "op_id")  # at most n rows
        return newest.select(
            (F.row_number().over(place) - 1).alias("index"), F.round("duration_s", 3).alias(name)
        )

    return (
        last(saves, "save")
        .join(last(restores, "restore"), "index", "left")
        .withColumn("restore", F.coalesce("restore", F.lit(0.0)))
    )


def checkpoint_totals(checkpoints: DataFrame) -> DataFrame:
    """Totals over checkpoints that carry ``num_shards``."""
    totals = checkpoints.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("state") == "COMMITTED").alias("committed"),
        F.sum("num_shards").alias("shards"),
        F.sum("total_bytes").alias("bytes"),
    )
    return totals.withColumn("mean_shard_bytes", F.col("bytes") / F.greatest("shards", F.lit(1)))


def checkpoint_listing(checkpoints: DataFrame) -> DataFrame:
    """Newest first, one row per shard id with its ordinal."""
    return checkpoints.select(
        "run_id", "checkpoint_id", "state", "created_at", F.posexplode_outer("shard_ids").alias("ordinal", "shard_id")
    ).orderBy(F.desc("created_at"), F.desc("checkpoint_id"), "ordinal")


def resolve_shard(workers: DataFrame, shards: DataFrame) -> DataFrame:
    """Shard each worker (checkpoint_id, rank) reads: its own, else rank 0's, else an error."""
    held = shards.select("checkpoint_id", "shard_id").distinct()
    own = held.select("checkpoint_id", F.col("shard_id").alias("_own"))
    base = held.where("shard_id = 'rank-0'").select("checkpoint_id", F.col("shard_id").alias("_base"))
    wanted = workers.withColumn("_own", F.concat(F.lit("rank-"), "rank"))
    return (
        wanted.join(own.withColumn("_has", F.lit(True)), ["checkpoint_id", "_own"], "left")
        .join(base, "checkpoint_id", "left")
        .select(
            "run_id",
            "worker_id",
            "checkpoint_id",
            "rank",
            F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_base")).alias("shard_id"),
            F.when(F.col("_has"), "own").when(F.col("_base").isNotNull(), "fallback").otherwise("error").alias("how"),
        )
    )


def new_commits(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Committed checkpoints that the previous listing did not have."""
    fresh = current.join(previous.select("checkpoint_id"), "checkpoint_id", "left_anti")
    return fresh.where("state = 'COMMITTED'")


def plan_orphan_gc(objects: DataFrame) -> DataFrame:
    """Objects of every (run, checkpoint) folder that holds no manifest of its own."""
    named = objects.where(is_manifest(F.col("key")))
    manifests = object_parts(named).where("n_parts = 3").select("run_id", "checkpoint_id").distinct()
    inside = object_parts(objects).where(F.col("n_parts") >= 3)
    return inside.join(manifests, ["run_id", "checkpoint_id"], "left_anti").select(
        "run_id", "checkpoint_id", "key", "size"
    )


def orphans_per_run(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("run_id").agg(F.count("*").alias("n_orphans"), F.sum("size").alias("bytes"))


def plan_abort(objects: DataFrame, aborted: DataFrame) -> DataFrame:
    """Objects below an aborted checkpoint's folder, its manifest excepted."""
    folders = aborted.select(F.col("run_id").cast("string").alias("_run"), F.col("checkpoint_id").cast("string").alias("_checkpoint"))
    # folders meet on parts of the key, so that only key and size are shuffled
    parts = F.split("key", "/")
    inside = objects.where((F.size(parts) >= 3) & ~is_manifest(F.col("key"))).select("key", "size")
    below = inside.join(folders, (F.get(parts, F.lit(0)) == F.col("_run")) & (F.get(parts, F.lit(1)) == F.col("_checkpoint")), "left_semi")
    return object_parts(below).select("run_id", "checkpoint_id", "key", "size")


def plan_retention(
    versions: DataFrame, now: Column, keep_days: int = 30, noncurrent_days: int = 7, slice_us: int = 30 * DAY
) -> DataFrame:
    """Versions to expire: current ones after ``keep_days``, others ``noncurrent_days`` after being superseded.

    Most objects have a version or two, so that only a key with very many is cut into slices.
    """
    aged = scan_short(
        versions.select("key", "size", "modified"), ["key"], ["modified", "size"], by_time("modified", slice_us),
        next={"superseded_at": "modified"},
    )
    current = F.col("superseded_at").isNull()
    age_us = micros(now) - F.when(current, micros("modified")).otherwise(micros("superseded_at"))
    limit_us = F.when(current, F.lit(keep_days * DAY)).otherwise(F.lit(noncurrent_days * DAY))
    return aged.where(age_us >= limit_us).select(
        "key", "size", "modified", "superseded_at", F.when(current, "age").otherwise("superseded").alias("reason")
    )


def storage_tree(objects: DataFrame) -> DataFrame:
    """Files and bytes per checkpoint, per run and in all (level 0, 1, 3)."""
    return (
        object_parts(objects)
        .rollup("run_id", "checkpoint_id")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping_id().cast("int").alias("level"))
    )


def gc_by_reason(orphans: DataFrame, aborted: DataFrame) -> DataFrame:
    both = orphans.select("size", F.lit("orphan").alias("reason")).unionByName(
        aborted.select("size", F.lit("abort").alias("reason"))
    )
    return both.groupBy("reason").agg(F.count("*").alias("n_deleted"), F.sum("size").alias("bytes"))


def gc_summary(objects: DataFrame, aborted: DataFrame) -> DataFrame:
    """What ``gc_by_reason`` says of the orphans and of the aborted checkpoints of one listing, which is read once.

    Each folder is one row after the first aggregation: whether it holds a manifest, and its files and bytes with and without it.
    """
    parts = object_parts(objects).where("n_parts >= 3")
    plain = F.col("kind") != "manifest"
    folders = parts.groupBy("run_id", "checkpoint_id").agg(
        F.max((F.col("n_parts") == 3) & ~plain).alias("held"), F.count("*").alias("n"), F.sum("size").alias("size"),
        F.count_if(plain).alias("n_plain"), F.sum(F.when(plain, F.col("size"))).alias("plain"),
    )
    ended = aborted.select(F.col("run_id").cast("string"), F.col("checkpoint_id").cast("string"), F.lit(True).alias("aborted")).distinct()
    marked = folders.join(ended, ["run_id", "checkpoint_id"], "left")
    reasons = F.array(
        F.when(~F.col("held"), F.struct(F.lit("orphan").alias("reason"), F.col("n").alias("n"), F.col("size").alias("bytes"))),
        F.when(
            F.col("aborted") & (F.col("n_plain") > 0), F.struct(F.lit("abort").alias("reason"), F.col("n_plain").alias("n"), F.col("plain").alias("bytes"))
        ),
    )
    found = marked.select(F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r"))
    return found.groupBy("r.reason").agg(F.sum("r.n").alias("n_deleted"), F.sum("r.bytes").alias("bytes"))


def run_overview(runs: DataFrame, checkpoints: DataFrame, objects: DataFrame) -> DataFrame:
    """Per run: state, recovery point, and the objects that no manifest accounts for."""
    point = recovery_point(runs, checkpoints).select(
        "run_id", F.col("checkpoint_id").alias("resume_checkpoint_id"), F.col("step").alias("resume_step")
    )
    # a folder may carry any name, so ids meet as text
    orphans = orphans_per_run(plan_orphan_gc(objects)).withColumnRenamed("run_id", "_folder")
    return (
        runs.select("run_id", "name", "state", "current_step")
        .join(point, "run_id", "left")
        .join(orphans, F.col("run_id").cast("string") == F.col("_folder"), "left")
        .select(
            "run_id",
            "name",
            "state",
            "current_step",
            "resume_checkpoint_id",
            "resume_step",
            F.coalesce("n_orphans", F.lit(0)).alias("orphan_objects"),
            F.coalesce("bytes", F.lit(0)).alias("orphan_bytes"),
        )
    )
