"""Checkpoint and stored-object queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import checkpoints as C
from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.plans.registry import filled, query

_BEST = """
    SELECT run_id, arg_max(checkpoint_id, (step, created_at, checkpoint_id)) AS checkpoint_id, max(step) AS step,
           arg_max(committed_at, (step, created_at, checkpoint_id)) AS committed_at
    FROM checkpoints WHERE state = 'COMMITTED' GROUP BY run_id"""
_PARTS = """
    SELECT *, split_part(key, '/', 1) AS run_id, split_part(key, '/', 2) AS checkpoint_id FROM objects"""
_ORPHANS = f"""
    SELECT run_id, checkpoint_id, key, size FROM ({_PARTS}) o WHERE NOT EXISTS (
      SELECT 1 FROM checkpoints c WHERE c.state = 'COMMITTED'
      AND c.run_id = CAST(o.run_id AS BIGINT) AND c.checkpoint_id = CAST(o.checkpoint_id AS BIGINT))"""
_ABORTED = f"""
    SELECT run_id, checkpoint_id, key, size FROM ({_PARTS}) o WHERE key NOT LIKE '%/_manifest.json' AND
    CAST(checkpoint_id AS BIGINT) IN (SELECT checkpoint_id FROM checkpoints WHERE state = 'PENDING')"""


@query(
    "flagship_run_overview",
    f"""SELECT r.run_id, r.name, r.state, r.current_step, coalesce(b.checkpoint_id, -1) AS resume_checkpoint_id, coalesce(b.step, -1) AS resume_step,
               coalesce(n, 0) AS orphan_objects, coalesce(bytes, 0) AS orphan_bytes
        FROM runs r LEFT JOIN ({_BEST}) b USING (run_id)
        LEFT JOIN (SELECT CAST(run_id AS BIGINT) AS run_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
                   FROM ({_ORPHANS}) GROUP BY 1) o USING (run_id)""",
)
def run_overview(spark, d):
    overview = C.run_overview(V.runs(spark, d), V.checkpoints(spark, d), V.objects(spark, d))
    return filled(overview, "resume_checkpoint_id", "resume_step")


@query(
    "C01_checkpoints_of",
    """SELECT run_id, checkpoint_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step, created_at, checkpoint_id) AS position
       FROM checkpoints""",
)
def checkpoint_positions(spark, d):
    return C.checkpoint_positions(V.checkpoints(spark, d), 365).select("run_id", "checkpoint_id", "step", "position")


@query("C02_recovery_point", 
    f"""SELECT run_id, coalesce(checkpoint_id, -1) AS checkpoint_id, coalesce(step, -1) AS step, committed_at
        FROM runs LEFT JOIN ({_BEST}) USING (run_id)""",
)
def recovery_point(spark, d):
    return filled(C.recovery_point(V.runs(spark, d), V.checkpoints(spark, d)), "checkpoint_id", "step")


@query(
    "C03_recovery_point_asof",
    """SELECT f.failure_id, f.run_id, f.failed_at, coalesce(arg_max(c.checkpoint_id, (c.committed_at, c.checkpoint_id)), -1) AS checkpoint_id,
              coalesce(arg_max(c.step, (c.committed_at, c.checkpoint_id)), -1) AS step, max(c.committed_at) AS committed_at
       FROM failures f LEFT JOIN checkpoints c ON c.run_id = f.run_id AND c.state = 'COMMITTED' AND c.committed_at <= f.failed_at
       GROUP BY ALL""",
)
def recovery_point_asof(spark, d):
    found = C.recovery_point_asof(V.failures(spark, d), V.checkpoints(spark, d))
    return filled(found, "checkpoint_id", "step")


def _last_steps(spark, d):
    return W.last_heartbeats(V.heartbeats(spark, d)).select(
        F.col("worker_id").alias("run_id"), "worker_id", F.col("last_step").alias("current_step")
    )


@query(
    "C04_lost_steps",
    f"""SELECT w.worker_id AS run_id, w.worker_id, w.current_step, coalesce(b.step, 0) AS resume_step,
               greatest(w.current_step - coalesce(b.step, 0), 0) AS lost_steps
        FROM (SELECT worker_id, arg_max(step, (ts, step)) AS current_step FROM heartbeats GROUP BY 1) w
        LEFT JOIN ({_BEST}) b ON b.run_id = w.worker_id""",
)
def lost_steps(spark, d):
    return C.lost_steps(_last_steps(spark, d), C.recovery_point(V.runs(spark, d), V.checkpoints(spark, d)))


@query(
    "C05_active_checkpoint",
    """SELECT run_id, arg_max(checkpoint_id, (step, created_at, checkpoint_id)) AS checkpoint_id, max(step) AS step,
              arg_max(created_at, (step, created_at, checkpoint_id)) AS created_at
       FROM checkpoints WHERE state = 'IN_PROGRESS' GROUP BY run_id""",
)
def active_checkpoint(spark, d):
    return C.active_checkpoint(V.checkpoints(spark, d))


@query(
    "C06_abort_pending",
    """SELECT checkpoint_id, run_id, CASE WHEN state IN ('PENDING', 'IN_PROGRESS') AND run_id IN (SELECT run_id FROM failures)
              THEN 'FAILED' ELSE state END AS state FROM checkpoints""",
)
def abort_pending(spark, d):
    return C.abort_pending(V.checkpoints(spark, d), V.failures(spark, d)).select("checkpoint_id", "run_id", "state")


def _rank_names(n):
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("rank-"), i))


def _updates(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("checkpoint_id"),
        F.col("l_shipdate").alias("ts"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "F", "COMMITTED").when(F.col("l_returnflag") == "R", "FAILED").alias("state"),
        F.when(F.col("l_returnflag") != "A", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("total_bytes"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).cast("long").alias("num_shards"),
        F.when(F.col("l_returnflag") == "R", _rank_names(F.col("l_linenumber"))).alias("shard_ids"),
    )


@query(
    "C07_apply_checkpoint_updates",
    """WITH u AS (SELECT l_orderkey AS checkpoint_id, l_shipdate AS ts, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS o,
                 CASE WHEN l_linestatus = 'F' THEN 'COMMITTED' WHEN l_returnflag = 'R' THEN 'FAILED' END AS state,
                 CASE WHEN l_returnflag <> 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS total_bytes,
                 CASE WHEN l_linenumber > 2 THEN l_linenumber END AS num_shards,
                 CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS listed FROM lineitem),
            f AS (SELECT checkpoint_id, arg_max(state, o) FILTER (state IS NOT NULL) AS s,
                 arg_max(total_bytes, o) FILTER (total_bytes IS NOT NULL) AS b, min(ts) FILTER (state = 'COMMITTED') AS t,
                 arg_max(num_shards, o) FILTER (num_shards IS NOT NULL) AS k, arg_max(listed, o) FILTER (listed IS NOT NULL) AS l
                 FROM u GROUP BY 1)
       SELECT checkpoint_id, run_id, step, created_at, coalesce(s, state) AS state, coalesce(b, total_bytes) AS total_bytes,
              CAST(coalesce(k, 0) AS BIGINT) AS num_shards,
              array_to_string(list_transform(range(1, coalesce(l, 0) + 1), lambda i: 'rank-' || i), ',') AS shard_ids,
              coalesce(committed_at, t) AS committed_at FROM checkpoints LEFT JOIN f USING (checkpoint_id)""",
)
def apply_checkpoint_updates(spark, d):
    order = ["ts", "l_linenumber", "l_partkey", "l_suppkey"]
    updated = C.apply_checkpoint_updates(V.checkpoints(spark, d), _updates(spark, d), order)
    return updated.withColumn("shard_ids", F.array_join("shard_ids", ","))


@query(
    "C08_last_checkpoint_per_run",
    "SELECT run_id, arg_max(checkpoint_id, (created_at, checkpoint_id)) AS last_checkpoint_id FROM checkpoints GROUP BY run_id",
)
def last_checkpoint_per_run(spark, d):
    return C.last_checkpoint_per_run(V.checkpoints(spark, d))


@query(
    "C09_checkpoint_cadence",
    """SELECT run_id, checkpoint_id, step, coalesce(delta, -1) AS step_delta, coalesce(delta > checkpoint_interval_steps, false) AS late
       FROM (SELECT *, step - lag(step) OVER (PARTITION BY run_id ORDER BY step, checkpoint_id) AS delta FROM checkpoints)
       JOIN (SELECT run_id, checkpoint_interval_steps FROM runs) USING (run_id)""",
)
def checkpoint_cadence(spark, d):
    return filled(C.checkpoint_cadence(V.checkpoints(spark, d), V.runs(spark, d), 365), "step_delta")


@query(
    "C10_missing_checkpoints",
    """SELECT run_id, step FROM (SELECT run_id, unnest(range(30, current_step + 1, 30)) AS step FROM runs)
       EXCEPT SELECT run_id, step FROM checkpoints WHERE state = 'COMMITTED'""",
)
def missing_checkpoints(spark, d):
    return C.missing_checkpoints(V.checkpoints(spark, d), V.runs(spark, d), F.lit(30))


@query(
    "C11_checkpoint_durations",
    """WITH s AS (SELECT row_number() OVER (ORDER BY ts, op_id) - 1 AS i, duration_s FROM
                  (SELECT * FROM op_log WHERE method = 'purchase' ORDER BY ts DESC, op_id DESC LIMIT 30)),
            r AS (SELECT row_number() OVER (ORDER BY ts, op_id) - 1 AS i, duration_s FROM
                  (SELECT * FROM op_log WHERE method = 'view' ORDER BY ts DESC, op_id DESC LIMIT 30))
       SELECT CAST(i AS INTEGER) AS index, round(s.duration_s, 3) AS save, coalesce(round(r.duration_s, 3), 0.0::DOUBLE) AS restore
       FROM s LEFT JOIN r USING (i)""",
)
def checkpoint_durations(spark, d):
    ops = V.op_log(spark, d)
    return C.checkpoint_durations(ops.where("method = 'purchase'"), ops.where("method = 'view'"))


def _with_shards(spark, d):
    ids = V.shards(spark, d).groupBy("checkpoint_id").agg(F.sort_array(F.collect_set("shard_id")).alias("shard_ids"))
    return (
        V.checkpoints(spark, d)
        .join(ids, "checkpoint_id", "left")
        .withColumn("num_shards", F.coalesce(F.size("shard_ids"), F.lit(0)).cast("long"))
    )


@query(
    "C12_checkpoint_totals",
    """SELECT count(*) AS n, count(*) FILTER (state = 'COMMITTED') AS committed, CAST(sum(k) AS BIGINT) AS shards,
              CAST(sum(total_bytes) AS BIGINT) AS bytes, sum(total_bytes) / greatest(sum(k), 1)::DOUBLE AS mean_shard_bytes
       FROM (SELECT c.*, coalesce(k, 0) AS k FROM checkpoints c LEFT JOIN
             (SELECT checkpoint_id, count(DISTINCT shard_id) AS k FROM shards GROUP BY 1) USING (checkpoint_id))""",
)
def checkpoint_totals(spark, d):
    counts = V.shards(spark, d).select("checkpoint_id", "shard_id").distinct().groupBy("checkpoint_id").agg(
        F.count("*").alias("num_shards")
    )
    return C.checkpoint_totals(V.checkpoints(spark, d).join(counts, "checkpoint_id", "left").na.fill(0, ["num_shards"]))


@query(
    "C12_checkpoint_listing",
    """SELECT run_id, checkpoint_id, state, created_at, s.shard_id, CAST(coalesce(s.n, -1) AS INTEGER) AS ordinal FROM checkpoints LEFT JOIN
       (SELECT checkpoint_id, shard_id, row_number() OVER (PARTITION BY checkpoint_id ORDER BY shard_id) - 1 AS n
        FROM (SELECT DISTINCT checkpoint_id, shard_id FROM shards)) s USING (checkpoint_id)""",
)
def checkpoint_listing(spark, d):
    return filled(C.checkpoint_listing(_with_shards(spark, d)), "ordinal")


@query(
    "C14_resolve_shard",
    f"""WITH w AS (SELECT r.run_id, r.worker_id, CAST(row_number() OVER (PARTITION BY r.run_id ORDER BY registered_at, r.worker_id) - 1 AS BIGINT) AS rank,
                   b.checkpoint_id FROM registrations r JOIN ({_BEST}) b USING (run_id)),
             h AS (SELECT DISTINCT checkpoint_id, rank - 1 AS rank FROM shards)
        SELECT run_id, worker_id, w.checkpoint_id, w.rank,
               CASE WHEN o.rank IS NOT NULL THEN 'rank-' || w.rank WHEN z.rank IS NOT NULL THEN 'rank-0' END AS shard_id,
               CASE WHEN o.rank IS NOT NULL THEN 'own' WHEN z.rank IS NOT NULL THEN 'fallback' ELSE 'error' END AS how
        FROM w LEFT JOIN h o ON o.checkpoint_id = w.checkpoint_id AND o.rank = w.rank
        LEFT JOIN h z ON z.checkpoint_id = w.checkpoint_id AND z.rank = 0""",
)
def resolve_shard(spark, d):
    points = C.recovery_point(V.runs(spark, d), V.checkpoints(spark, d)).where("checkpoint_id is not null")
    workers = W.assign_ranks(V.registrations(spark, d)).join(points.select("run_id", "checkpoint_id"), "run_id")
    held = V.shards(spark, d).select("checkpoint_id", F.concat(F.lit("rank-"), F.col("rank") - 1).alias("shard_id"))
    return C.resolve_shard(workers, held)


@query(
    "C15_new_commits",
    """SELECT checkpoint_id, run_id, step, total_bytes FROM checkpoints
       WHERE state = 'COMMITTED' AND NOT created_at < TIMESTAMP '1998-01-01'""",
)
def new_commits(spark, d):
    now = V.checkpoints(spark, d)
    return C.new_commits(now.where("created_at < '1998-01-01'"), now).select("checkpoint_id", "run_id", "step", "total_bytes")


@query("C16_plan_orphan_gc", _ORPHANS)
def plan_orphan_gc(spark, d):
    return C.plan_orphan_gc(V.objects(spark, d))


@query(
    "C16_orphans_per_run",
    f"SELECT run_id, count(*) AS n_orphans, CAST(sum(size) AS BIGINT) AS bytes FROM ({_ORPHANS}) GROUP BY run_id",
)
def orphans_per_run(spark, d):
    return C.orphans_per_run(C.plan_orphan_gc(V.objects(spark, d)))


@query("C17_plan_abort", _ABORTED)
def plan_abort(spark, d):
    return C.plan_abort(V.objects(spark, d), V.checkpoints(spark, d).where("state = 'PENDING'"))


@query(
    "C18_plan_retention",
    """SELECT key, size, modified, next AS superseded_at, CASE WHEN next IS NULL THEN 'age' ELSE 'superseded' END AS reason
       FROM (SELECT *, lead(modified) OVER (PARTITION BY key ORDER BY modified, size) AS next FROM objects)
       WHERE TIMESTAMP '2001-06-01' >= CASE WHEN next IS NULL THEN modified + INTERVAL 30 DAY ELSE next + INTERVAL 7 DAY END""",
)
def plan_retention(spark, d):
    return C.plan_retention(V.objects(spark, d), F.lit("2001-06-01").cast("timestamp"))


@query(
    "C19_storage_tree",
    f"""SELECT run_id, checkpoint_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
               CAST(grouping_id(run_id, checkpoint_id) AS INTEGER) AS level
        FROM ({_PARTS}) GROUP BY ROLLUP (run_id, checkpoint_id)""",
)
def storage_tree(spark, d):
    return C.storage_tree(V.objects(spark, d))


@query(
    "C20_gc_by_reason",
    f"""SELECT reason, count(*) AS n_deleted, CAST(sum(size) AS BIGINT) AS bytes FROM (
          SELECT size, 'orphan' AS reason FROM ({_ORPHANS}) UNION ALL SELECT size, 'abort' FROM ({_ABORTED})) GROUP BY reason""",
)
def gc_by_reason(spark, d):
    return C.gc_summary(V.objects(spark, d), V.checkpoints(spark, d).where("state = 'PENDING'"))
