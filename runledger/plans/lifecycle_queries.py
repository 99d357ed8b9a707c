"""Run lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import lifecycle as L
from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.plans.registry import query
from runledger.plans.worker_queries import _DEATH_ROWS, DEAD_S, now

_CHANGED = """
    SELECT * FROM (SELECT *, lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq) AS before FROM replayed WHERE accepted)"""

@query(
    "L01_transition_table",
    """SELECT e.from_state, e.to_state, count(p.run_id) AS seen
       FROM edges e LEFT JOIN (SELECT run_id, to_state,
              coalesce(lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq), 'CREATED') AS from_state FROM state_events) p
       ON p.from_state = e.from_state AND p.to_state = e.to_state GROUP BY ALL""",
)
def transition_table(spark, d):
    pairs = L.check_transitions(V.state_events(spark, d)).groupBy("from_state", "to_state").agg(F.count("*").alias("seen"))
    edges = L.transition_table(spark)
    return edges.join(pairs, ["from_state", "to_state"], "left").select(
        "from_state", "to_state", F.coalesce("seen", F.lit(0)).alias("seen")
    )


@query(
    "L01_allowed_transitions",
    """SELECT r.run_id, r.state, CAST(r.run_id % 8 + 1 AS INTEGER) AS code,
              coalesce((SELECT string_agg(to_state, ',' ORDER BY to_state) FROM edges WHERE from_state = r.state), '') AS targets,
              r.state IN ('CANCELLED', 'COMPLETED') AS is_terminal FROM runs r""",
)
def allowed_transitions(spark, d):
    allowed = F.broadcast(L.allowed_transitions(spark))
    return V.runs(spark, d).join(allowed, "state").select(
        "run_id", "state", "code", F.concat_ws(",", "targets").alias("targets"), "is_terminal"
    )


@query(
    "L02_check_transitions",
    """SELECT p.run_id, p.seq, p.from_state, p.to_state, e.to_state IS NOT NULL AS valid
       FROM (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq), 'CREATED') AS from_state
             FROM state_events) p LEFT JOIN edges e ON e.from_state = p.from_state AND e.to_state = p.to_state""",
)
def check_transitions(spark, d):
    return L.check_transitions(V.state_events(spark, d)).select("run_id", "seq", "from_state", "to_state", "valid")


@query(
    "L03_replay_transitions",
    """SELECT run_id, arg_max(now_state, n) AS state, count(*) FILTER (accepted) AS n_accepted,
              count(*) FILTER (NOT accepted) AS n_rejected, arg_max(now_state, n) IN ('CANCELLED', 'COMPLETED') AS is_terminal
       FROM replayed GROUP BY run_id""",
)
def replay_summary(spark, d):
    return L.replay_summary(V.state_events(spark, d))


@query("L03_replay_history", "SELECT run_id, seq, from_state, to_state, accepted FROM replayed")
def replay_transitions(spark, d):
    return L.replay_transitions(V.state_events(spark, d)).drop("ts")


@query(
    "L04_state_changes",
    """SELECT run_id, seq, ts, before AS from_state, to_state,
              CASE WHEN to_state = 'FAILED' THEN 'error' WHEN to_state = 'RECOVERING' THEN 'warning'
                   WHEN to_state = 'RUNNING' AND before IN ('RECOVERING', 'COMMITTED') THEN 'success' ELSE 'info' END AS severity,
              (epoch_us(ts) - epoch_us(start)) / 1000000.0::DOUBLE AS elapsed_s
       FROM (SELECT *, lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq) AS before,
                    min(ts) OVER (PARTITION BY run_id) AS start FROM state_events)
       WHERE before <> to_state""",
)
def state_changes(spark, d):
    return L.state_changes(V.state_events(spark, d))


@query(
    "L05_state_durations",
    f"""SELECT to_state AS state, count(*) AS visits, round(CAST(sum(us) / 1000000.0 AS DOUBLE), 3) AS total_s,
               round(CAST(max(us) / 1000000.0 AS DOUBLE), 6) AS longest_s, round(avg(us) / 1000000.0, 3) AS mean_s
        FROM (SELECT to_state, epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq)) - epoch_us(ts) AS us
              FROM ({_CHANGED}) WHERE before IS NULL OR before <> to_state) GROUP BY 1""",
)
def state_durations(spark, d):
    out = L.state_durations(L.accepted_changes(V.state_events(spark, d)))
    return out.select(
        "state", "visits", F.round("total_s", 3).alias("total_s"), F.round("longest_s", 6).alias("longest_s"),
        F.round("mean_s", 3).alias("mean_s"),
    )


@query(
    "L05_state_visits",
    f"""SELECT run_id, to_state AS state, ts AS entered_at, lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS left_at
        FROM ({_CHANGED}) WHERE before IS NULL OR before <> to_state""",
)
def state_visits(spark, d):
    return L.state_visits(L.accepted_changes(V.state_events(spark, d))).drop("dwell_s")


@query(
    "L06_transition_matrix",
    "SELECT from_state, "
    + ", ".join(f"count(*) FILTER (to_state = '{s}') AS \"{s}\"" for s in L.STATES)
    + """, 0::BIGINT AS other FROM (SELECT to_state, coalesce(lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq), 'CREATED') AS from_state
          FROM replayed WHERE accepted) GROUP BY from_state""",
)
def transition_matrix(spark, d):
    return L.transition_matrix(L.accepted_changes(V.state_events(spark, d)))


@query("L07_runs_by_state", "SELECT state, count(*) AS n_runs FROM runs GROUP BY state")
def runs_by_state(spark, d):
    return L.runs_by_state(V.runs(spark, d))


@query(
    "L08_resumable_runs",
    """SELECT run_id, state, current_step FROM runs
       WHERE state IN ('RUNNING', 'COMMITTED', 'CHECKPOINTING', 'FAILED', 'RECOVERING')""",
)
def resumable_runs(spark, d):
    return L.resumable_runs(V.runs(spark, d)).select("run_id", "state", "current_step")


@query(
    "L08_first_active_run",
    "SELECT run_id, state FROM runs WHERE state IN ('RUNNING', 'CHECKPOINTING', 'COMMITTED') ORDER BY run_id LIMIT 1",
)
def first_active_run(spark, d):
    return L.first_active_run(V.runs(spark, d))


@query(
    "L09_apply_resume",
    """SELECT run_id, state, CASE WHEN state IN ('CANCELLED', 'COMPLETED', 'RECOVERING') THEN state ELSE 'RUNNING' END AS new_state,
              CASE state WHEN 'FAILED' THEN 'RECOVERING,RUNNING' WHEN 'COMMITTED' THEN 'RUNNING' WHEN 'CREATED' THEN 'RUNNING'
                   WHEN 'CHECKPOINTING' THEN 'RUNNING' ELSE '' END AS path,
              state IN ('CANCELLED', 'COMPLETED', 'RECOVERING') AS conflict FROM runs""",
)
def apply_resume(spark, d):
    return L.apply_resume(V.runs(spark, d)).withColumn("path", F.concat_ws(",", "path"))


def _metadata_changes(spark, d):
    return V.events(spark, d).select(
        F.col("user_id").alias("entity_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.create_map(F.col("event_type"), V.props_k().cast("string")).alias("metadata"),
    )


@query(
    "L10_merge_metadata",
    r"""SELECT user_id AS entity_id, event_type AS key, arg_max(regexp_extract(props, '(\d+)', 1), (ts, event_id)) AS value
        FROM events GROUP BY ALL""",
)
def merge_metadata(spark, d):
    return L.merge_metadata(_metadata_changes(spark, d), "merge")


@query(
    "L10_replace_metadata",
    r"""SELECT user_id AS entity_id, arg_max(event_type, (ts, event_id)) AS key,
               arg_max(regexp_extract(props, '(\d+)', 1), (ts, event_id)) AS value FROM events GROUP BY user_id""",
)
def replace_metadata(spark, d):
    return L.merge_metadata(_metadata_changes(spark, d), "replace")


@query(
    "L11_incident_timeline",
    f"""SELECT run_id, incident, failed_at, recovering_at, running_at,
               (epoch_us(recovering_at) - epoch_us(failed_at)) / 1000000.0::DOUBLE AS detection_s,
               (epoch_us(running_at) - epoch_us(failed_at)) / 1000000.0::DOUBLE AS recovery_s
        FROM (SELECT run_id, incident, min(ts) FILTER (to_state = 'FAILED') AS failed_at,
                     min(ts) FILTER (to_state = 'RECOVERING') AS recovering_at, min(ts) FILTER (to_state = 'RUNNING') AS running_at
              FROM (SELECT *, CAST(sum(CASE WHEN to_state = 'FAILED' AND before IS DISTINCT FROM 'FAILED' THEN 1 ELSE 0 END)
                                   OVER (PARTITION BY run_id ORDER BY ts, seq) AS BIGINT) AS incident FROM ({_CHANGED}))
              WHERE incident > 0 GROUP BY run_id, incident)""",
)
def incident_timeline(spark, d):
    return L.incident_timeline(L.accepted_changes(V.state_events(spark, d)))


def _deaths(spark, d):
    deaths = W.deaths_until(V.heartbeats(spark, d), DEAD_S, now())
    return deaths.select("worker_id", (F.col("run_id") * 31).alias("run_id"))


@query(
    "L12_plan_recovery",
    f"""WITH hit AS (SELECT run_id * 31 AS run_id, count(*) AS n_deaths FROM ({_DEATH_ROWS}) GROUP BY 1),
            open_cp AS (SELECT run_id, count(*) AS n FROM checkpoints WHERE state IN ('PENDING', 'IN_PROGRESS') GROUP BY 1),
            acts AS (SELECT hit.run_id, n_deaths, state, coalesce(n, 0) AS n,
                 CASE WHEN state IS NULL THEN 'unknown_run' WHEN state IN ('CANCELLED', 'COMPLETED') THEN 'skip_terminal'
                      WHEN state = 'FAILED' THEN 'recover' WHEN state = 'CREATED' THEN 'invalid_transition'
                      ELSE 'fail_and_recover' END AS action
               FROM hit LEFT JOIN runs USING (run_id) LEFT JOIN open_cp USING (run_id))
        SELECT run_id, n_deaths, state, action,
               CASE WHEN action IN ('recover', 'fail_and_recover') THEN 'RUNNING' ELSE state END AS target_state,
               CASE WHEN action IN ('recover', 'fail_and_recover') THEN n ELSE 0 END AS n_aborted FROM acts""",
)
def plan_recovery(spark, d):
    return L.plan_recovery(V.runs(spark, d), _deaths(spark, d), V.checkpoints(spark, d))


@query(
    "L13_reject_reason",
    """SELECT q.run_id * 11 AS run_id, q.seq, q.to_state, r.state AS current_state,
              CAST(CASE WHEN r.state IS NULL THEN 404 WHEN e.to_state IS NULL THEN 409 ELSE 200 END AS INTEGER) AS status
       FROM state_events q LEFT JOIN runs r ON r.run_id = q.run_id * 11
       LEFT JOIN edges e ON e.from_state = r.state AND e.to_state = q.to_state""",
)
def reject_reason(spark, d):
    asked = V.state_events(spark, d).select((F.col("run_id") * 11).alias("run_id"), "seq", "to_state")
    return L.reject_reason(asked, V.runs(spark, d))


@query(
    "L14_name_events",
    """SELECT run_id, ts, CASE WHEN from_state = 'CREATED' AND to_state = 'RUNNING' THEN 'run_started'
                WHEN to_state = 'RUNNING' THEN 'run_resumed' WHEN to_state = 'CANCELLED' THEN 'run_cancelled'
                WHEN to_state = 'COMPLETED' THEN 'run_completed' WHEN to_state = 'CHECKPOINTING' THEN 'checkpoint_started'
                WHEN to_state = 'COMMITTED' THEN 'checkpoint_committed' ELSE 'run_failed' END AS event_name
       FROM replayed WHERE accepted AND to_state <> 'RECOVERING'
       UNION ALL SELECT run_id, min(ts), 'run_created' FROM state_events GROUP BY run_id""",
)
def name_events(spark, d):
    return L.name_events(V.state_events(spark, d))
