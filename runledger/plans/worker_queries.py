"""Worker and liveness queries. Sample heartbeats are hours apart, so thresholds are scaled up."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.plans.registry import filled, query

TIMEOUT_S, DEAD_S, ALIVE_S = 12 * 3600, 24 * 3600, 72 * 3600
NOW = "2024-01-31 00:00:00"

_GAPS = """
    SELECT *, lead(ts) OVER (PARTITION BY run_id, worker_id ORDER BY ts, step) AS back FROM heartbeats"""
_LAST = f"""
    SELECT run_id, worker_id, max(ts) AS last_heartbeat,
           epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) AS us, arg_max(step, (ts, step)) AS step
    FROM heartbeats GROUP BY ALL"""
_DEATH_ROWS = f"""
    SELECT worker_id, run_id, ts AS last_seen, ts + INTERVAL 24 HOUR AS declared_at FROM ({_GAPS})
    WHERE (back IS NULL OR epoch_us(back) - epoch_us(ts) > 86400000000) AND ts + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}'"""
_STATE = f"""
    SELECT r.worker_id, r.run_id, b.last_heartbeat, b.current_step,
           CASE WHEN died IS NULL THEN 'ACTIVE' ELSE 'DEAD' END AS status,
           died IS NULL OR coalesce(b.last_heartbeat > died, false) AS lease_alive
    FROM registrations r
    LEFT JOIN (SELECT run_id, worker_id, max(ts) AS last_heartbeat, arg_max(step, (ts, step)) AS current_step FROM heartbeats GROUP BY 1, 2) b USING (run_id, worker_id)
    LEFT JOIN (SELECT run_id, worker_id, max(declared_at) AS died FROM ({_DEATH_ROWS}) GROUP BY 1, 2) x USING (run_id, worker_id)"""


def now():
    return F.lit(NOW).cast("timestamp")


def current_workers(spark, d):
    beats = V.heartbeats(spark, d)
    return W.worker_state(V.registrations(spark, d), beats, W.deaths_until(beats, DEAD_S, now()))


@query(
    "W01_assign_ranks",
    """SELECT run_id, worker_id, registered_at,
              row_number() OVER (PARTITION BY run_id ORDER BY registered_at, worker_id) - 1 AS rank FROM registrations""",
)
def assign_ranks(spark, d):
    return W.assign_ranks(V.registrations(spark, d))


@query(
    "W02_heartbeat_lag",
    f"""SELECT run_id, worker_id, last_heartbeat, ((us + 5000) // 10000) / 100.0::DOUBLE AS lag_s
        FROM ({_LAST}) WHERE us <= {ALIVE_S * 1000000}""",
)
def heartbeat_lag(spark, d):
    return W.heartbeat_lag(V.heartbeats(spark, d), now(), ALIVE_S)


@query(
    "W03_classify_liveness",
    f"""SELECT run_id, worker_id, last_heartbeat, ((us + 5000) // 10000) / 100.0::DOUBLE AS lag_s,
               CASE WHEN (us + 5000) // 10000 > {DEAD_S * 100} THEN 'DEAD' WHEN (us + 5000) // 10000 > {TIMEOUT_S * 100}
                    THEN 'UNRESPONSIVE' ELSE 'ALIVE' END AS liveness FROM ({_LAST})""",
)
def classify_liveness(spark, d):
    return W.classify_liveness(W.heartbeat_lag(V.heartbeats(spark, d), now()), TIMEOUT_S, DEAD_S)


@query(
    "W05_heartbeat_outages",
    f"""SELECT worker_id, run_id, ts AS last_seen, ts + INTERVAL 24 HOUR AS declared_at, back AS back_at,
               (epoch_us(back) - epoch_us(ts)) / 1000000.0::DOUBLE AS outage_s
        FROM ({_GAPS}) WHERE epoch_us(back) - epoch_us(ts) > 86400000000""",
)
def heartbeat_outages(spark, d):
    return W.heartbeat_outages(V.heartbeats(spark, d), DEAD_S)


@query("W05_deaths_until", _DEATH_ROWS)
def deaths_until(spark, d):
    return W.deaths_until(V.heartbeats(spark, d), DEAD_S, now())


_MEMBERS = """SELECT c_custkey AS w, CASE WHEN c_custkey % 7 = 0 THEN (c_custkey + 1) % 50 ELSE c_custkey % 50 END AS r
              FROM customer WHERE c_acctbal >= 3000"""


def _members(spark, d):
    """Customers in credit stand for the registered workers; every seventh is registered for the run after its own."""
    key = F.col("c_custkey")
    run = F.when(key % 7 == 0, (key + 1) % 50).otherwise(key % 50)
    return V.table(spark, d, "customer").where("c_acctbal >= 3000").select(run.alias("run_id"), key.alias("worker_id"))


@query(
    "W06_known_heartbeats",
    f"""SELECT worker_id, run_id, ts, step FROM heartbeats WHERE EXISTS (SELECT 1 FROM ({_MEMBERS}) m WHERE m.w = worker_id AND m.r = run_id)""",
)
def known_heartbeats(spark, d):
    return W.drop_unknown_heartbeats(V.heartbeats(spark, d), _members(spark, d))[0]


@query(
    "W06_ignored_heartbeats",
    f"""SELECT run_id, worker_id, count(*) AS n_ignored, max(ts) AS last_ts FROM heartbeats
        WHERE NOT EXISTS (SELECT 1 FROM ({_MEMBERS}) m WHERE m.w = worker_id AND m.r = run_id) GROUP BY run_id, worker_id""",
)
def ignored_heartbeats(spark, d):
    return W.drop_unknown_heartbeats(V.heartbeats(spark, d), _members(spark, d))[1]


@query("W07_worker_state", _STATE)
def worker_state(spark, d):
    return current_workers(spark, d)


@query(
    "W08_active_workers",
    f"""SELECT coalesce(run_id, -1) AS run_id, count(*) FILTER (status = 'ACTIVE') AS active, count(*) AS total
        FROM ({_STATE}) GROUP BY ROLLUP (run_id)""",
)
def active_workers(spark, d):
    return filled(W.active_workers(current_workers(spark, d)), "run_id")


@query(
    "W09_top_workers",
    f"""SELECT run_id, worker_id, status, last_heartbeat, CAST(place AS INTEGER) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY status <> 'ACTIVE', last_heartbeat DESC, worker_id) AS place
          FROM ({_STATE})) WHERE place <= 2""",
)
def top_workers(spark, d):
    return W.top_workers(current_workers(spark, d)).select("run_id", "worker_id", "status", "last_heartbeat", "place")


@query(
    "W10_failed_runs",
    f"SELECT DISTINCT run_id FROM ({_DEATH_ROWS})",
)
def failed_runs(spark, d):
    return W.failed_runs(W.deaths_until(V.heartbeats(spark, d), DEAD_S, now()))


@query(
    "W11_worker_lag_join",
    f"""SELECT s.worker_id, s.run_id, s.status, coalesce(l.lag_s, 0.0::DOUBLE) AS lag_s FROM ({_STATE}) s LEFT JOIN
        (SELECT run_id, worker_id, ((us + 5000) // 10000) / 100.0::DOUBLE AS lag_s FROM ({_LAST}) WHERE us <= {ALIVE_S * 1000000}) l
        USING (run_id, worker_id)""",
)
def worker_lag_join(spark, d):
    lags = W.heartbeat_lag(V.heartbeats(spark, d), now(), ALIVE_S)
    return W.worker_lag_join(current_workers(spark, d), lags).select("worker_id", "run_id", "status", "lag_s")
