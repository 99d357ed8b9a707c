"""Alert queries; hold times and windows are stretched to the sample's hourly grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import alerts as A
from runledger.operators import metrics as M
from runledger.plans import views as V
from runledger.plans.metric_queries import _INTERVALS, HOUR, HOUR_US, RANGE_S, STEP_S, _intervals, buckets_sql, quantile_sql, ticks
from runledger.plans.registry import query
from runledger.schemas import COMMIT_BOUNDS, SHARD_BOUNDS

SCALE = 60
RATIO_RULE = ("ErrorShare", "error_ratio", 0.25, 2 * HOUR, "warning", "Error share above a quarter")

_BAD_LEVEL = "SELECT op_id, ts, method, duration_s, CASE WHEN level = 3 THEN 'error' ELSE 'success' END AS status FROM op_log"
_RATIO = f"""
    SELECT 'ErrorShare' AS rule, 'method=' || method AS labels, tick, count(*) FILTER (status = 'error') / count(*) AS value,
           {2 * HOUR} AS hold_s, 0.25 AS bound, 'warning' AS severity, 'Error share above a quarter' AS summary
    FROM ({ticks(_BAD_LEVEL)}) GROUP BY method, tick"""


def held_sql(evaluated: str) -> str:
    """hold_for over (rule, labels, tick, value, hold_s, bound, ..)."""
    return f"""
    SELECT * EXCLUDE (since), CASE WHEN cond THEN since END AS active_since, CASE WHEN NOT cond THEN 'inactive'
           WHEN epoch_us(tick) - epoch_us(since) >= hold_s * 1000000::BIGINT THEN 'firing' ELSE 'pending' END AS state
    FROM (SELECT * EXCLUDE (start, island), max(start) OVER (PARTITION BY rule, labels, island) AS since
      FROM (SELECT * EXCLUDE (was, was_at), CASE WHEN begins THEN tick END AS start,
               sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY rule, labels ORDER BY tick) AS island
        FROM (SELECT *, cond AND (NOT coalesce(was, false) OR epoch_us(tick) - epoch_us(was_at) > {HOUR_US}) AS begins
          FROM (SELECT *, lag(cond) OVER w AS was, lag(tick) OVER w AS was_at
            FROM (SELECT *, coalesce(value > bound, false) AS cond FROM ({evaluated})) WINDOW w AS (PARTITION BY rule, labels ORDER BY tick)))))"""


def intervals_sql(held: str) -> str:
    return f"""
    SELECT rule, labels, active_since, min(tick) AS fired_at, max(tick) AS last_tick, max(value) AS peak, min(severity) AS severity,
           min(summary) || CASE WHEN labels <> '' THEN ' {{' || labels || '}}' ELSE '' END || ': '
           || CAST(round(CAST(max(value) AS DECIMAL(20, 8)), 4) AS VARCHAR) AS message
    FROM ({held}) WHERE state = 'firing' GROUP BY rule, labels, active_since"""


def _ops(spark, d):
    return V.op_log(spark, d).withColumn("status", F.when(F.col("level") == 3, "error").otherwise("success"))


def conditions(spark, d):
    ratio = M.error_ratio(_ops(spark, d), ["method"], RANGE_S, STEP_S)
    series = A.labelled(ratio, "error_ratio", "method")
    return A.evaluate_rules(series, [RATIO_RULE])


@query(
    "A01_evaluate_rule",
    f"SELECT rule, labels, tick, value, coalesce(value > bound, false) AS cond FROM ({_RATIO})",
)
def evaluate_rule(spark, d):
    return conditions(spark, d).select("rule", "labels", "tick", "value", "cond")


@query("A02_hold_for", f"SELECT rule, labels, tick, cond, active_since, state FROM ({held_sql(_RATIO)})")
def hold_for(spark, d):
    return A.hold_for(conditions(spark, d), STEP_S).select("rule", "labels", "tick", "cond", "active_since", "state")


@query("A03_alert_intervals", intervals_sql(held_sql(_RATIO)))
def alert_intervals(spark, d):
    return A.alert_intervals(A.hold_for(conditions(spark, d), STEP_S))


# -- all 14 rules --------------------------------------------------------------------------------

_ROLES = {"click": "write", "view": "read", "purchase": "commit", "signup": "abort", "error": "list"}


def _role_ops(spark, d):
    role = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    return _ops(spark, d).withColumn("method", F.element_at(role, F.col("method")))


def _tick_up(ts):
    return F.timestamp_micros(M.tick_up(ts, HOUR_US))


def _depths(spark, d):
    """Largest number of running operations per hour that saw a change."""
    levels = M.concurrency_levels(_intervals(spark, d))
    return levels.groupBy(_tick_up("ts").alias("tick")).agg(F.max("peak").alias("value"))


def _lags(spark, d):
    """Hours since the last heartbeat at each hour, up to two days."""
    beats = V.heartbeats(spark, d).select("worker_id", "ts", F.col("step").alias("seq"), F.col("step").alias("value"))
    grid = M.resample(beats, ["worker_id"], STEP_S, 48 * HOUR)
    return grid.select("worker_id", "tick", (M.seconds_between(F.col("sampled_at"), F.col("tick")) / HOUR).alias("value"))


def _deletions(spark, d):
    return _ops(spark, d).where("method = 'error'").select(
        "ts", F.when(F.col("level") > 1, "orphan").otherwise("abort").alias("reason")
    )


def all_series(spark, d):
    return A.rule_series(_role_ops(spark, d), _depths(spark, d), _lags(spark, d), _deletions(spark, d), RANGE_S, STEP_S)


_ROLE_SQL = f"""SELECT op_id, ts, duration_s, status, CASE method {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items())} END AS method FROM ({_BAD_LEVEL})"""


def _role(method):
    return f"SELECT * FROM ({_ROLE_SQL}) WHERE method = '{method}'"


def _p99(name, bounds, method):
    q = quantile_sql(buckets_sql(bounds, ticks(_role(method)), "tick"), 0.99, "tick")
    return f"SELECT '{name}' AS series, '' AS labels, tick, value FROM ({q})"


def _share(name, source):
    return f"SELECT '{name}', '', tick, count(*) FILTER (status = 'error') / count(*) FROM ({ticks(source)}) GROUP BY tick"


def _speed(name, source, labels="''", group=""):
    return f"SELECT '{name}', {labels}, tick, count(*) / {RANGE_S}.0::DOUBLE FROM ({ticks(source)}) GROUP BY tick{group}"


_DEPTH_SQL = f"""
    SELECT ts, CAST(sum(delta) OVER (ORDER BY ts, delta, op_id) AS BIGINT) AS depth FROM (
      SELECT op_id, started_at AS ts, CAST(1 AS BIGINT) AS delta FROM ({_INTERVALS}) UNION ALL
      SELECT op_id, ended_at, -1 FROM ({_INTERVALS}))"""
_LAG_SQL = f"""
    SELECT worker_id, tick, (epoch_us(tick) - epoch_us(max(ts))) / 1000000.0::DOUBLE / {HOUR} AS value FROM (
      SELECT worker_id, ts, make_timestamp(unnest(range(pane, pane + {48 * HOUR_US}, {HOUR_US}))) AS tick
      FROM (SELECT worker_id, ts, ((epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US}) * {HOUR_US} AS pane FROM heartbeats))
    WHERE epoch_us(tick) - epoch_us(ts) < {48 * HOUR_US} GROUP BY worker_id, tick"""
_SERIES = " UNION ALL ".join(
    [
        _p99("shard_write_p99", SHARD_BOUNDS, "write"),
        _p99("shard_read_p99", SHARD_BOUNDS, "read"),
        _p99("commit_p99", COMMIT_BOUNDS, "commit"),
        _share("commit_error_ratio", _role("commit")),
        _share("shard_write_error_ratio", _role("write")),
        _share("shard_read_error_ratio", _role("read")),
        _speed("abort_rate", _role("abort")),
        f"""SELECT 'queue_utilisation', '', make_timestamp(((epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US}) * {HOUR_US}) AS tick,
            max(depth) / 32.0::DOUBLE FROM ({_DEPTH_SQL}) GROUP BY 3""",
        f"SELECT 'heartbeat_lag', 'worker_id=' || worker_id, tick, value FROM ({_LAG_SQL})",
        _share("grpc_error_ratio", f"SELECT * FROM ({_ROLE_SQL})"),
        _speed("grpc_error_rate", f"SELECT * FROM ({_ROLE_SQL}) WHERE status = 'error'", "'method=' || method || ',status=' || status", ", method, status"),
        _speed(
            "gc_delete_rate",
            "SELECT ts, CASE WHEN level > 1 THEN 'orphan' ELSE 'abort' END AS reason FROM op_log WHERE method = 'error'",
            "'reason=' || reason", ", reason",
        ),
    ]
)
_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{s}', {b}::DOUBLE, {h * SCALE}, '{v}', '{m}')" for r, s, b, h, v, m in A.RULES
) + ") r(rule, series, bound, hold_s, severity, summary)"
_ALL = f"SELECT rule, labels, tick, value, hold_s, bound, severity, summary FROM ({_SERIES}) JOIN ({_RULES_SQL}) USING (series)"


@query(
    "A04_default_rules",
    f"""SELECT rule, labels, active_since, fired_at, last_tick, round(peak, 6) AS peak, severity
        FROM ({intervals_sql(held_sql(_ALL))})""",
)
def default_rules(spark, d):
    conditions = A.evaluate_rules(all_series(spark, d), A.default_rules(SCALE))
    return A.firing_intervals(conditions, STEP_S).withColumn("peak", F.round("peak", 6)).drop("message")


@query(
    "A04_rule_series",
    f"SELECT series, labels, count(*) AS n_ticks, round(max(value), 6) AS highest, round(avg(value), 6) AS mean FROM ({_SERIES}) GROUP BY series, labels",
)
def rule_series(spark, d):
    return all_series(spark, d).groupBy("series", "labels").agg(
        F.count("*").alias("n_ticks"), F.round(F.max("value"), 6).alias("highest"), F.round(F.avg("value"), 6).alias("mean")
    )
