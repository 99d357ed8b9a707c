"""Metric queries. Sample operations are minutes apart, so windows are hours wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import formats as X
from runledger.operators import metrics as M
from runledger.operators.lifecycle import accepted_changes
from runledger.plans import views as V
from runledger.plans.registry import query
from runledger.plans.worker_queries import _LAST, _STATE, current_workers, now
from runledger.operators import workers as W
from runledger.schemas import COMMIT_BOUNDS, SHARD_BOUNDS
from runledger.session import settle

HOUR, RANGE_S, STEP_S = 3600, 6 * 3600, 3600
HOUR_US, RANGE_US = HOUR * 1_000_000, RANGE_S * 1_000_000


def ticks(source: str) -> str:
    """Rows of ``source`` repeated for each window they are in (6 h range, 1 h step)."""
    return f"""SELECT *, make_timestamp(unnest(range(pane, pane + {RANGE_US}, {HOUR_US}))) AS tick
               FROM (SELECT *, ((epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US}) * {HOUR_US} AS pane FROM ({source}))"""


def buckets_sql(bounds, source: str, by: str = "", value: str = "duration_s") -> str:
    rows = ", ".join(f"{b}::DOUBLE" for b in bounds)
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}b.le, CASE WHEN b.le = 'inf' THEN "count" ELSE list_count(list_filter(vs, lambda v: v <= b.le)) END AS cum,
                      "count", "sum" FROM (SELECT {lead}list({value}) AS vs, count(*) AS "count", sum({value}) AS "sum" FROM ({source}) {group}),
               (SELECT unnest([{rows}, 'inf'::DOUBLE]) AS le) b"""


def quantile_sql(buckets: str, q: float, by: str = "") -> str:
    """histogram_quantile over (by, le, cum) rows."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}min(v) AS value FROM (
        SELECT {lead}CASE WHEN total = 0 THEN NULL WHEN le = 'inf' THEN low WHEN cum = seen THEN le
               ELSE low + (le - low) * (({q}::DOUBLE * total - seen) / (cum - seen)) END AS v
        FROM (SELECT {lead}le, cum, max(cum) OVER ({part}) AS total, coalesce(lag(le) OVER ({part} ORDER BY le), 0.0::DOUBLE) AS low,
                     coalesce(lag(cum) OVER ({part} ORDER BY le), 0) AS seen,
                     row_number() OVER ({part} ORDER BY le) AS i FROM ({buckets}))
        WHERE cum >= {q}::DOUBLE * total AND (i = 1 OR seen < {q}::DOUBLE * total)) {group}"""


_COUNTERS = """
    SELECT method, ts, op_id, count(*) OVER w AS total_ops, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes FROM op_log
    WINDOW w AS (PARTITION BY method ORDER BY ts, op_id)"""


@query(
    "M01_metrics_summary",
    f"""SELECT (SELECT count(*) FROM runs) AS total_runs, (SELECT count(*) FROM runs WHERE state IN ('RUNNING', 'CHECKPOINTING')) AS active_runs,
               count(*) AS total_checkpoints, count(*) FILTER (state = 'COMMITTED') AS committed,
               CAST(sum(total_bytes) AS BIGINT) AS total_checkpoint_bytes,
               round(avg((epoch_us(committed_at) - epoch_us(created_at)) / 1000.0::DOUBLE), 3) AS avg_checkpoint_duration_ms,
               (SELECT count(*) FROM registrations) AS total_workers, (SELECT count(*) FROM ({_STATE}) WHERE status = 'ACTIVE') AS active_workers,
               round(count(*) FILTER (state = 'COMMITTED') / count(*), 4) AS checkpoint_success_rate FROM checkpoints""",
)
def metrics_summary(spark, d):
    summary = M.metrics_summary(V.runs(spark, d), V.checkpoints(spark, d), current_workers(spark, d))
    return summary.withColumn("avg_checkpoint_duration_ms", F.round("avg_checkpoint_duration_ms", 3))


@query(
    "M02_health_summary",
    """SELECT 'HEALTHY' AS status, 2592000.25::DOUBLE AS uptime_seconds, count(*) FILTER (state IN ('RUNNING', 'CHECKPOINTING')) AS active_runs,
              true AS store_connected, true AS data_connected FROM runs""",
)
def health_summary(spark, d):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-31 00:00:00.25"))
    return M.health_summary(V.runs(spark, d), start, end)


@query("M03_counter_series", _COUNTERS)
def counter_series(spark, d):
    return M.counter_series(V.op_log(spark, d), ["method"])


_RESETS = f"SELECT method, ts, op_id AS seq, total_ops % 500 AS value FROM ({_COUNTERS})"
_WINDOWS = f"""
    SELECT method, tick, count(*) AS n, sum(delta) - arg_min(delta, (ts, seq)) AS increase, arg_min(value, (ts, seq)) AS v0,
           min(ts) AS t0, max(ts) AS t1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS span
    FROM ({ticks(f"SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY method ORDER BY ts, seq) AS prev FROM ({_RESETS}))")})
    GROUP BY method, tick HAVING count(*) >= 2 AND max(ts) > min(ts)"""


def _restarting(spark, d):
    """Counters that restart from 0 every 500 operations."""
    series = M.counter_series(V.op_log(spark, d), ["method"])
    return series.select("method", "ts", F.col("op_id").alias("seq"), (F.col("total_ops") % 500).cast("double").alias("value"))


@query(
    "M04_counter_rate",
    f"SELECT method, tick, n, CAST(increase AS DOUBLE) AS increase, round(increase / span, 9) AS rate FROM ({_WINDOWS})",
)
def counter_rate(spark, d):
    return M.counter_rate(_restarting(spark, d), ["method"], RANGE_S, STEP_S).withColumn("rate", F.round("rate", 9))


@query(
    "M04_counter_rate_extrapolated",
    f"""WITH e AS (SELECT *, span / (n - 1) AS gap, (epoch_us(t0) - (epoch_us(tick) - {RANGE_US})) / 1000000.0::DOUBLE AS a,
                          (epoch_us(tick) - epoch_us(t1)) / 1000000.0::DOUBLE AS z FROM ({_WINDOWS})),
             f AS (SELECT *, CASE WHEN a >= gap * 1.1 THEN gap / 2 ELSE a END AS a1, CASE WHEN z >= gap * 1.1 THEN gap / 2 ELSE z END AS z1 FROM e)
        SELECT method, tick, n, CAST(increase AS DOUBLE) AS increase, round(increase * ((span +
               CASE WHEN increase > 0 THEN least(a1, span * (v0 / increase)) ELSE a1 END + z1) / span) / {RANGE_S}, 9) AS rate FROM f""",
)
def counter_rate_extrapolated(spark, d):
    return M.counter_rate(_restarting(spark, d), ["method"], RANGE_S, STEP_S, extrapolate=True).withColumn("rate", F.round("rate", 9))


def _op_counts(spark, d):
    return V.op_log(spark, d).groupBy("run_id", "method", "status").agg(F.count("*").alias("value"))


_OP_COUNTS = "SELECT run_id, method, status, count(*) AS value FROM op_log GROUP BY ALL"


@query("M05_sum_by", f"SELECT method, status, CAST(sum(value) AS BIGINT) AS value FROM ({_OP_COUNTS}) GROUP BY method, status")
def sum_by(spark, d):
    return M.sum_by(_op_counts(spark, d), ["method", "status"])


@query(
    "M06_label_match",
    f"SELECT * FROM ({_OP_COUNTS}) WHERE regexp_full_match(method, 'cl.*|view|pur.*') AND status <> 'error' AND method IN ('click', 'purchase')",
)
def label_match(spark, d):
    return M.label_match(
        _op_counts(spark, d), [("method", "=~", "cl.*|view|pur.*"), ("status", "!=", "error"), ("method", "in", ["click", "purchase"])]
    )


@query("M07_label_values", "SELECT DISTINCT method FROM op_log")
def label_values(spark, d):
    return M.label_values(V.op_log(spark, d), "method")


@query(
    "M08_bucketize",
    f"""SELECT 'shard' AS family, '' AS method, le, cum, "count", round("sum", 4) AS "sum" FROM ({buckets_sql(SHARD_BOUNDS, 'SELECT * FROM op_log')})
        UNION ALL SELECT 'commit', method, le, cum, "count", round("sum", 4) FROM ({buckets_sql(COMMIT_BOUNDS, 'SELECT * FROM op_log', 'method')})""",
)
def bucketize(spark, d):
    ops = V.op_log(spark, d)
    shard = M.bucketize(ops, SHARD_BOUNDS).select(F.lit("shard").alias("family"), F.lit("").alias("method"), "le", "cum", "count", "sum")
    commit = M.bucketize(ops, COMMIT_BOUNDS, ["method"]).withColumn("family", F.lit("commit"))
    return shard.unionByName(commit).withColumn("sum", F.round("sum", 4))


@query(
    "M09_histogram_quantile",
    " UNION ALL ".join(
        f"SELECT {q}::DOUBLE AS q, method, round(value, 9) AS value FROM ({quantile_sql(buckets_sql(COMMIT_BOUNDS, 'SELECT * FROM op_log', 'method'), q, 'method')})"
        for q in (0.5, 0.95, 0.99)
    ),
)
def histogram_quantile(spark, d):
    out = None
    for q in (0.5, 0.95, 0.99):
        buckets = M.bucketize(V.op_log(spark, d), COMMIT_BOUNDS, ["method"])
        part = M.histogram_quantile(buckets, q, ["method"]).select(F.lit(q).alias("q"), "method", F.round("value", 9).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "M09_windowed_quantile",
    f"""SELECT method, tick, round(value, 9) AS value FROM (
        {quantile_sql(buckets_sql(SHARD_BOUNDS, ticks("SELECT * FROM op_log"), "method, tick"), 0.99, "method, tick")})""",
)
def windowed_quantile(spark, d):
    found = M.windowed_quantile(V.op_log(spark, d), 0.99, SHARD_BOUNDS, ["method"], RANGE_S, STEP_S)
    return found.withColumn("value", F.round("value", 9))


def _figures(by: str, value: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(sum({value}), 4) AS "sum", round(avg({value}), 9) AS mean, min({value}) AS "min", max({value}) AS "max",
               round(quantile_cont({value}, 0.5), 9) AS p50, round(quantile_cont({value}, 0.95), 9) AS p95,
               round(quantile_cont({value}, 0.99), 9) AS p99"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("M10_exact_quantiles", f"{_figures('method', 'duration_s')} FROM op_log GROUP BY method")
def exact_quantiles(spark, d):
    return _rounded(M.latency_summary(V.op_log(spark, d), "duration_s", ["method"]), "mean", "p50", "p95", "p99")


@query("M10_overall_quantiles", f"{_figures('true AS overall', 'duration_s')} FROM op_log")
def overall_quantiles(spark, d):
    found = M.latency_summary(V.op_log(spark, d), "duration_s").withColumn("overall", F.lit(True))
    return _rounded(found, "mean", "p50", "p95", "p99")


@query(
    "M11_error_ratio",
    f"""SELECT level, tick, count(*) FILTER (status = 'error') AS errors, count(*) AS total,
               count(*) FILTER (status = 'error') / count(*) AS value FROM ({ticks("SELECT * FROM op_log")}) GROUP BY level, tick""",
)
def error_ratio(spark, d):
    return M.error_ratio(V.op_log(spark, d), ["level"], RANGE_S, STEP_S)


@query(
    "M12_resample",
    f"""SELECT worker_id, tick, arg_max(step, (ts, step)) AS value, max(ts) AS sampled_at
        FROM ({ticks("SELECT worker_id, ts, step FROM heartbeats")})
        WHERE epoch_us(tick) - epoch_us(ts) < {RANGE_US} GROUP BY worker_id, tick""",
)
def resample(spark, d):
    samples = V.heartbeats(spark, d).select("worker_id", "ts", F.col("step").alias("seq"), F.col("step").alias("value"))
    return M.resample(samples, ["worker_id"], STEP_S, RANGE_S)


def _intervals(spark, d):
    """Operations as intervals of value minutes on their method's server."""
    us = F.round(F.col("duration_s") * 50 * 100).cast("long") * 600_000
    return V.op_log(spark, d).select(
        F.col("method").alias("server"), "op_id", F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + us).alias("ended_at"),
    )


_INTERVALS = """
    SELECT event_type AS server, event_id AS op_id, ts AS started_at,
           make_timestamp(epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000) AS ended_at FROM events"""
_PROFILE = f"""
    SELECT server, op_id, ts, delta, CAST(sum(delta) OVER w AS BIGINT) AS depth, lead(ts) OVER w AS next_ts FROM (
      SELECT server, op_id, started_at AS ts, CAST(1 AS BIGINT) AS delta FROM ({_INTERVALS}) UNION ALL
      SELECT server, op_id, ended_at, -1 FROM ({_INTERVALS}))
    WINDOW w AS (PARTITION BY server ORDER BY ts, delta, op_id)"""


@query(
    "M13_gauge_utilisation",
    f"SELECT server, max(depth) AS depth, max(depth) / 32.0::DOUBLE AS utilisation FROM ({_PROFILE}) GROUP BY server",
)
def gauge_utilisation(spark, d):
    peaks = M.gauge_max(M.concurrency_profile(_intervals(spark, d), ["server"]), ["server"], "depth")
    return peaks.withColumn("utilisation", M.gauge_utilisation(F.col("depth")))


@query(
    "M14_threshold_band",
    f"""SELECT worker_id, lag_s, CASE WHEN lag_s >= 30 THEN 'red' WHEN lag_s >= 15 THEN 'yellow' ELSE 'green' END AS band,
               CASE WHEN lag_s < 5 THEN 'ok' WHEN lag_s < 30 THEN 'warn' ELSE 'err' END AS ui_band, round(least(100.0, lag_s / 60 * 100), 6) AS bar
        FROM (SELECT worker_id, (((us + 5000) // 10000) / 100.0::DOUBLE) / 3600 AS lag_s FROM ({_LAST}))""",
)
def threshold_band(spark, d):
    lag = F.col("lag_s")  # hours here
    return W.heartbeat_lag(V.heartbeats(spark, d), now()).withColumn("lag_s", lag / 3600).select(
        "worker_id", "lag_s", M.threshold_band(lag, M.LAG_STEPS).alias("band"), M.lag_band(lag).alias("ui_band"),
        F.round(M.lag_bar(lag), 6).alias("bar"),
    )


@query("M15_concurrency_profile", _PROFILE)
def concurrency_profile(spark, d):
    return M.concurrency_profile(_intervals(spark, d), ["server"]).drop("ended_at")


@query(
    "M15_concurrency_summary",
    f"""SELECT server, max(depth) AS peak, coalesce(CAST(sum(epoch_us(next_ts) - epoch_us(ts)) FILTER (depth >= 4) AS BIGINT), 0) / 1000000.0::DOUBLE AS full_s
        FROM ({_PROFILE}) GROUP BY server""",
)
def concurrency_summary(spark, d):
    return M.concurrency_summary(M.concurrency_profile(_intervals(spark, d), ["server"]), 4, ["server"])


# one step per operation and server: the end times of what runs, and whether the arrival finds room
_ADMIT = f"""
    WITH RECURSIVE arrivals AS MATERIALIZED (
      SELECT server, op_id, epoch_us(started_at) AS s, epoch_us(ended_at) AS e,
             row_number() OVER (PARTITION BY server ORDER BY started_at, op_id) AS n FROM ({_INTERVALS})
    ), fold AS (
      SELECT server, n, op_id, true AS admitted, [e] AS running FROM arrivals WHERE n = 1
      UNION ALL
      SELECT server, n, op_id, len(still) < 3, CASE WHEN len(still) < 3 THEN list_append(still, e) ELSE still END FROM (
        SELECT a.server, a.n, a.op_id, a.e, list_filter(f.running, lambda x: x > a.s) AS still
        FROM fold f JOIN arrivals a ON a.server = f.server AND a.n = f.n + 1)
    ) SELECT server, op_id, admitted FROM fold"""


@query("M15_admit", _ADMIT)
def admit(spark, d):
    return M.admit(settle(M.busy_periods(_intervals(spark, d))), capacity=3)


@query(
    "M16_active_runs_over_time",
    """WITH e AS (SELECT ts, seq, CASE WHEN to_state IN ('RUNNING', 'CHECKPOINTING') THEN 1 ELSE 0 END - CASE WHEN
                  lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, seq) IN ('RUNNING', 'CHECKPOINTING') THEN 1 ELSE 0 END AS delta FROM replayed WHERE accepted),
            a AS (SELECT ts, seq, CAST(sum(delta) OVER (ORDER BY ts, seq) AS BIGINT) AS active FROM e WHERE delta <> 0)
       SELECT date_trunc('day', ts) AS day, max(active) AS peak, arg_max(active, (ts, seq)) AS closing FROM a GROUP BY 1""",
)
def active_runs_over_time(spark, d):
    return M.active_runs_per_day(M.active_runs_over_time(accepted_changes(V.state_events(spark, d))))


@query(
    "M18_throughput",
    """SELECT size_mb, CAST(size_mb AS BIGINT) * 1048576 AS size_bytes, count(*) AS iterations, round(avg(save_s) * 1000, 1) AS avg_save_ms,
              round(avg(restore_s) * 1000, 1) AS avg_restore_ms, round(min(save_s) * 1000, 1) AS min_save_ms,
              round(min(restore_s) * 1000, 1) AS min_restore_ms, round(size_mb / avg(save_s), 1) AS save_mib_s,
              round(size_mb / avg(restore_s), 1) AS restore_mib_s FROM trials GROUP BY size_mb""",
)
def throughput(spark, d):
    return M.throughput(V.trials(spark, d))


_HALF = "2024-01-16"


@query(
    "M19_compare_baseline",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(a, 6) AS "before", round(b, 6) AS "after", round((round(b, 6) - round(a, 6)) / round(a, 6) * 100, 1) AS change_pct,
            {'round(b, 6) > round(a, 6)' if m == 'n' else 'round(b, 6) < round(a, 6)'} AS improved FROM (SELECT {f} FILTER (ts < TIMESTAMP '{_HALF}')::DOUBLE AS a,
            {f} FILTER (ts >= TIMESTAMP '{_HALF}')::DOUBLE AS b FROM op_log)"""
        for m, f in [
            ("n", "count(*)"), ("mean", "avg(duration_s)"), ("p50", "quantile_cont(duration_s, 0.5)"),
            ("p95", "quantile_cont(duration_s, 0.95)"), ("p99", "quantile_cont(duration_s, 0.99)"),
        ]
    ),
)
def compare_baseline(spark, d):
    ops = V.op_log(spark, d)

    def half(df):
        rows = M.as_metric_rows(M.latency_summary(df, "duration_s"), ["n", "mean", "p50", "p95", "p99"])
        return rows.withColumn("value", F.round("value", 6))

    return M.compare_baseline(half(ops.where(f"ts < '{_HALF}'")), half(ops.where(f"ts >= '{_HALF}'")), ["n"])


@query(
    "M20_check_thresholds",
    """WITH s AS (SELECT 'http_req_duration' AS metric, duration_s * 1000 AS v FROM op_log UNION ALL
                  SELECT 'http_req_failed', CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END FROM op_log UNION ALL
                  SELECT 'errors', CASE WHEN level = 3 THEN 1.0 ELSE 0.0 END FROM op_log UNION ALL
                  SELECT 'api_latency', duration_s * 1000 FROM op_log WHERE method = 'view' UNION ALL
                  SELECT 'checkpoint_latency', duration_s * 1000 FROM op_log WHERE method = 'purchase'),
            a AS (SELECT metric, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99,
                  avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END) AS rate FROM s GROUP BY 1),
            r AS (SELECT metric, 'p(95)<3000' AS rule, p95 AS o, 3000 AS b FROM a WHERE metric = 'http_req_duration' UNION ALL
                  SELECT metric, 'p(99)<5000', p99, 5000 FROM a WHERE metric = 'http_req_duration' UNION ALL
                  SELECT metric, 'rate<0.05', rate, 0.05 FROM a WHERE metric = 'http_req_failed' UNION ALL
                  SELECT metric, 'rate<0.1', rate, 0.1 FROM a WHERE metric = 'errors' UNION ALL
                  SELECT metric, 'p(95)<1000', p95, 1000 FROM a WHERE metric = 'api_latency' UNION ALL
                  SELECT metric, 'p(95)<5000', p95, 5000 FROM a WHERE metric = 'checkpoint_latency')
       SELECT metric, rule, round(o, 6) AS observed, o < b AS passed, CASE WHEN o < b THEN 'ok' ELSE 'exceeded' END AS verdict FROM r""",
)
def check_thresholds(spark, d):
    ops = V.op_log(spark, d)
    ms, bad, slow = F.col("duration_s") * 1000, (F.col("status") == "error").cast("double"), (F.col("level") == 3).cast("double")

    def sample(name, value):
        return F.struct(F.lit(name).alias("metric"), value.alias("value"))

    samples = ops.select(
        F.explode(
            F.array_compact(
                F.array(
                    sample("http_req_duration", ms),
                    sample("http_req_failed", bad),
                    sample("errors", slow),
                    F.when(F.col("method") == "view", sample("api_latency", ms)),
                    F.when(F.col("method") == "purchase", sample("checkpoint_latency", ms)),
                )
            )
        ).alias("s")
    ).select("s.*")
    values = ", ".join(f"('{m}', '{r}')" for m, r in M.LOAD_LIMITS)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS limits(metric, rule)")
    return M.check_thresholds(samples, rules).withColumn("observed", F.round("observed", 6))


@query(
    "M21_trial_summary",
    """SELECT vus, count(*) AS checks, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) * 100 / count(*), 2) AS passed_pct,
              round(avg(save_s), 9) AS mean, min(save_s) AS "min", round(quantile_cont(save_s, 0.5), 9) AS p50, max(save_s) AS "max",
              round(quantile_cont(save_s, 0.95), 9) AS p95, round(quantile_cont(save_s, 0.99), 9) AS p99,
              round(count(*) FILTER (NOT ok) / count(*), 4) AS error_rate FROM trials GROUP BY vus""",
)
def trial_summary(spark, d):
    return _rounded(M.trial_summary(V.trials(spark, d), "vus", "save_s"), "mean", "p50", "p95", "p99")


@query(
    "M22_attempt_summary",
    """WITH a AS (SELECT op_id // 3 AS op_id, op_id % 3 + 1 AS attempt, status <> 'error' AS ok, CASE WHEN status = 'error' THEN 'level ' || level END AS error FROM op_log),
            g AS (SELECT op_id, coalesce(min(attempt) FILTER (ok), max(attempt)) AS attempts, min(attempt) FILTER (ok) AS won,
                  arg_max(error, attempt) FILTER (NOT ok) AS last_error FROM a GROUP BY op_id)
       SELECT op_id, attempts, CASE WHEN won IS NOT NULL THEN 'success' WHEN attempts >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome,
              last_error, CAST(CASE attempts WHEN 1 THEN 0 WHEN 2 THEN 500 ELSE 1500 END AS BIGINT) AS wait_ms,
              CAST(CASE attempts WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE 750 END AS BIGINT) AS jitter_bound_ms FROM g""",
)
def attempt_summary(spark, d):
    attempts = V.op_log(spark, d).select(
        F.expr("op_id div 3").alias("op_id"), (F.col("op_id") % 3 + 1).alias("attempt"), (F.col("status") != "error").alias("ok"),
        F.when(F.col("status") == "error", F.concat(F.lit("level "), "level")).alias("error"),
    )
    return M.attempt_summary(attempts)


def _bytes_sql(n: str) -> str:
    units = "".join(
        f" WHEN {n} < {1024 ** (i + 1)} THEN CAST(round(CAST({n} / {float(1024**i)}::DOUBLE AS DECIMAL(30, 6)), 1) AS VARCHAR) || ' {u}'"
        for i, u in enumerate(X.BYTE_UNITS[:4])
    )
    return f"CASE WHEN {n} = 0 THEN '0 B'{units} ELSE CAST(round(CAST({n} / {float(1024**4)}::DOUBLE AS DECIMAL(30, 6)), 1) AS VARCHAR) || ' TB' END"


@query(
    "M23_formats",
    f"""SELECT checkpoint_id, {_bytes_sql('total_bytes')} AS bytes_text, {_bytes_sql('total_bytes * step')} AS volume_text,
               CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h ' || s % 3600 // 60 || 'm'
                    WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 60 || 'm' END AS uptime_text,
               CASE WHEN step < 5 THEN 'just now' WHEN step < 60 THEN step || 's ago' WHEN step < 3600 THEN step // 60 || 'm ago'
                    ELSE step // 3600 || 'h ago' END AS age_text,
               CASE WHEN length(tag) > 12 THEN tag[1:12] || '…' ELSE tag END AS tag_text,
               CAST(round(CAST(step / 2557.0::DOUBLE * 100 AS DECIMAL(30, 6)), 1) AS VARCHAR) || '%' AS share_text
        FROM (SELECT *, step * 137 AS s, 'checkpoint-' || checkpoint_id AS tag FROM checkpoints)""",
)
def formats(spark, d):
    tag = F.concat(F.lit("checkpoint-"), "checkpoint_id")
    return V.checkpoints(spark, d).select(
        "checkpoint_id",
        X.format_bytes(F.col("total_bytes")).alias("bytes_text"),
        X.format_bytes(F.col("total_bytes") * F.col("step")).alias("volume_text"),
        X.format_uptime(F.col("step") * 137).alias("uptime_text"),
        X.format_age(F.col("step")).alias("age_text"),
        X.short_id(tag).alias("tag_text"),
        X.format_percent(F.col("step") / F.lit(2557.0)).alias("share_text"),
    )
