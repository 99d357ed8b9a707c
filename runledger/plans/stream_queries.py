"""Streaming queries: each runs its stream over a table's files to the end and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import alerts as A
from runledger.plans import views as V
from runledger.plans.activity_queries import TTL_S, _VISITS
from runledger.plans.alert_queries import _BAD_LEVEL, RATIO_RULE, held_sql
from runledger.plans.metric_queries import HOUR, HOUR_US, RANGE_US, STEP_S, buckets_sql, quantile_sql
from runledger.plans.registry import query
from runledger.plans.worker_queries import _GAPS, DEAD_S
from runledger.schemas import SHARD_BOUNDS
from runledger.sources.logs import frame_text
from runledger.streaming import operators as S
from runledger.streaming.runner import closed, read_batches, run_batches, run_to_end, run_to_folder, table_stream

# the watermark at the end of the input: an hour behind the newest event, in milliseconds
_WATERMARK = "(SELECT epoch_ms(max(ts)) - 3600000 FROM events) * 1000"


def _events(spark, d):
    return table_stream(spark, d, "events")


@query(
    "T01_stream_outages",
    f"""SELECT worker_id, run_id, ts AS last_seen, ts + INTERVAL 24 HOUR AS declared_at FROM ({_GAPS})
        WHERE (back IS NULL OR epoch_us(back) - epoch_us(ts) > {DEAD_S * 1000000})
        AND epoch_us(ts) + {DEAD_S * 1000000 + 1} <= {_WATERMARK}""",
)
def stream_outages(spark, d):
    return run_to_end(S.stream_outages(V.heartbeats_of(_events(spark, d)), DEAD_S))


@query(
    "T02_stream_latest",
    """SELECT user_id, ts, event_id, value FROM events QUALIFY
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""",
)
def stream_latest(spark, d):
    changes = _events(spark, d).select(
        "user_id", "ts", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op")
    )
    latest = S.stream_latest(changes, ["user_id"], ["ts", "event_id"])
    out = run_batches(latest, S.latest_sink(latest.schema, ["user_id"], every=1), mode="update")
    return S.read_latest(spark, out, latest.schema, ["user_id"])


@query("T03_stream_replay", "SELECT run_id, seq, from_state, to_state, accepted FROM replayed")
def stream_replay(spark, d):
    replayed = run_to_end(S.stream_replay(closed(V.state_events_of(_events(spark, d)), "ts")))
    return replayed.where("not late").drop("late")


def _sliding(source: str, width_us: int) -> str:
    """Rows repeated for each closed window [tick - width, tick) on the hourly grid."""
    return f"""SELECT * FROM (SELECT *, make_timestamp(unnest(range(first, first + {width_us}, {HOUR_US}))) AS tick
               FROM (SELECT *, (epoch_us(ts) // {HOUR_US} + 1) * {HOUR_US} AS first FROM ({source}))) WHERE epoch_us(tick) <= {_WATERMARK}"""


def _bad_level_ops(stream):
    return V.op_log_of(stream).withColumn("status", F.when(F.col("level") == 3, "error").otherwise("success"))


_RATES = f"""SELECT method, tick, count(*) FILTER (status = 'error') AS errors, count(*) AS total,
                    count(*) FILTER (status = 'error') / count(*) AS value FROM ({_sliding(_BAD_LEVEL, RANGE_US)}) GROUP BY method, tick"""


def _rates(spark, d):
    return S.stream_rates(_bad_level_ops(_events(spark, d)), ["method"], "6 hours", "1 hour")


@query("T04_stream_rates", _RATES)
def stream_rates(spark, d):
    return run_to_end(_rates(spark, d))


_TUMBLING = f"""SELECT *, make_timestamp((epoch_us(ts) // {RANGE_US} + 1) * {RANGE_US}) AS tick FROM op_log
                WHERE (epoch_us(ts) // {RANGE_US} + 1) * {RANGE_US} <= {_WATERMARK}"""


@query(
    "T05_stream_histogram",
    f"""SELECT method, tick, n, round(value, 9) AS value FROM
        ({quantile_sql(buckets_sql(SHARD_BOUNDS, _TUMBLING, "method, tick"), 0.95, "method, tick")})
        JOIN (SELECT method, tick, count(*) AS n FROM ({_TUMBLING}) GROUP BY 1, 2) USING (method, tick)""",
)
def stream_histogram(spark, d):
    found = run_to_end(S.stream_histogram(V.op_log_of(_events(spark, d)), ["method"], SHARD_BOUNDS, 0.95, "6 hours"))
    return found.withColumn("value", F.round("value", 9))


_RATE_RULE = f"""SELECT 'ErrorShare' AS rule, 'method=' || method AS labels, tick, value, {2 * HOUR} AS hold_s, 0.25 AS bound FROM ({_RATES})"""


@query("T06_stream_alerts", f"SELECT rule, labels, tick, cond, active_since, state FROM ({held_sql(_RATE_RULE)})")
def stream_alerts(spark, d):
    """The closed rate windows are written by one stream and read by the alert stream."""
    rates = _rates(spark, d)
    source = spark.readStream.schema(rates.schema).parquet(run_to_folder(rates))
    series = A.labelled(source, "error_ratio", "method")
    conditions = A.evaluate_rules(series, [RATIO_RULE]).drop("severity", "summary")
    held = run_to_end(S.stream_alerts(closed(conditions, "tick"), STEP_S)).where("not late")
    return held.select("rule", "labels", "tick", "cond", "active_since", "state")


@query(
    "T07_stream_presence",
    f"""SELECT session_id, min(ts) AS started_at, max(ts) AS last_ping_at, count(*) AS n_pings FROM ({_VISITS})
        GROUP BY session_id, visit HAVING epoch_us(max(ts)) + {TTL_S * 1000000 + 1} <= {_WATERMARK}""",
)
def stream_presence(spark, d):
    pings = _events(spark, d).select(F.col("user_id").alias("session_id"), "ts")
    return run_to_end(S.stream_presence(pings, TTL_S))


@query(
    "T08_stream_logs",
    r"""SELECT source, seq, CASE WHEN line LIKE '% step=%steps/s=%' AND line NOT LIKE '%: %' AND line LIKE '%] rank=_ step=%' THEN 'step'
              WHEN line LIKE '%] rank=_ Checkpoint saved%' THEN 'saved' WHEN line LIKE '%] rank=_ Restored from%' THEN 'restored' ELSE 'other' END AS kind,
              regexp_matches(line, 'checkpoint.*committed', 'i') OR regexp_matches(line, 'checkpoint saved', 'i')
              OR regexp_matches(line, 'heartbeat.*timeout', 'i') OR regexp_matches(line, 'FAILED|RECOVERING')
              OR regexp_matches(line, 'restored from checkpoint', 'i') OR regexp_matches(line, 'step=\d+.*loss=') AS highlighted
       FROM log_lines""",
)
def stream_logs(spark, d):
    lines = V.log_lines_of(_events(spark, d)).unionByName(V.notes_of(table_stream(spark, d, "conversations")))
    return run_to_end(S.stream_logs(lines)).select("source", "seq", "kind", "highlighted")


@query(
    "T08_stream_run_events",
    """SELECT event_type, CAST(user_id AS VARCHAR) AS run_id, '{"run_id":' || user_id || ',"seq":' || event_id || '}' AS payload FROM events""",
)
def stream_run_events(spark, d):
    payload = F.concat(F.lit('{"run_id":'), "user_id", F.lit(',"seq":'), "event_id", F.lit("}"))
    frames = _events(spark, d).select(frame_text(F.col("event_type"), payload).alias("value"))
    return run_to_end(S.stream_run_events(frames), ["run_bucket"]).drop("run_bucket")


@query(
    "T09_stream_commit",
    """WITH f AS (SELECT checkpoint_id, shard_id, size_bytes, uploaded_at, rank, part_no, host_no FROM shards
                  QUALIFY row_number() OVER (PARTITION BY checkpoint_id, shard_id ORDER BY uploaded_at, rank, part_no, host_no) = 1),
            w AS (SELECT checkpoint_id, num_workers FROM checkpoints JOIN runs USING (run_id))
       SELECT checkpoint_id, count(*) AS num_shards, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
              string_agg(shard_id || ':' || size_bytes, ',' ORDER BY shard_id) AS listed
       FROM f LEFT JOIN w USING (checkpoint_id) GROUP BY checkpoint_id HAVING count(*) >= coalesce(max(num_workers), 1)""",
)
def stream_commit(spark, d):
    shards = table_stream(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("checkpoint_id"),
        F.concat(F.lit("rank-"), "l_linenumber").alias("shard_id"),
        F.col("l_linenumber").alias("rank"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"),
        F.col("l_shipdate").alias("uploaded_at"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("host_no"),
    )
    workers = V.checkpoints(spark, d).join(V.runs(spark, d).select("run_id", F.col("num_workers").alias("expected")), "run_id")
    out = run_batches(S.stream_commits(shards, workers), S.commit_batch)
    return S.read_commits(spark, out).where("kind = 'manifest'").drop("kind", "shard_id", "batch_id")


@query(
    "T10_stream_digest",
    """SELECT DISTINCT source || '/' || lang || '/sha256-' || sha256(text)[1:16] || '-' || doc_id || '.bin' AS key, 'shard' AS kind FROM documents
       UNION ALL SELECT DISTINCT source || '/' || lang || '/' || doc_id || '.sha256', 'checksum' FROM documents""",
)
def stream_digest(spark, d):
    payloads = table_stream(spark, d, "documents").select(
        F.col("source").alias("run_id"), F.col("lang").alias("checkpoint_id"), F.col("doc_id").alias("shard_id"),
        F.encode("text", "UTF-8").alias("payload"),
    )
    out = run_batches(S.stream_uploads(payloads), S.upload_batch)
    return read_batches(spark, out, S.UPLOAD_SCHEMA).drop("batch_id")
