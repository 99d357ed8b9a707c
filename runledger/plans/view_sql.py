"""The views of ``views.py`` as SQL, for checking results with another engine."""

from __future__ import annotations

import re

from runledger.schemas import SHARDING_POLICIES, STATES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_K = r"CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)"


def _fixed(places: int) -> str:
    unit = 10**places
    return f"(c // {unit}) || '.' || lpad(CAST(c % {unit} AS VARCHAR), {places}, '0')"


VIEWS = {
    "runs": f"""
        SELECT c_custkey AS run_id, c_name AS name, {_list(STATES)}[c_custkey % 8 + 1] AS state,
               c_custkey * 37 % 3000 AS current_step, CAST(c_custkey % 5 AS INTEGER) AS num_workers,
               500 AS checkpoint_interval_steps,
               CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0 ELSE 3000 END AS BIGINT) AS max_steps,
               c_mktsegment AS dataset_id,
               {_list([*SHARDING_POLICIES, "CUSTOM"])}[c_custkey % 5 + 1] AS sharding_policy
        FROM customer""",
    "checkpoints": """
        SELECT o_orderkey AS checkpoint_id, o_custkey AS run_id,
               CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS step,
               CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'PENDING' END AS state,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 72 + 1) END AS committed_at,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total_bytes
        FROM orders""",
    "shards": """
        SELECT l_orderkey AS checkpoint_id, 'rank-' || l_linenumber AS shard_id, l_linenumber AS rank,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_shipdate AS uploaded_at,
               l_partkey AS part_no, l_suppkey AS host_no,
               sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                      CAST(round(l_extendedprice * 100) AS BIGINT))) AS sha256
        FROM lineitem""",
    "run_shards": """
        SELECT s.*, c.run_id, c.step, c.state, c.committed_at FROM shards s JOIN checkpoints c USING (checkpoint_id)""",
    "objects": """
        SELECT run_id || '/' || checkpoint_id || '/sha256-' || sha256[1:16] || '-' || shard_id || '.bin' AS key,
               size_bytes AS size, uploaded_at AS modified FROM run_shards
        UNION ALL
        SELECT run_id || '/' || checkpoint_id || '/' || shard_id || '.sha256', CAST(64 AS BIGINT), uploaded_at FROM run_shards
        UNION ALL
        SELECT run_id || '/' || checkpoint_id || '/_manifest.json', CAST(512 AS BIGINT), committed_at
        FROM checkpoints WHERE state = 'COMMITTED'""",
    "failures": """
        SELECT o_orderkey AS failure_id, o_custkey AS run_id, o_orderdate + INTERVAL 12 HOUR AS failed_at
        FROM orders WHERE o_orderpriority LIKE '1-%'""",
    "heartbeats": """
        SELECT user_id AS worker_id, user_id % 50 AS run_id, ts, event_id AS step FROM events""",
    "registrations": """
        SELECT worker_id, run_id, min(ts) AS registered_at FROM heartbeats GROUP BY ALL""",
    "state_events": f"""
        SELECT user_id AS run_id, ts, event_id AS seq,
               CASE WHEN k = 99 THEN 'CANCELLED' WHEN k = 98 THEN 'COMPLETED'
                    ELSE ['RUNNING', 'CHECKPOINTING', 'COMMITTED', 'FAILED', 'RECOVERING'][k % 5 + 1] END AS to_state
        FROM (SELECT *, {_K} AS k FROM events)""",
    "op_log": f"""
        SELECT event_id AS op_id, ts, event_type AS method,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, user_id AS run_id,
               value / 50 AS duration_s, CAST(round(value * 1000) AS BIGINT) AS bytes, {_K} % 4 AS level
        FROM events""",
    "trials": f"""
        SELECT event_id AS trial_id, [1, 10, 100][{_K} % 3 + 1] AS size_mb, {_K} % 4 + 1 AS vus,
               value / 50 AS save_s, value / 100 AS restore_s, event_type <> 'error' AS ok
        FROM events""",
    "payloads": """
        SELECT doc_id AS shard_id, encode(text) AS payload, source AS run_id, lang AS checkpoint_id, n_chars AS size
        FROM documents""",
    "train_steps": """
        SELECT event_id % 7 AS run_id, event_id // 7 + 1 AS step, value / 50 AS loss, ts FROM events""",
    "log_lines": f"""
        SELECT ['worker-0', 'worker-1', 'controlplane', 'dataplane'][user_id % 4 + 1] AS source, ts, event_id * 2 AS seq,
               strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_type = 'error' THEN ' [ERROR] rank=' ELSE ' [INFO] rank=' END
               || user_id % 4 || ' ' || CASE
                 WHEN event_type = 'view' THEN 'step=' || (event_id + 1) || '/200000  loss=' || {_fixed(4)} || '  steps/s=' || {_fixed(1)}
                 WHEN event_type = 'click' THEN 'Checkpoint saved (runtime): step=' || (event_id + 1) || ' loss=' || {_fixed(4)}
                   || ' size=' || c * 10 || ' bytes sha256=' || sha256(CAST(event_id AS VARCHAR))[1:16] || ' time=' || {_fixed(2)} || 's'
                 WHEN event_type = 'purchase' THEN 'Restored from runtime checkpoint: checkpoint_id=ck' || k || ' step=' || (event_id + 1)
                   || ' size=' || c * 10 || ' bytes time=' || {_fixed(2)} || 's'
                 WHEN event_type = 'error' AND k % 2 = 0 THEN 'Heartbeat to coordinator ended in timeout'
                 WHEN event_type = 'error' THEN 'Runtime checkpoint failed: connection reset'
                 WHEN k < 50 THEN 'Checkpoint ck' || k || ' committed'
                 ELSE 'Registered as worker' END AS line
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c, {_K} AS k FROM events)
        UNION ALL
        SELECT 'notes', TIMESTAMP '2024-01-01' + to_minutes(conv_id) + to_seconds(turn), (conv_id * 1000 + turn) * 2 + 1,
               replace(text, chr(10), ' ')
        FROM conversations""",
    "pings": """
        SELECT user_id AS session_id, ts, event_id AS seq,
               CASE user_id % 6 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN ' 203.0.113.' || user_id || ' , 10.1.1.1'
                    WHEN 2 THEN '' ELSE '198.51.100.' || user_id % 25 || ',172.16.0.1' END AS forwarded,
               CASE WHEN user_id % 12 = 2 THEN '192.168.1.' || user_id END AS peer
        FROM events""",
    "geo": """
        SELECT '198.51.100.' || n_nationkey AS address, n_name AS country,
               CASE WHEN n_nationkey = 7 THEN '' ELSE substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey + 1, 1)
                    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', n_nationkey % 5 + 1, 1) END AS country_code
        FROM nation""",
    # run state changes with the state they were asked in, invalid ones rejected
    "edges": """
        SELECT * FROM (VALUES ('CREATED','RUNNING'), ('CREATED','CANCELLED'), ('RUNNING','CHECKPOINTING'),
          ('RUNNING','FAILED'), ('RUNNING','CANCELLED'), ('RUNNING','COMPLETED'), ('CHECKPOINTING','COMMITTED'),
          ('CHECKPOINTING','FAILED'), ('CHECKPOINTING','RUNNING'), ('COMMITTED','RUNNING'), ('COMMITTED','COMPLETED'),
          ('COMMITTED','FAILED'), ('FAILED','RECOVERING'), ('FAILED','CANCELLED'), ('RECOVERING','RUNNING'),
          ('RECOVERING','FAILED'), ('RECOVERING','CANCELLED')) t(from_state, to_state)""",
    "requests_in_order": """
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) AS n FROM state_events""",
    "replayed": """
        SELECT r.run_id, r.ts, r.seq, r.n, 'CREATED' AS from_state, r.to_state, e.to_state IS NOT NULL AS accepted,
               CASE WHEN e.to_state IS NOT NULL THEN r.to_state ELSE 'CREATED' END AS now_state
        FROM requests_in_order r LEFT JOIN edges e ON e.from_state = 'CREATED' AND e.to_state = r.to_state WHERE r.n = 1
        UNION ALL
        SELECT r.run_id, r.ts, r.seq, r.n, p.now_state, r.to_state, e.to_state IS NOT NULL,
               CASE WHEN e.to_state IS NOT NULL THEN r.to_state ELSE p.now_state END
        FROM replayed p JOIN requests_in_order r ON r.run_id = p.run_id AND r.n = p.n + 1
        LEFT JOIN edges e ON e.from_state = p.now_state AND e.to_state = r.to_state""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text) and VIEWS[name] is not text:
                visit(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    visit(body)
    if not wanted:
        return body.strip()
    body = body.strip()
    body = "," + body[len("WITH") :] if body.startswith("WITH ") else body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" + body
