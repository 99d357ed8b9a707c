"""Log, presence and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import activity as P
from runledger.plans import views as V
from runledger.plans.registry import query

TTL_S = 6 * 3600
NOW = "2024-01-30 12:00:00"
SOURCES = ["worker-0", "controlplane", "dataplane"]

_PLACED = f"""
    SELECT p.session_id, p.ts, p.seq, p.address, CASE WHEN local THEN 'Local' ELSE coalesce(g.country, 'Unknown') END AS country,
           CASE WHEN local THEN '' ELSE coalesce(g.country_code, '') END AS country_code,
           CASE WHEN local THEN chr(128187) WHEN length(coalesce(g.country_code, '')) = 2
                THEN translate(upper(g.country_code), '{P.LETTERS}', '{P.FLAG_LETTERS}') ELSE chr(127760) END AS flag
    FROM (SELECT *, regexp_matches(address, '^(127\\.|10\\.|172\\.|192\\.168\\.|::1|0\\.0\\.0\\.0)') AS local FROM
           (SELECT session_id, ts, seq, CASE WHEN forwarded <> '' THEN trim(split_part(forwarded, ',', 1))
                   ELSE coalesce(peer, '0.0.0.0') END AS address FROM pings)) p
    LEFT JOIN geo g ON g.address = p.address"""
_VISITS = f"""
    SELECT *, CAST(sum(CASE WHEN joined THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq) AS BIGINT) AS visit
    FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq)) > {TTL_S * 1000000}, true) AS joined
          FROM pings)"""


def placed(spark, d):
    pings = V.pings(spark, d).withColumn("address", P.client_address(F.col("forwarded"), F.col("peer")))
    return P.enrich_geo(pings.drop("forwarded", "peer"), V.geo(spark, d))


@query(
    "P01_highlight_logs",
    r"""SELECT source, seq, regexp_matches(line, 'checkpoint.*committed', 'i') OR regexp_matches(line, 'checkpoint saved', 'i')
              OR regexp_matches(line, 'heartbeat.*timeout', 'i') OR regexp_matches(line, 'FAILED|RECOVERING')
              OR regexp_matches(line, 'restored from checkpoint', 'i') OR regexp_matches(line, 'step=\d+.*loss=') AS highlighted FROM log_lines""",
)
def highlight_logs(spark, d):
    return P.highlight_logs(V.log_lines(spark, d)).select("source", "seq", "highlighted")


@query(
    "P02_tail_logs",
    """SELECT source, seq, ts, line FROM log_lines WHERE source IN ('worker-0', 'controlplane', 'dataplane') AND trim(line) <> ''
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) <= 30""",
)
def tail_logs(spark, d):
    return P.tail_logs(V.log_lines(spark, d), SOURCES, 30)


@query("P03_recent_events", "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, d):
    return P.recent_window(V.events(spark, d).select("event_id", "ts", "user_id", "event_type"), P.FEED_KEPT, ["ts", "event_id"])


@query(
    "P03_recent_per_run",
    """SELECT run_id, seq, ts, to_state FROM state_events
       QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) <= 200""",
)
def recent_per_run(spark, d):
    return P.recent_window(V.state_events(spark, d), P.RUN_EVENTS_KEPT, ["ts", "seq"], ["run_id"])


@query(
    "P04_present_visitors",
    f"""SELECT CASE WHEN country_code = '' THEN 'XX' ELSE country_code END AS country_code, min(country) AS country, count(*) AS n_visitors
        FROM (SELECT session_id, max(ts) AS ts, arg_max(country, (ts, seq)) AS country, arg_max(country_code, (ts, seq)) AS country_code
              FROM ({_PLACED}) GROUP BY 1)
        WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) <= {TTL_S * 1000000} GROUP BY 1""",
)
def present_visitors(spark, d):
    return P.visitors_by_country(P.present_visitors(placed(spark, d), F.lit(NOW).cast("timestamp"), TTL_S))


@query(
    "P05_visit_sessions",
    f"""SELECT session_id, visit, min(ts) AS started_at, max(ts) AS last_ping_at, count(*) AS n_pings
        FROM ({_VISITS}) GROUP BY session_id, visit""",
)
def visit_sessions(spark, d):
    return P.visit_sessions(V.pings(spark, d), TTL_S)


@query("P06_enrich_geo", f"SELECT seq, address, country, country_code, flag FROM ({_PLACED})")
def enrich_geo(spark, d):
    return placed(spark, d).select("seq", "address", "country", "country_code", "flag")


@query(
    "P08_activity_feed",
    f"""SELECT ts, seq, flag, 'Someone from ' || country || ' is watching the demo' AS message FROM ({_PLACED}) JOIN
          (SELECT seq FROM ({_VISITS}) WHERE joined) USING (seq)
        UNION ALL SELECT p.ts, seq, flag, 'Someone from ' || country || ' just killed worker-' || session_id % 2 || '!'
        FROM ({_PLACED}) p JOIN (SELECT event_id AS seq FROM events WHERE event_type = 'error') USING (seq)
        ORDER BY ts DESC, seq DESC, message DESC LIMIT 50""",
)
def activity_feed(spark, d):
    pings = placed(spark, d)
    kinds = V.events(spark, d).select(F.col("event_id").alias("seq"), "event_type")
    kills = pings.join(kinds.where("event_type = 'error'"), "seq").withColumn(
        "worker", F.concat(F.lit("worker-"), F.col("session_id") % 2)
    )
    joins = P.mark_visits(pings, TTL_S).where("joined")
    return P.activity_feed(joins, kills)
