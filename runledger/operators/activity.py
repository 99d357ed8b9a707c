"""Log highlights and tails, visitor presence, visits and the activity feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import HOUR, SECOND, micros
from runledger.functions.ordered import by_time, scan

# Log highlight patterns; (?i) marks those that ignore case.
HIGHLIGHTS = [
    r"(?i)checkpoint.*committed",
    r"(?i)checkpoint saved",
    r"(?i)heartbeat.*timeout",
    r"FAILED|RECOVERING",
    r"(?i)restored from checkpoint",
    r"step=\d+.*loss=",
]

# Address prefixes taken as local, feed sizes, presence time to live in seconds.
PRIVATE_PREFIXES = ["127.", "10.", "172.", "192.168.", "::1", "0.0.0.0"]
FEED_KEPT = 50
FEED_SHOWN = 20
RUN_EVENTS_KEPT = 200
LOG_LINES_KEPT = 150
PRESENCE_TTL_S = 45

# Feed messages.
JOINED = "Someone from %s is watching the demo"
KILLED = "Someone from %s just killed %s!"

# Flags.
GLOBE = "\U0001f310"
LAPTOP = "\U0001f4bb"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FLAG_LETTERS = "".join(chr(0x1F1E6 + i) for i in range(26))


def is_highlighted(line: Column) -> Column:
    hit = F.lit(False)
    for pattern in HIGHLIGHTS:
        hit = hit | line.rlike(pattern)
    return hit


def highlight_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn("highlighted", is_highlighted(F.col(column)))


def tail_logs(lines: DataFrame, sources: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` lines of each allowed source, blank lines left out."""
    newest = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("seq"))
    kept = lines.where(F.col("source").isin(list(sources)) & (F.length(F.trim("line")) > 0))
    return kept.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n).drop("_place")


def recent_window(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, over all rows or per key; ties are cut by the later columns of ``order``."""
    newest = [F.desc(c) for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def client_address(forwarded: Column, peer: Column) -> Column:
    """First entry of the forwarded list, else the peer, else 0.0.0.0."""
    return F.when(F.length(forwarded) > 0, F.trim(F.split(forwarded, ",")[0])).otherwise(
        F.coalesce(peer, F.lit("0.0.0.0"))
    )


def country_flag(code: Column) -> Column:
    return F.when(F.length(code) == 2, F.translate(F.upper(code), LETTERS, FLAG_LETTERS)).otherwise(GLOBE)


def enrich_geo(df: DataFrame, dim: DataFrame, address: str = "address", private: Sequence[str] = PRIVATE_PREFIXES) -> DataFrame:
    """Country, code and flag of each address: private ranges are Local, addresses not in ``dim`` Unknown."""
    local = F.lit(False)
    for prefix in private:
        local = local | F.col(address).startswith(prefix)
    places = dim.select(
        F.col("address").alias(address), F.col("country").alias("_country"), F.col("country_code").alias("_code")
    )
    code = F.when(local, "").otherwise(F.coalesce("_code", F.lit("")))
    return (
        df.join(places, address, "left")
        .withColumns(
            {
                "country": F.when(local, "Local").otherwise(F.coalesce("_country", F.lit("Unknown"))),
                "country_code": code,
                "flag": F.when(local, LAPTOP).otherwise(country_flag(code)),
            }
        )
        .drop("_country", "_code")
    )


def present_visitors(pings: DataFrame, now: Column, ttl_s: float = PRESENCE_TTL_S) -> DataFrame:
    """Sessions whose last ping is at most ``ttl_s`` old."""
    fields = [c for c in pings.columns if c != "session_id"]
    last = pings.groupBy("session_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("p"))
    return last.select("session_id", "p.*").where(micros(now) - micros("ts") <= int(ttl_s * SECOND))


def visitors_by_country(present: DataFrame) -> DataFrame:
    """Visitor count per country code (blank = XX), most first."""
    code = F.when(F.coalesce(F.col("country_code"), F.lit("")) == "", "XX").otherwise(F.col("country_code"))
    return (
        present.groupBy(code.alias("country_code"))
        .agg(F.min("country").alias("country"), F.count("*").alias("n_visitors"))
        .orderBy(F.desc("n_visitors"), "country_code")
    )


def mark_visits(
    pings: DataFrame, ttl_s: float = PRESENCE_TTL_S, slice_us: int = HOUR, keep_slice: bool = False
) -> DataFrame:
    """Add ``joined``: the session's first ping, or one more than ``ttl_s`` after the previous."""
    before = scan(
        pings, ["session_id"], ["ts", "seq"], by_time("ts", slice_us, "seq"), keep_slice=keep_slice, prev={"_before": "ts"}
    )
    gap = micros("ts") - micros("_before")
    return before.withColumn("joined", F.col("_before").isNull() | (gap > int(ttl_s * SECOND))).drop("_before")


def visit_sessions(pings: DataFrame, ttl_s: float = PRESENCE_TTL_S, slice_us: int = HOUR) -> DataFrame:
    """One row per visit with its number, first and last ping and number of pings."""
    numbered = scan(
        mark_visits(pings, ttl_s, slice_us, keep_slice=True),
        ["session_id"],
        ["ts", "seq"],
        by_time("ts", slice_us, "seq"),
        total={"visit": F.col("joined").cast("long")},
    )
    return numbered.groupBy("session_id", "visit").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ping_at"), F.count("*").alias("n_pings")
    )


def activity_feed(joins: DataFrame, kills: DataFrame, kept: int = FEED_KEPT) -> DataFrame:
    """Visitor joins and kill notices as messages, newest first."""
    joined = joins.select(
        "ts", "seq", "flag", F.format_string(JOINED, "country").alias("message")
    )
    killed = kills.select(
        "ts", "seq", "flag", F.format_string(KILLED, "country", "worker").alias("message")
    )
    return recent_window(joined.unionByName(killed), kept, ["ts", "seq", "message"])
