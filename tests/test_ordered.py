"""Ordered columns and quantiles against brute force, with one key holding most rows."""

from datetime import datetime, timedelta
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runledger.functions.clock import HOUR, SECOND, time_slice
from runledger.functions.ordered import Cut, input_bytes, scan, scan_short
from runledger.functions.quantiles import exact_quantiles


def rows(n=600, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rnd.random() < 0.5 else rnd.randint(2, 40)
        out.append((key, datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 6000)), i, rnd.choice([None, 1, 2, 3, 5])))
    return out


def test_scan_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "k long, ts timestamp, seq long, v long")
    got = scan(
        df, ["k"], ["ts", "seq"], time_slice("ts", HOUR),
        prev={"before": F.col("v"), "before_ts": "ts"}, next={"after": F.col("seq"), "after_ts": "ts"}, total={"upto": F.coalesce("v", F.lit(0))},
        known={"last_v": F.col("v")}, whole={"n": F.lit(1)}, first={"start": "ts"},
    ).toPandas()
    want = {}
    for k in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))
        total, known = 0, None
        for i, r in enumerate(group):
            total += r[3] or 0
            known = r[3] if r[3] is not None else known
            want[r[2]] = (
                group[i - 1][3] if i else None, group[i + 1][2] if i + 1 < len(group) else None, total, known, len(group), group[0][1],
                group[i - 1][1] if i else None, group[i + 1][1] if i + 1 < len(group) else None,
            )
    assert len(got) == len(data)

    def plain(x):
        return None if pd.isna(x) else x

    for r in got.itertuples():
        assert (plain(r.before), plain(r.after), r.upto, plain(r.last_v), r.n, r.start, plain(r.before_ts), plain(r.after_ts)) == want[r.seq]


def test_second_scan_reuses_the_slices(spark):
    df = spark.createDataFrame(rows(), "k long, ts timestamp, seq long, v long")
    once = scan(df, ["k"], ["ts", "seq"], time_slice("ts", HOUR), keep_slice=True, prev={"p": F.col("seq")})
    twice = scan(once, ["k"], ["ts", "seq"], F.col("_slice"), total={"n": F.lit(1)})
    assert "_slice" not in twice.columns
    assert twice.agg(F.max("n")).first()[0] == df.where("k = 1").count()


def test_scan_without_keys_crosses_blocks(spark):
    data = [r[1:] for r in rows(400)]  # one-second slices over four days lie in many blocks
    df = spark.createDataFrame(data, "ts timestamp, seq long, v long")
    got = scan(
        df, [], ["ts", "seq"], time_slice("ts", SECOND), prev={"before": F.col("v"), "before_ts": "ts"}, next={"after": F.col("seq")},
        total={"upto": F.col("v")}, known={"last_v": F.col("v")}, whole={"n": F.lit(1)}, first={"start": F.col("seq")},
    ).collect()
    assert len(got) == len(data)
    ordered, known, total = sorted(data), None, None
    want = {}
    for i, (ts, seq, v) in enumerate(ordered):
        known, total = (known, total) if v is None else (v, v + (total or 0))
        last = ordered[i - 1] if i else (None, None, None)
        after = ordered[i + 1][1] if i + 1 < len(ordered) else None
        want[seq] = (last[2], last[0], after, total, known, len(data), ordered[0][1])
    for r in got:
        assert (r.before, r.before_ts, r.after, r.upto, r.last_v, r.n, r.start) == want[r.seq]


def test_scan_without_keys_numbers_all_rows(spark):
    df = spark.range(1000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = scan(df, [], ["h"], F.conv(F.substring("h", 1, 2), 16, 10).cast("long"), total={"n": F.lit(1)}).toPandas()
    assert list(got.sort_values("h")["n"]) == list(range(1, 1001))


def brute_totals(data, keys):
    want, total = {}, {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        key = row[0] if keys else None
        total[key] = total.get(key, 0) + 1
        want[row[2]] = total[key]
    return want


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [25, 10_000])
def test_slices_follow_the_data(spark, keys, limit):
    data = rows(500)
    data += [(1, datetime(2024, 1, 2, 3, 4, 5, 600 + i % 7), 1000 + i, 1) for i in range(300)]  # seven instants hold many rows
    df = spark.createDataFrame(data, "k long, ts timestamp, seq long, v long")
    cut = Cut("ts", HOUR, "seq", rows=limit, least_bytes=0)
    got = scan(df, keys, ["ts", "seq"], cut, total={"n": F.lit(1)}, prev={"before": F.col("seq")}).collect()
    assert {r["seq"]: r["n"] for r in got} == brute_totals(data, keys) and len(got) == len(data)
    placed, at = cut.slices(df, keys)
    sizes = [r["count"] for r in placed.withColumn("s", at).groupBy(*keys, "s").count().collect()]
    assert max(sizes) <= limit
    assert ("_cut" in placed.columns) == (limit < 10_000)
    kept = scan(df, keys, ["ts", "seq"], cut, keep_slice=True, prev={"p": F.col("seq")})
    again = scan(kept, keys, ["ts", "seq"], cut, total={"n": F.lit(1)}).collect()
    assert {r["seq"]: r["n"] for r in again} == brute_totals(data, keys)


def test_slices_of_numbers_follow_the_data(spark):
    data = [(i % 2, None, i, 1) for i in range(4000)]
    df = spark.createDataFrame(data, "k long, ts timestamp, seq long, v long")
    cut = Cut("seq", 10_000, time=False, rows=50, least_bytes=0)
    placed, at = cut.slices(df, ["k"])
    assert placed.withColumn("s", at).groupBy("k", "s").count().agg(F.max("count")).first()[0] <= 50
    got = scan(df, ["k"], ["seq"], cut, total={"n": F.lit(1)}).collect()
    assert all(r["n"] == r["seq"] // 2 + 1 for r in got)


@pytest.mark.parametrize("limit", [25, 10_000])
def test_short_keys_meet_whole_and_long_ones_in_slices(spark, limit):
    data = rows() + [(None, ts, 1000 + i, v) for i, (_, ts, _, v) in enumerate(rows(40, seed=6))]
    data += [(i % 3, None, 2000 + i, i) for i in range(7)]
    df = spark.createDataFrame(data, "k long, ts timestamp, seq long, v long")
    columns = {
        "prev": {"before": F.col("v"), "before_ts": "ts"}, "next": {"after": F.col("seq"), "after_ts": "ts"}, "total": {"upto": F.coalesce("v", F.lit(0))},
        "known": {"last_v": F.col("v")}, "whole": {"n": F.lit(1)}, "first": {"start": "ts"},
    }
    got = scan_short(df, ["k"], ["ts", "seq"], Cut("ts", HOUR, "seq", rows=limit, least_bytes=0), **columns)
    want = scan(df, ["k"], ["ts", "seq"], time_slice("ts", HOUR), **columns)
    assert got.columns == want.columns and got.count() == len(data)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("_slice" in plan) == (limit == 25)  # only then there are long keys


def test_small_input_is_not_counted(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    assert 0 < input_bytes(events) < 1 << 20 and input_bytes(events.join(events, "event_id")) < 1 << 21
    placed, _ = Cut("ts", HOUR, rows=1).slices(events, ["user_id"])
    assert placed is events


def test_a_hot_key_leaves_no_large_task(spark):
    """One key with ten times the rows of an hour: the largest task stays within twice the median."""
    n = 60_000
    hot = spark.range(n).select(
        F.lit(1).cast("long").alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 50_000).alias("ts"), F.col("id").alias("seq")
    )
    cut = Cut("ts", HOUR, "seq", rows=n // 600, least_bytes=0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = scan(hot, ["k"], ["ts", "seq"], cut, total={"n": F.lit(1)})
        sizes = [r["count"] for r in got.where("n > 0").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert got.where("n <> seq + 1").isEmpty()


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.lognormal(0, 2, 500), -rnd.lognormal(0, 1, 100), np.zeros(300), np.full(400, 2.5)])
    keys = rnd.integers(0, 3, len(values))
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": values}))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    for k in range(3):
        v = values[keys == k]
        assert got[k]["n"] == len(v)
        for q, name in [(0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.99, "p99"), (1.0, "p100")]:
            assert abs(got[k][name] - np.quantile(v, q)) < 1e-9
