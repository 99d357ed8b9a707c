"""Streams fed several files must end with the rows of their batch twins."""

import glob
import os
import random
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.operators import activity as P
from runledger.operators import alerts as A
from runledger.operators import lifecycle as L
from runledger.operators import metrics as M
from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.plans.alert_queries import RATIO_RULE
from runledger.sources import entities as E
from runledger.streaming import operators as S
from runledger.streaming.runner import closed, read_batches, run_batches, run_to_end, table_stream

HOURS = 3600


@pytest.fixture(scope="module")
def feed(spark, small, tmp_path_factory):
    """The events in four files by time, the last three days being a closing file."""
    import os
    import shutil

    folder = tmp_path_factory.mktemp("feed")
    events = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").toPandas()
    cut = len(events) // 4
    for i in range(4):
        part = events.iloc[i * cut : (i + 1) * cut if i < 3 else None]
        spark.createDataFrame(part, schema=spark.read.parquet(f"{small}/events.parquet").schema).coalesce(1).write.parquet(f"{folder}/p{i}")
        name = [n for n in os.listdir(f"{folder}/p{i}") if n.endswith(".parquet")][0]
        shutil.copy(f"{folder}/p{i}/{name}", f"{folder}/events{i}.parquet")
    shutil.copy(f"{small}/events.parquet", tmp_path_factory.mktemp("whole") / "events.parquet")
    return str(folder)


def stream(spark, feed, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(feed)
    return V.as_instants(raw)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def watermark(spark, small, hours=1):
    newest = V.events(spark, small).agg((F.max(F.unix_millis("ts")) - hours * HOURS * 1000).alias("w")).first()["w"]
    return F.timestamp_millis(F.lit(newest))


def test_outages(spark, feed, small):
    dead = 24 * HOURS
    got = run_to_end(S.stream_outages(V.heartbeats_of(stream(spark, feed, small)), dead))
    want = W.deaths_until(V.heartbeats(spark, small), dead, watermark(spark, small))
    assert rows(got, "worker_id", "last_seen") == rows(want, "worker_id", "last_seen")


def deal(spark, df, folder, n, order=None):
    """A stream over a table dealt to ``n`` files at random, or cut by ``order``, one file a batch; then a row of the end of time."""
    ts = next(f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType))
    rnd, data = random.Random(3), df.collect()
    if order:
        data.sort(key=lambda r: tuple(r[c] for c in order))
    parts = [[] for _ in range(n)]
    for i, row in enumerate(data):
        parts[i * n // len(data) if order else rnd.randrange(n)].append(row)
    last = tuple(datetime(9999, 12, 31) if f.name == ts else None for f in df.schema.fields)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    folder.mkdir(parents=True)
    for i, part in enumerate([*parts, [last]]):
        spark.createDataFrame([tuple(r) for r in part], schema).coalesce(1).write.parquet(str(folder / f"made{i}"))
        target = folder / f"part{i}.parquet"
        shutil.copy(glob.glob(str(folder / f"made{i}" / "*.parquet"))[0], target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*").parquet(str(folder))


def test_replay_of_shuffled_batches_is_the_batch_replay(spark, small, tmp_path):
    events = V.state_events(spark, small)
    columns = ["run_id", "seq", "from_state", "to_state", "accepted"]
    want = rows(L.replay_transitions(events), *columns)
    found, progress = [], []
    for name, n, order, delay in (("shuffled", 4, None, "60 days"), ("ordered", 5, ["ts", "seq"], "1 hour")):
        got = run_to_end(S.stream_replay(deal(spark, events, tmp_path / name, n, order), delay), progress=progress)
        found.append(rows(got.where("not late"), *columns))
        assert got.where("late").isEmpty()
    assert found == [want, want]


def test_late_requests_are_reported_and_change_nothing(spark, small, tmp_path):
    events = V.state_events(spark, small)
    got = run_to_end(S.stream_replay(deal(spark, events, tmp_path / "late", 4), "1 hour"))
    late = {r["seq"] for r in got.where("late").collect()}
    assert 100 < len(late) < events.count() and got.count() == events.count()
    on_time = events.where(~F.col("seq").isin(list(late)))
    columns = ["run_id", "seq", "from_state", "to_state", "accepted"]
    assert rows(got.where("not late"), *columns) == rows(L.replay_transitions(on_time), *columns)
    assert got.where("late and (accepted is not null or from_state is not null)").isEmpty()


def test_alerts_over_shuffled_ticks(spark, small, tmp_path):
    ops = V.op_log(spark, small).withColumn("status", F.when(F.col("level") == 3, "error").otherwise("success"))
    ticks = A.evaluate_rules(A.labelled(M.error_ratio(ops, ["method"], 6 * HOURS, HOURS), "error_ratio", "method"), [RATIO_RULE])
    ticks = ticks.select("rule", "labels", "tick", "value", "cond", "hold_s")
    got = run_to_end(S.stream_alerts(deal(spark, ticks, tmp_path / "ticks", 4), HOURS, "60 days"))
    none = F.lit("1970-01-01").cast("timestamp")
    columns = ["rule", "labels", "tick", "cond", F.coalesce("active_since", none), "state"]
    assert got.where("late").isEmpty()
    assert rows(got, *columns) == rows(A.hold_for(ticks, HOURS), *columns)


def test_latest(spark, feed, small):
    def changes(events):
        op = F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op")
        return events.select("user_id", "ts", "event_id", "value", op)

    latest = S.stream_latest(changes(stream(spark, feed, small)), ["user_id"], ["ts", "event_id"])
    out = run_batches(latest, S.latest_sink(latest.schema, ["user_id"], every=2), mode="update")
    got = S.read_latest(spark, out, latest.schema, ["user_id"])
    want = E.latest_by_key(changes(V.events(spark, small)), ["user_id"], ["ts", "event_id"])
    assert rows(got, "user_id", "event_id") == rows(want, "user_id", "event_id")


def test_presence(spark, feed, small):
    ttl = 6 * HOURS
    pings = stream(spark, feed, small).select(F.col("user_id").alias("session_id"), "ts")
    got = run_to_end(S.stream_presence(pings, ttl))
    closed = P.visit_sessions(V.pings(spark, small), ttl).where(
        F.timestamp_micros(F.unix_micros("last_ping_at") + ttl * 1_000_000 + 1) <= watermark(spark, small)
    )
    columns = ["session_id", "started_at", "last_ping_at", "n_pings"]
    assert rows(got, *columns) == rows(closed, *columns)


def test_rates_and_alerts(spark, feed, small):
    ops = V.op_log_of(stream(spark, feed, small)).withColumn("status", F.when(F.col("level") == 3, "error").otherwise("success"))
    rates = run_to_end(S.stream_rates(ops, ["method"], "6 hours", "1 hour"))
    batch = V.op_log(spark, small).withColumn("status", F.when(F.col("level") == 3, "error").otherwise("success"))
    want = M.error_ratio(batch, ["method"], 6 * HOURS, HOURS).where(F.col("tick") <= watermark(spark, small))
    columns = ["method", "tick", "errors", "total"]
    assert rows(rates, *columns) == rows(want, *columns)

    rules = [RATIO_RULE]
    held = A.hold_for(A.evaluate_rules(A.labelled(want, "error_ratio", "method"), rules), HOURS)
    source = spark.readStream.schema(rates.schema).parquet(rates.inputFiles()[0].rsplit("/", 1)[0])
    conditions = A.evaluate_rules(A.labelled(source, "error_ratio", "method"), rules).drop("severity", "summary")
    live = run_to_end(S.stream_alerts(closed(conditions, "tick"), HOURS))

    def states(df):
        return rows(df, "labels", "tick", "cond", F.coalesce("active_since", F.lit("1970-01-01").cast("timestamp")), "state")

    assert states(live) == states(held)


def test_histogram_windows(spark, feed, small):
    got = run_to_end(S.stream_histogram(V.op_log_of(stream(spark, feed, small)), ["method"], [0.5, 1.0, 5.0], 0.5, "6 hours"))
    want = M.windowed_quantile(V.op_log(spark, small), 0.5, [0.5, 1.0, 5.0], ["method"], 6 * HOURS, 6 * HOURS).where(
        F.col("tick") <= watermark(spark, small)
    )
    assert rows(got, "method", "tick", "value") == rows(want, "method", "tick", "value")


def test_logs(spark, feed, small):
    got = run_to_end(S.stream_logs(V.log_lines_of(stream(spark, feed, small))))
    assert rows(got, "seq", "kind", "highlighted") == rows(S.stream_logs(V.log_lines_of(V.events(spark, small))), "seq", "kind", "highlighted")


def test_commit_over_batches_counts_each_shard_once(spark, tmp_path):
    schema = "checkpoint_id long, shard_id string, rank int, size_bytes long, uploaded_at timestamp, part_no long, host_no long"
    stamp = "2024-01-01 00:00:0{}"
    batches = [
        [(1, "a", 1, 10, 1), (1, "a", 1, 10, 2), (2, "a", 1, 5, 1)],
        [(1, "b", 2, 20, 3), (2, "a", 1, 6, 4)],
        [(1, "c", 3, 30, 5), (2, "b", 2, 7, 6), (3, "a", 1, 1, 7), (3, "b", 2, 2, 8), (3, "c", 3, 4, 9)],
    ]
    for i, rows_ in enumerate(batches):
        df = spark.createDataFrame([(c, s, r, z, stamp.format(t), 0, 0) for c, s, r, z, t in rows_], schema.replace("uploaded_at timestamp", "uploaded_at string"))
        df.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    import glob
    import os
    import shutil

    source = tmp_path / "source"
    source.mkdir()
    for i in range(3):
        target = source / f"part{i}.parquet"
        shutil.copy(glob.glob(str(tmp_path / f"in{i}" / "*.parquet"))[0], target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    shards = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = run_batches(S.stream_commits(shards, 2), S.commit_batch)
    found = S.read_commits(spark, out)
    got = found.where("kind = 'manifest'")
    assert rows(got, "checkpoint_id", "num_shards", "total_bytes", "listed", "batch_id") == [
        (1, 2, 30, "a:10,b:20", 1), (2, 2, 12, "a:5,b:7", 2), (3, 3, 7, "a:1,b:2,c:4", 2),
    ]
    late = found.where("kind = 'late'")
    assert [(r["checkpoint_id"], r["shard_id"]) for r in late.collect()] == [(1, "c")]


def files_in_turn(spark, folder, schema, batches):
    """A stream that reads one batch of rows after another."""
    folder.mkdir(parents=True)
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"made{i}"))
        target = folder / f"part{i}.parquet"
        shutil.copy(glob.glob(str(folder / f"made{i}" / "*.parquet"))[0], target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*").parquet(str(folder))


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_state_of_commits_is_dropped_and_late_uploads_are_still_reported(spark, tmp_path):
    schema = "checkpoint_id long, shard_id string, rank int, size_bytes long, uploaded_at timestamp, part_no long, host_no long"
    at = datetime(2024, 1, 1)
    batches = [[(10 * i + c, s, 1, 10, at, 0, 0) for c in range(10) for s in "ab"] for i in range(6)]
    batches[0] += [(1000, "a", 1, 1, at, 0, 0)]  # stays open
    batches[5] += [(3, "z", 1, 1, at, 0, 0)]  # long after its commit
    batches += [[(2000 + i, s, 1, 10, at, 0, 0) for s in "ab"] for i in range(4)]
    progress: list = []
    stream = files_in_turn(spark, tmp_path / "in", schema, batches)
    out = run_batches(S.stream_commits(stream, 2, keep_s=0.001), S.commit_batch, progress=progress)
    found = S.read_commits(spark, out)
    assert found.where("kind = 'manifest'").count() == 64
    assert rows(found.where("kind <> 'manifest'"), "kind", "checkpoint_id", "shard_id") == [("late", 3, "z"), ("open", 1000, "a")]
    held = state_rows(progress)
    assert max(held[3:]) < 2 * max(held[:3]) and held[-1] < max(held) / 4, held


def test_late_uploads_within_the_delay_are_reported_at_once(spark, tmp_path):
    schema = "checkpoint_id long, shard_id string, rank int, size_bytes long, uploaded_at timestamp, part_no long, host_no long"
    at = datetime(2024, 1, 1)
    stream = files_in_turn(spark, tmp_path / "in", schema, [[(1, "a", 1, 1, at, 0, 0)], [(1, None, 1, 1, None, None, 0)], [(1, "c", 1, 1, at, 0, 0), (1, "c", 1, 1, at, 0, 0)]])
    found = S.read_commits(spark, run_batches(S.stream_commits(stream, 1), S.commit_batch))
    assert sorted(map(str, rows(found, "batch_id", "kind", "shard_id"))) == ["(0, 'manifest', None)", "(1, 'late', None)", "(2, 'late', 'c')", "(2, 'late', 'c')"]


def test_keys_forgotten_by_state_are_found_in_storage(spark, tmp_path):
    store = tmp_path / "store"

    def arriving(folder):
        for i in range(8):
            path = tmp_path / folder / f"up{i}" / "r" / "c" / "rank-0"
            path.parent.mkdir(parents=True)
            path.write_bytes(b"same" if i % 4 == 1 else b"own%d" % i)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        return S.payload_files(spark, str(tmp_path / folder), max_files=1)

    def store_them(batch, batch_id, out):
        S.upload_sink(S.stored_below(str(store)))(batch, batch_id, out)
        for r in read_batches(spark, out, S.UPLOAD_SCHEMA).where(f"batch_id = {batch_id} and kind = 'shard'").collect():
            (store / r["key"]).parent.mkdir(parents=True, exist_ok=True)
            (store / r["key"]).write_bytes(b"")
        time.sleep(0.01)

    progress: list = []
    out = run_batches(S.stream_uploads(arriving("a"), keep_s=0.001), store_them, progress=progress)
    shards = read_batches(spark, out, S.UPLOAD_SCHEMA).where("kind = 'shard'")
    assert shards.count() == shards.select("key").distinct().count() == 7
    assert max(state_rows(progress)) <= 12
    known = spark.createDataFrame(shards.collect())
    out = run_batches(S.stream_uploads(arriving("b")), S.upload_sink(S.stored_in(known)))
    assert read_batches(spark, out, S.UPLOAD_SCHEMA).where("kind = 'shard'").isEmpty()


def test_snapshots_stand_for_old_folders(spark, tmp_path):
    schema = "id long, v string, op string"
    out, kept = str(tmp_path / "out"), {}
    sink = S.latest_sink(spark.createDataFrame([], schema).schema, ["id"], every=3)
    rnd = random.Random(1)
    for batch in range(11):
        changes = {rnd.randrange(12): (f"{batch}", rnd.choice(["put", "put", "delete"])) for _ in range(5)}
        df = spark.createDataFrame([(k, v, op) for k, (v, op) in changes.items()], schema)
        sink(df, batch, out)
        for k, (v, op) in changes.items():
            kept.pop(k, None)
            if op == "put":
                kept[k] = v
        got = S.read_latest(spark, out, df.schema, ["id"])
        assert {r["id"]: r["v"] for r in got.collect()} == kept
        read = {f.split("/")[-2] for f in got.inputFiles()}
        assert read <= {f"snapshot={(batch + 1) // 3 * 3 - 1}", *[f"batch_id={b}" for b in range((batch + 1) // 3 * 3, batch + 1)]}
    assert not os.path.exists(f"{out}/batch_id=0") and not os.path.exists(f"{out}/snapshot=2")
    # a snapshot that was not published doesn't count
    spark.createDataFrame([(99, "x")], "id long, v string").write.parquet(f"{out}/snapshot=10")
    assert {r["id"] for r in S.read_latest(spark, out, df.schema, ["id"]).collect()} == set(kept)
    assert S.compact_latest(spark, out, df.schema, ["id"]) == 10 == S.compact_latest(spark, out, df.schema, ["id"])
    assert {r["id"]: r["v"] for r in S.read_latest(spark, out, df.schema, ["id"]).collect()} == kept


def test_digest_files_skip_known_keys(spark, tmp_path):
    arriving = [("x", "rank-0", b"abc"), ("x", "rank-1", b"abd"), ("y", "rank-0", b"abc"), ("y", "rank-1", b"abe")]
    for i, (top, name, data) in enumerate(arriving):
        path = tmp_path / top / "r" / "c" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    out = run_batches(S.stream_uploads(S.payload_files(spark, str(tmp_path), max_files=1)), S.upload_batch)
    got = read_batches(spark, out, S.UPLOAD_SCHEMA)
    kinds = [sorted(r["kind"] for r in got.where(f"batch_id = {i}").collect()) for i in range(4)]
    both = ["checksum", "shard"]
    assert kinds == [both, both, ["checksum"], both]


def test_run_events_and_table_stream(spark, small):
    events = table_stream(spark, small, "events")
    assert isinstance(events.schema["ts"].dataType, T.TimestampType) and events.isStreaming


def test_commits_share_buckets_and_unknown_numbers_stay_whole(spark, tmp_path):
    schema = "checkpoint_id long, shard_id string, rank int, size_bytes long, uploaded_at timestamp, part_no long, host_no long"
    at = [datetime(2024, 1, 1, 0, 0, s) for s in range(3)]
    big = 9_007_199_254_740_993  # beyond what floating point holds
    batches = [
        [(c, "a", 1, big, at[1], 0, 0) for c in range(40)] + [(None, "a", 1, None, at[0], 0, 0), (50, "a", 1, None, None, None, None)],
        [(c, s, 1, 5, at[0], 0, 0) for c in range(40) for s in ("a", "b") if c % 4] + [(50, "b", 2, 7, at[2], 0, 0), (50, "a", 1, 9, at[2], 0, 0)],
        [(c, "b", 1, big, at[2], 0, 0) for c in range(40)] + [(None, None, None, 1, at[0], 0, 0)],
    ]
    progress: list = []
    stream = files_in_turn(spark, tmp_path / "in", schema, batches)
    out = run_batches(S.stream_commits(stream, 2, buckets=3), S.commit_batch, progress=progress)
    got = {(r["checkpoint_id"], r["kind"], r["batch_id"], r["num_shards"], r["total_bytes"], r["listed"], r["shard_id"]) for r in S.read_commits(spark, out).collect()}
    assert got == {
        *[(c, "manifest", 1, 2, 10, "a:5,b:5", None) for c in range(40) if c % 4],
        *[(c, "late", 2, None, None, None, "b") for c in range(40) if c % 4],
        *[(c, "manifest", 2, 2, 2 * big, f"a:{big},b:{big}", None) for c in range(0, 40, 4)],
        (50, "manifest", 1, 2, 7, "a,b:7", None),
        (None, "manifest", 2, 2, 1, "1,a", None),
    }
    # a group to Python is a bucket, not a checkpoint: what is registered per group is one timer a bucket and batch
    assert progress[0]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] == 3
