from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runledger.operators import activity as P
from runledger.operators import datasets as D
from runledger.plans import views as V
from runledger.sources import entities as E
from runledger.sources import exposition as X
from runledger.sources import logs as G

T0 = datetime(2024, 1, 1)


def test_kv_prefixes(spark):
    kv = spark.createDataFrame(
        [
            ("/runledger/runs/a", '{"run_id":"a","state":"RUNNING","metadata":{"x":"1"}}'),
            ("/runledger/runs/ab", '{"run_id":"ab"}'),
            ("/runledger/checkpoints/x", '{"checkpoint_id":"x"}'),
            ("/runledger/workers/a/w1", '{"worker_id":"w1","run_id":"a"}'),
            ("/runledger/workers/ab/w2", '{"worker_id":"w2","run_id":"ab"}'),
        ],
        "key string, value string",
    )
    assert E.read_entities(kv, "runs").count() == 2
    assert [r["metadata"] for r in E.read_entities(kv, "runs", "a").collect()] == [{"x": "1"}]
    assert E.read_entities(kv, "runs", "nope").count() == 0
    assert [r["worker_id"] for r in E.read_entities(kv, "workers", "a").collect()] == ["w1"]
    assert E.read_entities(kv, "workers", "ab", "w2").count() == 1


def test_fields_left_out_are_read_as_their_defaults(spark):
    stored = [
        ("workers/a/w", '{"worker_id": "w", "run_id": "a", "rank": 3, "metadata": {"gpu": {"n": 2}, "ok": true}}'),
        ("checkpoints/c", '{"checkpoint_id": "c", "run_id": "a", "step": 7, "state": null}'),
        ("datasets/d", '{"dataset_id": "d", "uri": "s3://d"}'),
        ("runs/a", '{"run_id": "a", "name": "n", "state": "CREATED", "config": {"name": "n", "num_workers": 2}}'),
        ("runs/b", '{"run_id": "b"}'),
        ("runs/z", "no json"),
    ]
    kv = spark.createDataFrame([(f"{E.ROOT}/{k}", v) for k, v in stored], "key string, value string")
    worker = E.read_entities(kv, "workers").first()
    assert (worker["hostname"], worker["status"], worker["current_step"], worker["last_heartbeat"]) == ("", "ACTIVE", 0, None)
    assert worker["metadata"] == {"gpu": '{"n":2}', "ok": "true"}
    cp = E.read_entities(kv, "checkpoints").first()
    assert (cp["state"], cp["num_shards"], cp["total_bytes"], cp["shard_ids"], cp["metadata"]) == ("PENDING", 0, 0, [], {})
    dataset = E.read_entities(kv, "datasets").first()
    assert (dataset["total_size_bytes"], dataset["num_shards"], dataset["sharding_policy"]) == (0, 0, "RANGE_SHARDING")
    runs = {r["run_id"]: r for r in E.read_entities(kv, "runs").collect()}
    config = runs["a"]["config"]
    assert (config["sharding_policy"], config["checkpoint_interval_steps"], config["max_steps"]) == ("RANGE_SHARDING", 500, None)
    assert runs["b"]["config"] is None and runs["b"]["active_workers"] == 0 and runs[None]["name"] is None
    assert E.read_entities(kv.limit(0), "workers").schema == E.read_entities(kv, "workers").schema


def test_validation_lists_every_rule(spark):
    runs = spark.createDataFrame(
        [("", 0, 0, 0, "NOPE"), ("ok", 1, 500, None, "ROUND_ROBIN"), ("x" * 257, 1, 1, 1, "HASH_SHARDING")],
        "name string, num_workers int, checkpoint_interval_steps int, max_steps long, sharding_policy string",
    )
    ok, bad = E.validate_runs(runs)
    assert [r["name"] for r in ok.collect()] == ["ok"]
    assert sorted(len(r["errors"]) for r in bad.collect()) == [1, 5]


def test_rejected_anchor(spark, medium):
    bad = E.validate_runs(V.runs(spark, medium))[1]
    assert bad.where(F.array_contains("errors", "num_workers not positive")).count() == 300


def test_latest_by_key(spark):
    changes = spark.createDataFrame([("a", 1, "put", 1), ("a", 2, "put", 2), ("b", 1, "put", 3), ("b", 2, "delete", None), ("c", 1, "delete", None)], "k string, n long, op string, v long")
    assert [(r["k"], r["v"]) for r in E.latest_by_key(changes, ["k"], ["n"]).collect()] == [("a", 2)]


def test_exposition_reads_types_labels_and_escapes(spark, tmp_path):
    text = '# HELP a help\n# TYPE a gauge\na{x="1",y="q\\"uo,te}"} 2.5\n# TYPE d summary\nd_sum 7\nd_count 3\n\nfree 1\nb{} +Inf\n'
    (tmp_path / "m.txt").write_text(text)
    got = {r["name"]: r for r in X.read_exposition_files(spark, str(tmp_path)).collect()}
    assert got["a"]["labels"] == {"x": "1", "y": 'q"uo,te}'} and got["a"]["value"] == 2.5 and got["a"]["type"] == "gauge"
    assert (got["d_sum"]["family"], got["d_sum"]["type"], got["d_count"]["value"]) == ("d", "summary", 3.0)
    assert (got["free"]["family"], got["free"]["type"]) == ("free", "untyped")


def test_log_lines_and_files(spark, tmp_path):
    lines = [
        "2024-01-01 10:00:00 [INFO] rank=3 step=50/1000  loss=0.1234  steps/s=4.5",
        "2024-01-01 10:00:01 [INFO] rank=0 Checkpoint saved (runtime): step=50 loss=0.1234 size=99 bytes sha256=abcd time=0.50s",
        "2024-01-01 10:00:02 [INFO] rank=1 Restored from runtime checkpoint: checkpoint_id=ck-1 step=40 size=99 bytes time=0.25s",
        "2024-01-01 10:00:02 [INFO] rank=1 Checkpoint saved (local): checkpoint_step5_rank1.pt (step=5, loss=0.5000)",
        "no layout at all step=3",
    ]
    (tmp_path / "worker-0.log").write_text("\n".join(lines))
    read = G.read_log_lines(spark, str(tmp_path))
    assert {r["source"] for r in read.collect()} == {"worker-0"}
    rows = G.parse_training_logs(read).collect()
    assert [r["kind"] for r in rows] == ["step", "saved", "restored", "saved", "other"]
    assert (rows[0]["rank"], rows[0]["step"], rows[0]["total_steps"], rows[0]["loss"], rows[0]["steps_per_s"]) == (3, 50, 1000, 0.1234, 4.5)
    assert (rows[1]["size_bytes"], rows[1]["sha256"], rows[1]["time_s"]) == (99, "abcd", 0.5)
    assert (rows[2]["checkpoint_id"], rows[2]["step"], rows[2]["time_s"]) == ("ck-1", 40, 0.25)
    assert (rows[3]["step"], rows[3]["loss"]) == (5, 0.5)
    assert rows[4]["step"] is None and rows[4]["level"] is None


def test_event_frames_from_file(spark, tmp_path):
    (tmp_path / "e.txt").write_text('event: run_started\ndata: {"run_id": "r1", "n": 1}\n\nevent: other\ndata: {"run_id": "r2"}\n\n')
    got = [(r["event_type"], r["run_id"], r["payload"]) for r in G.read_event_frames(spark, str(tmp_path)).collect()]
    assert got == [("run_started", "r1", '{"run_id": "r1", "n": 1}'), ("other", "r2", '{"run_id": "r2"}')]


def test_highlights_respect_case(spark):
    lines = spark.createDataFrame([("CHECKPOINT x Committed",), ("run FAILED",), ("run failed",), ("step=3 loss=1",), ("Step=3 loss=1",), ("Restored From Checkpoint",)], "line string")
    assert [r["highlighted"] for r in P.highlight_logs(lines).collect()] == [True, True, False, True, False, True]


def test_geo(spark):
    addresses = spark.createDataFrame([("127.0.0.1",), ("172.99.0.1",), ("8.8.8.8",), ("9.9.9.9",), ("7.7.7.7",)], "address string")
    dim = spark.createDataFrame([("8.8.8.8", "Chile", "cl"), ("7.7.7.7", "Nowhere", "")], "address string, country string, country_code string")
    got = {r["address"]: (r["country"], r["country_code"], r["flag"]) for r in P.enrich_geo(addresses, dim).collect()}
    assert got["127.0.0.1"] == got["172.99.0.1"] == ("Local", "", P.LAPTOP)
    assert got["8.8.8.8"] == ("Chile", "cl", "\U0001f1e8\U0001f1f1")
    assert got["9.9.9.9"] == ("Unknown", "", P.GLOBE) and got["7.7.7.7"] == ("Nowhere", "", P.GLOBE)
    first = spark.range(1).select(P.client_address(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("9.9.9.9")), P.client_address(F.lit(""), F.lit(None).cast("string"))).first()
    assert tuple(first) == ("1.2.3.4", "0.0.0.0")


def test_visits_and_presence(spark):
    pings = spark.createDataFrame([("s", T0 + timedelta(seconds=t), t) for t in (0, 45, 91, 100)], "session_id string, ts timestamp, seq long")
    visits = P.visit_sessions(pings, 45).orderBy("visit").collect()
    assert [(v["visit"], v["n_pings"]) for v in visits] == [(1, 2), (2, 2)]
    now = F.lit(T0 + timedelta(seconds=145)).cast("timestamp")
    assert P.present_visitors(pings, now, 45).count() == 1 and P.present_visitors(pings, now, 44).count() == 0


def test_sharding_policies(spark):
    df = spark.range(10, 110).withColumnRenamed("id", "key")
    counts = {p: sorted(r["n_rows"] for r in D.shard_sizes(D.assign_shards(df.withColumn("b", F.lit(1)), 7, p, "key"), "b").collect()) for p in D.SHARDING_POLICIES}
    assert counts["FULL_REPLICATION"] == [100] * 7
    assert max(counts["RANGE_SHARDING"]) - min(counts["RANGE_SHARDING"]) <= 1 and sum(counts["ROUND_ROBIN"]) == 100
    ranges = D.assign_shards(df, 7, "RANGE_SHARDING", "key").orderBy("key").collect()
    assert [r["shard"] for r in ranges] == sorted(r["shard"] for r in ranges)
    parts = [D.dataset_slice(df, "key", i, 7).collect() for i in range(7)]
    assert sorted(r["key"] for p in parts for r in p) == list(range(10, 110)) and all(sum(r["is_last"] for r in p) == 1 for p in parts)
    page = D.dataset_slice(df, "key", 0, 7, offset=2, limit=3).orderBy("position").collect()
    assert [r["position"] for r in page] == [2, 3, 4] and not page[-1]["is_last"]


def test_batches(spark):
    df = spark.range(105).withColumnRenamed("id", "key")
    a = D.make_batches(df, "key", 10, seed=1)
    assert a.count() == 100 and a.groupBy("batch").count().where("count <> 10").count() == 0
    assert D.make_batches(df, "key", 10, seed=1, drop_last=False).count() == 105
    one = {r["key"]: r["batch"] for r in a.collect()}
    assert one == {r["key"]: r["batch"] for r in D.make_batches(df.repartition(5), "key", 10, seed=1).collect()}
    assert one != {r["key"]: r["batch"] for r in D.make_batches(df, "key", 10, seed=2).collect()}


def test_loss_curve_leaves_out_the_open_block(spark):
    steps = spark.createDataFrame([(1, i, float(i), T0 + timedelta(seconds=i)) for i in range(1, 121)], "run_id long, step long, loss double, ts timestamp")
    rows = D.loss_curve(steps).orderBy("step").collect()
    assert [(r["step"], r["mean_loss"]) for r in rows] == [(50, 25.5), (100, 75.5)]


def test_register_datasets_defaults(spark):
    req = spark.createDataFrame([("ds-001", "s3://b/x", None, None), (None, None, "CUSTOM", None)], "dataset_id string, uri string, sharding_policy string, metadata map<string,string>")
    ok, bad = D.register_datasets(req)
    row = ok.first()
    assert (row["dataset_id"], row["uri"], row["sharding_policy"], row["metadata"]) == ("ds-001", "s3://b/x", "RANGE_SHARDING", {})
    assert bad.count() == 1
