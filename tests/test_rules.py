"""Rules of the data model that the sample tables do not reach."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger.functions.ordered import scan
from runledger.functions.quantiles import exact_quantiles
from runledger.operators import alerts as A
from runledger.operators import checkpoints as C
from runledger.operators import datasets as D
from runledger.operators import integrity as I
from runledger.operators import lifecycle as L
from runledger.operators import metrics as M
from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.schemas import COMMIT_BOUNDS, SHARD_BOUNDS
from runledger.sources import exposition, logs, manifests, objects

T0 = datetime(2024, 1, 1)


def test_null_keys_meet_across_slices(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 100, 7), ("a", 1, 1)], "k string, ts int, v int")
    got = {(r["k"], r["ts"]): r for r in scan(
        df, ["k"], ["ts"], F.floor(F.col("ts") / 10), prev={"p": F.col("v")}, next={"n": F.col("v")}, total={"t": F.col("v")},
        known={"s": F.when(F.col("v") == 5, 5)}, whole={"w": F.col("v")}, first={"f": F.col("v")},
    ).collect()}
    r = got[(None, 100)]
    assert (r["p"], r["n"], r["t"], r["s"], r["w"], r["f"]) == (5, None, 12, 5, 12, 5)
    assert got[(None, 1)]["n"] == 7 and got[("a", 1)]["w"] == 1
    kept = scan(df, ["k"], ["ts"], F.floor(F.col("ts") / 10), keep_slice=True, total={"t": F.col("v")})
    assert "_key" not in scan(kept, ["k"], ["ts"], F.lit(0), total={"u": F.col("t")}).columns
    q = exact_quantiles(df.select("k", F.col("v").cast("double").alias("v")), ["k"], "v", (0.5,))
    assert {r["k"]: r["p50"] for r in q.collect()} == {None: 6.0, "a": 1.0}


def test_thresholds_compute_what_rules_name_and_pass_nothing_unknown(spark):
    samples = spark.range(100).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("value"))
    rules = [("m", "p(90)<1"), ("m", "p(90)<=90"), ("m", "med<49.5"), ("m", "med<=49.5"), ("m", "max>98"), ("m", "speed<1"),
             ("m", "p(95)<x"), ("m", "p(101)<5"), ("other", "avg<3"), ("m", "min==0"), ("m", "min!=0")]
    got = {(r["metric"], r["rule"]): (r["passed"], r["verdict"]) for r in M.check_thresholds(samples, spark.createDataFrame(rules, "metric string, rule string")).collect()}
    want = ["exceeded", "ok", "exceeded", "ok", "ok", "unknown_rule", "unknown_rule", "unknown_rule", "no_data", "ok", "exceeded"]
    assert [got[r] for r in rules] == [(v == "ok", v) for v in want]


def test_unknown_label_operator(spark):
    with pytest.raises(ValueError):
        M.label_match(spark.createDataFrame([("x",)], "l string"), [("l", "~", "x")])


def test_history_never_leaves_a_terminal_state(spark, small):
    history = L.accepted_changes(V.state_events(spark, small))
    assert L.transition_matrix(history).where(F.col("from_state").isin("COMPLETED", "CANCELLED")).count() == 0
    odd = spark.createDataFrame([(1, "2024-01-01", 1, "PAUSED")], "run_id long, ts string, seq long, to_state string")
    assert L.transition_matrix(odd.withColumn("ts", F.col("ts").cast("timestamp"))).first()["other"] == 1


def test_log_lines_with_odd_numbers(spark):
    head = "2024-01-01 00:00:00 [INFO] rank={} "
    lines = [
        head.format(0) + "step=1/10  loss=1e-05  steps/s=2.5", head.format(0) + "step=1/10  loss=-0.5  steps/s=2",
        head.format(0) + "step=1/10  loss=1.2.3  steps/s=2", head.format("99999999999") + "step=2/10  loss=1  steps/s=1",
    ]
    got = logs.parse_training_logs(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["kind"], r["loss"]) for r in got] == [("step", 1e-05), ("step", -0.5), ("other", None), ("step", 1.0)]
    assert got[3]["rank"] is None


def test_exposition_lines(spark):
    lines = ["# TYPE x", "# TYPE f counter", "# TYPE f gauge", r'f{p="C:\\new\n\"q\""} 1', "f 2"]
    got = exposition.read_exposition(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(got) == 2 and {r["type"] for r in got} == {"counter"}
    assert [r["labels"]["p"] for r in got if r["labels"]] == ['C:\\new\n"q"']


def test_manifest_parts_are_read_and_kept(spark, tmp_path):
    shards = spark.createDataFrame(
        [("run-a", "c1", 7, f"rank-{r}", r, 10, "aa", f"k{r}") for r in (0, 1, 20_000)],
        "run_id string, checkpoint_id string, step long, shard_id string, rank long, size_bytes long, sha256 string, storage_key string",
    )
    made = manifests.commit_manifests(shards, shards.limit(0), part_shards=2)
    assert sorted(r["part"] for r in made.collect()) == [0, 1]
    for r in manifests.manifest_documents(made, "2024-01-01T00:00:00Z").collect():
        path = tmp_path / r["key"]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(r["value"])
    (tmp_path / "run-a/c1/rank-0.bin").write_bytes(b"x")
    back = manifests.explode_shards(manifests.read_manifests(spark, str(tmp_path)))
    assert sorted(r["shard_id"] for r in back.collect()) == ["rank-0", "rank-1", "rank-20000"]
    listed = objects.list_objects(spark, str(tmp_path))
    kinds = {r["key"]: r["kind"] for r in objects.object_parts(listed).collect()}
    assert kinds == {"run-a/c1/_manifest.json": "manifest", "run-a/c1/_manifest-1.json": "manifest", "run-a/c1/rank-0.bin": "shard"}
    assert C.plan_orphan_gc(listed).count() == 0
    aborted = spark.createDataFrame([("run-a", "c1")], "run_id string, checkpoint_id string")
    assert [r["key"] for r in C.plan_abort(listed, aborted).collect()] == ["run-a/c1/rank-0.bin"]


def test_sidecars_without_object_or_entry_are_reported(spark):
    one = "checkpoint_id string, shard_id string, "
    stored, listed = spark.createDataFrame([], one + "payload binary"), spark.createDataFrame([], one + "sha256 string, size_bytes long")
    got = I.verify_shards(stored, listed, spark.createDataFrame([("c", "s", "x")], one + "sha256 string")).collect()
    assert [r["status"] for r in got] == ["orphan_sidecar"]


def test_lags_join_by_run_and_worker(spark):
    workers = spark.createDataFrame([(1, 7), (2, 7)], "run_id long, worker_id long")
    lags = spark.createDataFrame([(1, 7, 3.0), (2, 7, 4.0)], "run_id long, worker_id long, lag_s double")
    assert sorted((r["run_id"], r["lag_s"]) for r in W.worker_lag_join(workers, lags).collect()) == [(1, 3.0), (2, 4.0)]


@pytest.mark.parametrize("per_block", [1, 4, 4096])
def test_ordinals_across_slices_and_blocks_with_nulls(spark, monkeypatch, per_block):
    monkeypatch.setattr(D, "SLICES_PER_BLOCK", per_block)
    keys = [None, None, *range(-30, 70, 3), 500, 501]
    df = spark.createDataFrame([(k, "x") for k in keys], "key long, _b string")
    got = D.global_ordinal(df, ["key"], D.key_slice("key", 4)).collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["ordinal"])] == keys
    assert sorted(r["ordinal"] for r in got) == list(range(len(keys))) and {r["n_rows"] for r in got} == {len(keys)}
    assert D.global_ordinal(df.limit(0), ["key"], D.key_slice("key", 4)).count() == 0


def test_operation_series_equal_their_single_forms_in_one_scan(spark, tmp_path):
    rnd = random.Random(3)
    rows = [
        (T0 + timedelta(seconds=rnd.randint(0, 900)), rnd.choice(["write", "read", "commit", "abort", "list", None]),
         rnd.choice(["success", "success", "error", None]), rnd.choice([None, 0.003, 0.4, 3.0, 7.0, 60.0]))
        for _ in range(300)
    ]
    spark.createDataFrame(rows, "ts timestamp, method string, status string, duration_s double").write.parquet(f"{tmp_path}/ops")
    ops = spark.read.parquet(f"{tmp_path}/ops")
    of = lambda m: ops.where(F.col("method") == m)
    parts = [
        A.labelled(M.windowed_quantile(of("write"), 0.99, SHARD_BOUNDS), "shard_write_p99"),
        A.labelled(M.windowed_quantile(of("read"), 0.99, SHARD_BOUNDS), "shard_read_p99"),
        A.labelled(M.windowed_quantile(of("commit"), 0.99, COMMIT_BOUNDS), "commit_p99"),
        *[A.labelled(M.error_ratio(of(m)), f"{n}_error_ratio") for m, n in (("commit", "commit"), ("write", "shard_write"), ("read", "shard_read"))],
        A.labelled(M.operation_rate(of("abort")), "abort_rate"),
        A.labelled(M.error_ratio(ops), "grpc_error_ratio"),
        A.labelled(M.operation_rate(ops.where("status = 'error'"), ["method", "status"]), "grpc_error_rate", "method", "status"),
    ]
    want = sorted((tuple(map(str, r)) for part in parts for r in part.collect()))
    series = A.operation_series(ops)
    assert sorted(tuple(map(str, r)) for r in series.select("series", "labels", "tick", "value").collect()) == want
    assert series._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
