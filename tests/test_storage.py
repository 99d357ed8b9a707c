"""Checkpoints, objects, payloads and manifests."""

from datetime import datetime, timedelta, timezone
import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.operators import checkpoints as C
from runledger.operators import integrity as I
from runledger.operators import workers as W
from runledger.plans import views as V
from runledger.sources import manifests as M
from runledger.sources import objects as O

T0 = datetime(2024, 1, 1)


def test_sha256_vectors(spark):
    df = spark.createDataFrame([(b"",), (b"hello world",)], "payload binary")
    got = [(r["sha256"], r["n_bytes"]) for r in I.add_digest(df).collect()]
    assert got[0] == ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 0)
    assert got[1] == ("b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9", 11)


def test_chunks_round_trip(spark):
    payloads = [("c", "s1", bytes(range(256)) * 8), ("c", "s2", b"x"), ("c", "s3", b""), ("c", "s4", b"y" * 1024)]
    df = spark.createDataFrame(payloads, "checkpoint_id string, shard_id string, payload binary")
    chunks = I.chunk_payload(df, size=1024)
    by_shard = {s: chunks.where(F.col("shard_id") == s).orderBy("offset").collect() for s in ("s1", "s2", "s3", "s4")}
    assert [(r["offset"], len(r["data"]), r["is_last"]) for r in by_shard["s1"]] == [(0, 1024, False), (1024, 1024, True)]
    assert len(by_shard["s2"]) == 1 and by_shard["s3"] == [] and len(by_shard["s4"]) == 1
    whole = {r["shard_id"]: r for r in I.assemble_chunks(chunks.repartition(3)).collect()}
    assert bytes(whole["s1"]["payload"]) == payloads[0][2] and whole["s1"]["total_bytes"] == 2048
    pieces = I.assemble_chunks(chunks, max_bytes=1024).orderBy("shard_id", "piece").collect()
    assert [(r["shard_id"], r["piece"], r["total_bytes"], r["n_chunks"]) for r in pieces] == [
        ("s1", 0, 2048, 2), ("s1", 1, 2048, 2), ("s2", 0, 1, 1), ("s4", 0, 1024, 1)
    ]
    assert b"".join(bytes(r["payload"]) for r in pieces if r["shard_id"] == "s1") == payloads[0][2]


def test_chunk_sequence_verdicts(spark):
    rows = [
        ("ok", 0, 10, False), ("ok", 10, 5, True),
        ("gap", 0, 10, False), ("gap", 20, 5, True),
        ("overlap", 0, 10, False), ("overlap", 8, 5, True),
        ("start", 10, 5, True),
        ("nolast", 0, 10, False),
        ("two", 0, 10, True), ("two", 10, 5, True),
        ("early", 0, 10, True), ("early", 10, 5, False),
    ]
    df = spark.createDataFrame([("c", *r) for r in rows], "checkpoint_id string, shard_id string, offset long, n_bytes long, is_last boolean")
    got = {r["shard_id"]: r["verdict"] for r in I.check_chunk_sequence(df, slice_bytes=10).collect()}
    assert got == {
        "ok": "ok", "gap": "gap", "overlap": "overlap", "start": "gap", "nolast": "missing_last", "two": "multiple_last", "early": "last_not_final",
    }


def test_content_key_and_uploads(spark):
    digest = hashlib.sha256(b"abc").hexdigest()
    shards = spark.createDataFrame([("r", "c", "rank-0", digest), ("r", "c", "rank-0", digest), ("r", "c", "rank-1", digest)], "run_id string, checkpoint_id string, shard_id string, sha256 string")
    stored = spark.createDataFrame([(f"r/c/sha256-{digest[:16]}-rank-0.bin",)], "key string")
    got = {(r["key"], r["kind"]) for r in I.plan_uploads(shards, stored).collect()}
    assert got == {
        (f"r/c/sha256-{digest[:16]}-rank-1.bin", "shard"), ("r/c/rank-0.sha256", "checksum"), ("r/c/rank-1.sha256", "checksum"),
    }


def test_verify_statuses(spark):
    def sha(b):
        return hashlib.sha256(b).hexdigest()

    stored = spark.createDataFrame([("c", "a", b"aa"), ("c", "b", b"bx"), ("c", "d", b"ddd"), ("c", "e", b"ee"), ("c", "u", b"u")], "checkpoint_id string, shard_id string, payload binary")
    manifest = spark.createDataFrame([("c", s, sha(p), len(p)) for s, p in [("a", b"aa"), ("b", b"bb"), ("d", b"dd"), ("e", b"ee"), ("m", b"m")]], "checkpoint_id string, shard_id string, sha256 string, size_bytes long")
    side = spark.createDataFrame([("c", s, sha(p)) for s, p in [("a", b"aa"), ("b", b"bb"), ("d", b"dd"), ("m", b"m")]], "checkpoint_id string, shard_id string, sha256 string")
    got = {r["shard_id"]: r["status"] for r in I.verify_shards(stored, manifest, side).collect()}
    assert got == {"a": "ok", "b": "digest_mismatch", "d": "size_mismatch", "e": "missing_sidecar", "m": "missing_object", "u": "unlisted"}


def test_orphan_gc_deletes_exactly_the_orphans(spark):
    keys = ["r/orphan-ckpt/a.bin", "r/orphan-ckpt/b.bin", "r/valid-ckpt/a.bin", "r/valid-ckpt/_manifest.json", "r/loose.bin", "r/x/deep/_manifest.json"]
    objects = spark.createDataFrame([(k, 1) for k in keys], "key string, size long")
    got = {r["key"] for r in C.plan_orphan_gc(objects).collect()}
    # a manifest further down does not account for the folder
    assert got == {"r/orphan-ckpt/a.bin", "r/orphan-ckpt/b.bin", "r/x/deep/_manifest.json"}


def test_recovery_point_and_updates(spark):
    cps = spark.createDataFrame(
        [(1, 1, 100, "COMMITTED", T0, T0, 5), (2, 1, 300, "PENDING", T0, None, 6), (3, 1, 200, "COMMITTED", T0, T0, 7), (4, 2, 50, "FAILED", T0, None, 8)],
        "checkpoint_id long, run_id long, step long, state string, created_at timestamp, committed_at timestamp, total_bytes long",
    )
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    got = {r["run_id"]: (r["checkpoint_id"], r["step"]) for r in C.recovery_point(runs, cps).collect()}
    assert got == {1: (3, 200), 2: (None, None)}
    assert [r["step"] for r in C.checkpoints_of(cps, 1).collect()] == [100, 200, 300]
    late = T0 + timedelta(days=1)
    updates = spark.createDataFrame(
        [(2, T0, 0, "COMMITTED", None), (2, late, 1, "COMMITTED", 1024), (2, late, 2, None, None)], "checkpoint_id long, ts timestamp, seq long, state string, total_bytes long"
    )
    row = C.apply_checkpoint_updates(cps, updates, ["ts", "seq"]).where("checkpoint_id = 2").first()
    assert (row["state"], row["total_bytes"], row["committed_at"]) == ("COMMITTED", 1024, T0)
    assert (row["num_shards"], row["shard_ids"], row["created_at"]) == (0, [], cps.where("checkpoint_id = 2").first()["created_at"])
    more = updates.withColumn("num_shards", F.when(F.col("seq") == 1, 4).cast("long")).withColumn("shard_ids", F.when(F.col("seq") == 0, F.array(F.lit("rank-0"))))
    row = C.apply_checkpoint_updates(cps, more, ["ts", "seq"]).where("checkpoint_id = 2").first()
    assert (row["state"], row["total_bytes"], row["num_shards"], row["shard_ids"]) == ("COMMITTED", 1024, 4, ["rank-0"])
    kept = C.apply_checkpoint_updates(cps.withColumn("num_shards", F.lit(9).cast("long")), updates, ["ts", "seq"]).where("checkpoint_id = 2").first()
    assert kept["num_shards"] == 9
    aborted = {r["checkpoint_id"]: r["state"] for r in C.abort_pending(cps, runs).collect()}
    assert aborted == {1: "COMMITTED", 2: "FAILED", 3: "COMMITTED", 4: "FAILED"}


def test_asof_anchor(spark, medium):
    found = C.recovery_point_asof(V.failures(spark, medium), V.checkpoints(spark, medium))
    assert tuple(found.agg(F.count("*"), F.count("checkpoint_id"), F.sum("checkpoint_id")).first()) == (2978, 2131, 16224476)


def test_retention_and_tree(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    versions = spark.createDataFrame(
        [("r/c/a", 1, T0), ("r/c/a", 2, T0 + timedelta(days=55)), ("r/c/b", 3, T0), ("r/c/d", 4, T0 + timedelta(days=50)), ("r/c/d", 5, T0 + timedelta(days=58))],
        "key string, size long, modified timestamp",
    )
    got = {(r["key"], r["size"], r["reason"]) for r in C.plan_retention(versions, now).collect()}
    assert got == {("r/c/b", 3, "age")}
    later = F.lit("2024-03-04").cast("timestamp")
    assert ("r/c/a", 1, "superseded") in {(r["key"], r["size"], r["reason"]) for r in C.plan_retention(versions, later).collect()}
    tree = {(r["run_id"], r["checkpoint_id"]): (r["files"], r["bytes"], r["level"]) for r in C.storage_tree(versions).collect()}
    assert tree[(None, None)] == (5, 15, 3) and tree[("r", "c")] == (5, 15, 0) and tree[("r", None)] == (5, 15, 1)


def test_retention_shuffles_versions_once(spark, tmp_path):
    versions = spark.range(500).select(
        F.concat(F.lit("r/c/"), F.col("id") % 300).alias("key"), F.col("id").alias("size"), F.timestamp_seconds(F.col("id") * 86_400).alias("modified"), F.lit("x").alias("etag")
    )
    versions.write.parquet(f"{tmp_path}/v")
    plan = C.plan_retention(spark.read.parquet(f"{tmp_path}/v"), F.lit("2024-03-01").cast("timestamp"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "etag" not in text
    assert plan.where("reason = 'superseded'").count() == 200 and plan.count() == 500
    undated = spark.createDataFrame([("r/c/0", 1, None), ("r/c/0", 2, T0)], "key string, size long, modified timestamp")
    assert [r["size"] for r in C.plan_retention(undated, F.lit("2030-01-01").cast("timestamp")).collect()] == [2]


def test_list_objects_reads_a_folder(spark, tmp_path):
    for name, size in [("r/c/a.bin", 3), ("r/c/_manifest.json", 2)]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"z" * size)
    got = {(r["key"], r["size"], r["kind"]) for r in O.object_parts(O.list_objects(spark, str(tmp_path))).collect()}
    assert got == {("r/c/a.bin", 3, "shard"), ("r/c/_manifest.json", 2, "manifest")}


def test_key_layout_and_composite_ids(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/b",), ("a",)], "key string")
    got = {r["key"]: (r["run_id"], r["checkpoint_id"], r["file"]) for r in O.object_parts(df).collect()}
    assert got == {"a/b/c": ("a", "b", "c"), "a/b": ("a", "root", "b"), "a": ("unknown", "root", "a")}
    got = {r["key"]: (r["run_id"], r["checkpoint_id"]) for r in O.split_composite_id(df, "key").collect()}
    assert got == {"a/b/c": ("a", "b/c"), "a/b": ("a", "b"), "a": ("a", "a")}


def test_local_files_order_by_number(spark):
    names = spark.createDataFrame([("checkpoint_step9_rank0.pt",), ("checkpoint_step10_rank0.pt",), ("checkpoint_step3_rank1.pt",), ("notes.txt",)], "name string")
    files = O.local_checkpoint_files(names)
    assert files.where("name = 'notes.txt'").first()["step"] == 0
    got = {r["rank"]: (r["step"], r["name"]) for r in O.newest_local_checkpoint(files).collect()}
    assert got == {0: (10, "checkpoint_step10_rank0.pt"), 1: (3, "checkpoint_step3_rank1.pt")}


def test_manifests_write_once_and_read_back(spark, tmp_path):
    shards = spark.createDataFrame(
        [("r", "c", 42, f"rank-{i}", i, 2048, "d" * 64, f"k{i}") for i in range(2)] + [("r", "old", 1, "rank-0", 0, 1, "e", "k")],
        "run_id string, checkpoint_id string, step long, shard_id string, rank int, size_bytes long, sha256 string, storage_key string",
    )
    existing = spark.createDataFrame([("r", "old")], "run_id string, checkpoint_id string")
    made = M.commit_manifests(shards, existing)
    row = made.collect()
    assert len(row) == 1 and (row[0]["num_shards"], row[0]["total_bytes"], row[0]["step"], row[0]["part"]) == (2, 4096, 42, 0)
    assert M.commit_manifests(shards, made.select("run_id", "checkpoint_id").unionByName(existing)).count() == 0
    parts = M.commit_manifests(shards, existing, part_shards=1).orderBy("part").collect()
    assert [(p["part"], p["num_shards"], len(p["shards"])) for p in parts] == [(0, 2, 1), (1, 2, 1)]
    doc = M.manifest_documents(made, "2024-01-01T00:00:00Z").first()
    assert doc["key"] == "r/c/_manifest.json"
    root = str(tmp_path / "tree")
    report = M.write_manifests(made, root, "2024-01-01T00:00:00Z")
    assert [tuple(r) for r in report.collect()] == [("r/c/_manifest.json", True)]
    assert (tmp_path / "tree" / "r" / "c" / "_manifest.json").read_text() == doc["value"]
    again = M.write_manifests(made.withColumn("step", F.lit(7).cast("long")), root, "2025-01-01T00:00:00Z")
    assert [tuple(r) for r in again.collect()] == [("r/c/_manifest.json", False)]
    assert os.listdir(tmp_path / "tree" / "r" / "c") == ["_manifest.json"]
    for prefixes in (None, spark.createDataFrame([("r",), ("r/",), ("gone",)], "prefix string")):
        back = M.read_manifests(spark, root, prefixes).collect()[0]
        assert back["metadata"] == {} and back["total_bytes"] == 4096 and len(back["shards"]) == 2 and back["step"] == 42
    assert [r["shard_id"] for r in M.explode_shards(M.read_manifests(spark, root)).orderBy("rank").collect()] == ["rank-0", "rank-1"]
    M.write_manifests(M.commit_manifests(shards, existing.limit(0), part_shards=1), f"file://{tmp_path}/parts", "2024-01-01T00:00:00Z")
    assert M.explode_shards(M.read_manifests(spark, f"file://{tmp_path}/parts")).count() == 3


def test_writers_that_meet_leave_one_whole_object(spark, tmp_path):
    texts = spark.range(200).select((F.col("id") % 20).cast("string").alias("key"), F.repeat(F.col("id").cast("string"), 2000).alias("value"))
    report = O.create_objects(texts.repartition(8), str(tmp_path / "x")).groupBy("key").agg(F.count_if("created").alias("n")).collect()
    assert len(report) == 20 and {r["n"] for r in report} == {1}
    assert sorted(os.listdir(tmp_path / "x")) == sorted(str(i) for i in range(20))
    assert all(len(set((tmp_path / "x" / f"{i}").read_text()[k::len(str(int(i)))] for k in (0,))) == 1 for i in range(20))


def test_listing_in_pages_and_by_prefix(spark, tmp_path):
    for run in ("a", "b", "c"):
        for i in range(25):
            path = tmp_path / run / f"ck{i % 3}" / "deep" / f"f{i}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"z" * i)
    every = {(r["key"], r["size"]) for r in O.list_objects(spark, str(tmp_path), page=4).collect()}
    assert len(every) == 75 and ("b/ck1/deep/f4", 4) in every
    some = O.list_objects(spark, str(tmp_path), spark.createDataFrame([("a",), ("c/ck1",), ("no",)], "prefix string"), page=3)
    assert {(r["key"], r["size"]) for r in some.collect()} == {e for e in every if e[0].startswith(("a/", "c/ck1/"))}
    assert O.list_objects(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n,missing", [(30, 0)])
def test_durations_align_by_ordinal(spark, n, missing):
    saves = spark.createDataFrame([(T0 + timedelta(minutes=i), i, float(i)) for i in range(40)], "ts timestamp, op_id long, duration_s double")
    restores = saves.where("op_id < 3")
    got = C.checkpoint_durations(saves, restores, n).orderBy("index").collect()
    assert [r["save"] for r in got] == [float(i) for i in range(10, 40)]
    assert [r["restore"] for r in got][:4] == [0.0, 1.0, 2.0, missing]


def test_heartbeats_of_a_worker_in_another_run_are_ignored(spark):
    beats = spark.createDataFrame([(9, 1, T0, 1), (9, 2, T0, 2), (8, 1, T0, 3), (9, 2, T0, 4)], "worker_id long, run_id long, ts timestamp, step long")
    members = spark.createDataFrame([(1, 9)], "run_id long, worker_id long")
    known, ignored = W.drop_unknown_heartbeats(beats, members)
    assert known.columns == beats.columns and [r["step"] for r in known.collect()] == [1]
    assert sorted((r["run_id"], r["worker_id"], r["n_ignored"]) for r in ignored.collect()) == [(1, 8, 1), (2, 9, 2)]


def test_one_pass_finds_what_both_plans_find(spark):
    keys = ["r/a/_manifest.json", "r/a/x.bin", "r/b/x.bin", "r/b/y.sha256", "r/c/_manifest.json", "r/c/z.bin", "r/d/_manifest.json", "q/a/x.bin", "top.bin", "r/b/deep/_manifest.json"]
    objects = spark.createDataFrame([(k, 10 + i) for i, k in enumerate(keys)], "key string, size long")
    aborted = spark.createDataFrame([("r", "b"), ("r", "c"), ("r", "d"), ("r", "b"), ("no", "x")], "run_id string, checkpoint_id string")
    want = C.gc_by_reason(C.plan_orphan_gc(objects), C.plan_abort(objects, aborted)).collect()
    got = C.gc_summary(objects, aborted).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
    assert C.gc_summary(objects.limit(0), aborted).count() == 0


def test_entries_of_many_small_folders_are_handed_on_together(tmp_path):
    for i in range(40):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "_manifest.json").write_text("x" * i)
    rows_ = [{"path": str(tmp_path / f"r{i}"), "is_folder": True, "size": None, "modified": None} for i in range(40)] + [
        {"path": "/gone", "is_folder": True, "size": None, "modified": None},
        {"path": "/seen", "is_folder": False, "size": 7, "modified": datetime(2024, 1, 1, tzinfo=timezone.utc)},
    ]
    schema = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])
    batches = list(O._list_folders(str(tmp_path), True, 30)(iter([pa.RecordBatch.from_pylist(rows_, schema)])))
    assert [len(b) for b in batches] == [30, 11]
    found = [r for b in batches for r in b.to_pylist()]
    assert [r["size"] for r in found] == [*range(40), 7]
    assert found[-1] == rows_[-1] and all(r["modified"].year >= 2024 for r in found)


def test_few_large_files_of_texts_are_written_by_all_tasks(spark, tmp_path):
    texts = spark.range(64).select(F.concat(F.lit("r/c"), "id", F.lit("/_manifest.json")).alias("key"), F.lit("{}").alias("value")).coalesce(1)
    made = O.create_objects(texts, str(tmp_path / "x"))
    assert made.where("created").count() == 64
    assert len({f for f in made.inputFiles()}) > 1


def joined_columns(df):
    """Names of what the first side of each join in a frame's optimized plan hands on, the topmost join first."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop(0)
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            out = children[0].output()
            found.append({out.apply(i).name() for i in range(out.size())})
        todo += children
    return found


def test_only_keys_and_sizes_meet_the_aborted_folders(spark):
    objects = spark.createDataFrame(
        [("1/2/rank-1.bin", 5), ("1/2/_manifest.json", 6), ("1/2/deep/_manifest-1.json", 7), ("1/2/x/y.bin", 8), ("1/3/a.bin", 9), ("1/2", 1), ("2", 1), (None, 3)],
        "key string, size long",
    )
    aborted = spark.createDataFrame([(1, 2), (1, 2), (None, 3)], "run_id long, checkpoint_id long")
    plan = C.plan_abort(objects, aborted)
    assert sorted(map(tuple, plan.collect())) == [("1", "2", "1/2/rank-1.bin", 5), ("1", "2", "1/2/x/y.bin", 8)]
    assert joined_columns(plan)[0] == {"key", "size"}


def test_digests_follow_the_joins_of_shards(spark, small):
    assert not {"sha256", "shard_id"} & joined_columns(V.run_shards(spark, small))[0]
    from runledger.plans import source_queries as Q

    joins = joined_columns(Q._committable(spark, small))
    assert joins and not any({"sha256", "storage_key"} & j for j in joins)


def test_shards_of_other_checkpoints_leave_before_names_and_digests(spark, small):
    from runledger.plans import source_queries as Q

    points = Q._points(spark, small)
    assert not any({"sha256", "shard_id", "storage_key"} & j for j in joined_columns(points))
    committed = V.checkpoints(spark, small).where("state = 'COMMITTED'").groupBy("run_id").agg(F.max_by("checkpoint_id", F.struct("step", "checkpoint_id")).alias("c"))
    stored = V.plain_shards(spark, small).select(F.col("checkpoint_id").alias("c")).distinct()
    assert sorted(r["checkpoint_id"] for r in points.collect()) == sorted(r["c"] for r in committed.join(stored, "c").collect())
