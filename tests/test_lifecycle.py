from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from runledger.functions.ordered import Cut
from runledger.operators import lifecycle as L
from runledger.plans import views as V
from runledger.schemas import EDGES, STATES

SCHEMA = "run_id long, ts timestamp, seq long, to_state string"


def log(spark, targets, run_id=1):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(run_id, start + timedelta(minutes=3 * i), i, t) for i, t in enumerate(targets)], SCHEMA)


def fold(events):
    state, out = {}, {}
    for run, _, seq, target in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        now = state.get(run, "CREATED")
        ok = (now, target) in EDGES
        out[seq] = (now, ok)
        state[run] = target if ok else now
    return state, out


def test_state_square(spark):
    pairs = spark.createDataFrame([(a, b) for a in STATES for b in STATES], "a string, b string")
    checked = pairs.withColumn("ok", L.is_allowed(F.col("a"), F.col("b"))).collect()
    assert {(r["a"], r["b"]) for r in checked if r["ok"]} == set(EDGES)
    assert sum(r["ok"] for r in checked) == 17 and sum(not r["ok"] for r in checked) == 47
    assert L.transition_table(spark).count() == 17


def test_codes_and_targets(spark):
    table = {r["state"]: r for r in L.allowed_transitions(spark).collect()}
    assert [table[s]["code"] for s in STATES] == list(range(1, 9))
    assert [s for s in STATES if table[s]["is_terminal"]] == ["CANCELLED", "COMPLETED"]
    assert table["CHECKPOINTING"]["targets"] == ["COMMITTED", "FAILED", "RUNNING"]
    assert table["COMPLETED"]["targets"] == []
    assert spark.range(1).select(L.state_name(F.lit(0))).first()[0] == "UNSPECIFIED"


def test_full_loop_has_17_changes(spark):
    events = log(spark, ["RUNNING"] + ["CHECKPOINTING", "COMMITTED", "RUNNING"] * 5 + ["COMPLETED"])
    row = L.replay_summary(events).first()
    assert (row["state"], row["n_accepted"], row["n_rejected"], row["is_terminal"]) == ("COMPLETED", 17, 0, True)
    assert L.replay_transitions(events).where("accepted").count() == 17


def test_rejected_request_changes_nothing(spark):
    row = L.replay_summary(log(spark, ["COMPLETED"])).first()
    assert (row["state"], row["n_accepted"], row["n_rejected"]) == ("CREATED", 0, 1)
    assert L.replay_summary(log(spark, ["NONSENSE", "RUNNING"])).first()["state"] == "RUNNING"


@pytest.mark.parametrize("slice_min,block_min", [(5, 60), (60, 1440), (1, 2), (600, 1440)])
def test_replay_equals_row_by_row_fold_with_a_hot_run(spark, slice_min, block_min):
    rnd = random.Random(slice_min)
    start = datetime(2024, 1, 1)
    events = [
        (1 if rnd.random() < 0.6 else rnd.randint(2, 9), start + timedelta(seconds=rnd.randint(0, 30_000)), i, rnd.choice(STATES[:6]))
        for i in range(400)
    ]
    state, each = fold(events)
    df = spark.createDataFrame(events, SCHEMA)
    minute = 60_000_000
    got = L.replay_transitions(df, slice_min * minute, block_min * minute).collect()
    assert {r["seq"]: (r["from_state"], r["accepted"]) for r in got} == each
    ends = {r["run_id"]: r["state"] for r in L.replay_summary(df, slice_min * minute, block_min * minute).collect()}
    assert ends == state


def test_replay_with_slices_cut_by_the_data(spark, monkeypatch):
    monkeypatch.setattr(L, "by_time", lambda ts, width, then: Cut(ts, width, then, rows=15, least_bytes=0))
    test_replay_equals_row_by_row_fold_with_a_hot_run(spark, 600, 1440)


def test_replay_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 3)
    test_replay_equals_row_by_row_fold_with_a_hot_run(spark, 600, 1440)


def test_a_slice_of_a_million_requests(spark):
    """All in one slice; what each request met follows from a run's cycle of four requests, the last of them never allowed."""
    cycle = F.element_at(F.array(*[F.lit(s) for s in ("RUNNING", "CHECKPOINTING", "COMMITTED", "CREATED")]), (F.col("id") % 4 + 1).cast("int"))
    start = F.lit(1_704_067_200_000_000)
    events = spark.range(1_000_000).select(
        F.lit(1).cast("long").alias("run_id"), F.timestamp_micros(start + F.col("id")).alias("ts"), F.col("id").alias("seq"), cycle.alias("to_state")
    )
    got = L.replay_transitions(events)
    wrong = got.where((F.col("accepted") != (F.col("seq") % 4 != 3)) | ((F.col("seq") % 4 == 3) & (F.col("from_state") != "COMMITTED")))
    assert got.count() == 1_000_000 and wrong.isEmpty()
    row = L.replay_summary(events).first()
    assert (row["state"], row["n_accepted"], row["n_rejected"]) == ("COMMITTED", 750_000, 250_000)


def test_replay_anchor(spark, medium):
    row = L.replay_summary(V.state_events(spark, medium)).agg(
        F.sum("n_accepted"), F.sum("n_rejected"), F.count_if("is_terminal"), F.count("*")
    ).first()
    assert tuple(row) == (2112, 7888, 88, 150)


def test_resume_paths(spark):
    runs = spark.createDataFrame([(i, s) for i, s in enumerate(STATES)], "run_id long, state string")
    got = {r["state"]: (r["new_state"], r["path"], r["conflict"]) for r in L.apply_resume(runs).collect()}
    assert got["FAILED"] == ("RUNNING", ["RECOVERING", "RUNNING"], False)
    assert got["RUNNING"] == ("RUNNING", [], False)
    assert got["COMPLETED"] == ("COMPLETED", [], True)
    assert {s for s, g in got.items() if g[2]} == {"RECOVERING", "CANCELLED", "COMPLETED"}


def test_metadata_merge_and_replace(spark):
    t = datetime(2024, 1, 1)
    changes = spark.createDataFrame(
        [(1, t, 0, {"a": "1", "b": "2"}), (1, t, 1, {"b": "3"})], "entity_id long, ts timestamp, seq long, metadata map<string,string>"
    )
    assert L.metadata_maps(L.merge_metadata(changes, "merge")).first()["metadata"] == {"a": "1", "b": "3"}
    assert L.metadata_maps(L.merge_metadata(changes, "replace")).first()["metadata"] == {"b": "3"}


def test_incident_and_severity(spark):
    events = log(spark, ["RUNNING", "FAILED", "RECOVERING", "RUNNING", "FAILED"])
    rows = sorted(L.incident_timeline(events).collect(), key=lambda r: r["incident"])
    assert [(r["detection_s"], r["recovery_s"]) for r in rows] == [(180.0, 360.0), (None, None)]
    changes = sorted(L.state_changes(events).collect(), key=lambda r: r["seq"])
    assert [c["severity"] for c in changes] == ["error", "warning", "success", "error"]


def test_plan_recovery_cases(spark):
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "FAILED"), (3, "COMPLETED"), (4, "CREATED")], "run_id long, state string")
    deaths = spark.createDataFrame([(7, 1), (8, 1), (9, 2), (10, 3), (11, 4), (12, 99)], "worker_id long, run_id long")
    cps = spark.createDataFrame([(1, 1, "PENDING"), (2, 1, "IN_PROGRESS"), (3, 1, "COMMITTED"), (4, 3, "PENDING")], "checkpoint_id long, run_id long, state string")
    got = {r["run_id"]: r for r in L.plan_recovery(runs, deaths, cps).collect()}
    assert len(got) == 5
    assert (got[1]["action"], got[1]["n_deaths"], got[1]["target_state"], got[1]["n_aborted"]) == ("fail_and_recover", 2, "RUNNING", 2)
    assert got[2]["action"] == "recover"
    assert (got[3]["action"], got[3]["target_state"], got[3]["n_aborted"]) == ("skip_terminal", "COMPLETED", 0)
    assert got[4]["action"] == "invalid_transition" and got[99]["action"] == "unknown_run"
    assert L.plan_recovery(runs, deaths, cps, auto=False).where("run_id = 1").first()["target_state"] == "FAILED"


def test_named_events(spark):
    names = [r["event_name"] for r in L.name_events(log(spark, ["RUNNING", "CHECKPOINTING", "COMMITTED", "RUNNING", "FAILED", "RECOVERING", "RUNNING", "CANCELLED"])).orderBy("ts").collect()]
    assert sorted(names) == sorted(
        ["run_created", "run_started", "checkpoint_started", "checkpoint_committed", "run_resumed", "run_failed", "run_resumed", "run_cancelled"]
    )
