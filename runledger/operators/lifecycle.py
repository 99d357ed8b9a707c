"""Run lifecycle: the state machine over logs of requested changes, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.clock import DAY, seconds_between
from runledger.functions.ordered import by_time, scan
from runledger.schemas import (
    ACTIVE_STATES,
    EDGES,
    OPEN_CHECKPOINT_STATES,
    RESUMABLE_STATES,
    STATES,
    TERMINAL_STATES,
)
from runledger.session import settle

_ALLOWED = [(a, b) in EDGES for a in STATES for b in STATES]
WEEK = 7 * DAY  # slices are cut further where a run is dense
PIECE = 128  # requests whose states stand in one array, and pieces of requests that stand in one cell


def state_code(state: Column) -> Column:
    """Wire code of a state name: 1..8, 0 for anything else."""
    return F.array_position(F.lit(STATES), state).cast("int")


def state_name(code: Column) -> Column:
    """State name of a wire code, ``UNSPECIFIED`` outside 1..8."""
    return F.when(code.between(1, len(STATES)), F.element_at(F.lit(STATES), code.cast("int"))).otherwise("UNSPECIFIED")


def is_allowed(source: Column, target: Column) -> Column:
    return F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in EDGES])


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)


def transition_table(spark: SparkSession) -> DataFrame:
    """The 17 allowed changes with wire codes (a literal relation, always small enough to broadcast)."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS edges(from_state, to_state)").select(
        "from_state",
        "to_state",
        state_code(F.col("from_state")).alias("from_code"),
        state_code(F.col("to_state")).alias("to_code"),
    )


def allowed_transitions(spark: SparkSession) -> DataFrame:
    """Per state: its code, sorted targets and whether it is terminal."""
    values = ", ".join(f"('{s}')" for s in STATES)
    states = spark.sql(f"SELECT * FROM VALUES {values} AS states(state)")
    targets = transition_table(spark).groupBy(F.col("from_state").alias("state")).agg(
        F.sort_array(F.collect_set("to_state")).alias("targets")
    )
    return states.join(F.broadcast(targets), "state", "left").select(
        "state",
        state_code(F.col("state")).alias("code"),
        F.coalesce("targets", F.array().cast("array<string>")).alias("targets"),
        is_terminal(F.col("state")).alias("is_terminal"),
    )


def _in_order(events: DataFrame, slice_us: int, **columns) -> DataFrame:
    return scan(events, ["run_id"], ["ts", "seq"], by_time("ts", slice_us, "seq"), **columns)


def check_transitions(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """Label each consecutive (from, to) pair of a run; before the first event a run is CREATED."""
    return (
        _in_order(events, slice_us, prev={"from_state": F.col("to_state")})
        .withColumn("from_state", F.coalesce("from_state", F.lit("CREATED")))
        .withColumn("valid", is_allowed(F.col("from_state"), F.col("to_state")))
    )


def _apply(state: Column, target: Column) -> Column:
    """Whether ``target`` (code) is accepted in ``state`` (code)."""
    return (target > 0) & F.element_at(F.lit(_ALLOWED), (state - 1) * len(STATES) + F.greatest(target, F.lit(1)))


def _fold(requests: Column | str, entry: Column) -> Column:
    """(state, accepted) after applying an ordered request array to a run entering in state ``entry``."""
    return F.aggregate(
        requests,
        F.struct(entry.alias("state"), F.lit(0).cast("long").alias("accepted")),
        lambda acc, r: F.when(
            _apply(acc["state"], r["code"]),
            F.struct(r["code"].alias("state"), (acc["accepted"] + 1).alias("accepted")),
        ).otherwise(acc),
    )


def _then(effects: str, entry: Column) -> Column:
    """(state, accepted) after running through an ordered array of slice effects."""
    return F.aggregate(
        effects,
        F.struct(entry.alias("state"), F.lit(0).cast("long").alias("accepted")),
        lambda acc, e: F.struct(
            F.element_at(e["effect"], acc["state"])["state"].alias("state"),
            (acc["accepted"] + F.element_at(e["effect"], acc["state"])["accepted"]).alias("accepted"),
        ),
    )


def _from_every_state(fold: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(len(STATES))), fold)


def _group_effects(events: DataFrame, slice_us: int, keep: bool = False) -> DataFrame:
    """Per (run, slice, group of ``PIECE * PIECE`` neighbouring requests): what they do to a run entering in each state.

    Requests act on a run as a function from entry state to end state. Such functions compose, so pieces of ``PIECE`` requests
    are folded in parallel and only their 8-entry tables are chained: pieces within a group, groups within a slice, slices within a
    block, blocks of a run. However many requests a slice holds, a cell holds one group of them; rows are numbered by a sort
    that spills, and numbering, folding and grouping share one exchange. Slices are cut by the data where a run is dense. ``keep`` keeps the
    requests, piece by piece.
    """
    order = Window.partitionBy("run_id", "_slice").orderBy("ts", "seq")
    cut, at = by_time("ts", slice_us, "seq").slices(events.select("run_id", "ts", "seq", "to_state"), ["run_id"])
    rows = cut.withColumn("_slice", at).withColumn("_nth", F.row_number().over(order) - 1)
    piece, group = [F.call_function("div", F.col("_nth"), F.lit(n)) for n in (PIECE, PIECE * PIECE)]
    request = F.struct("ts", "seq", state_code(F.col("to_state")).alias("code"), "to_state")
    pieces = rows.groupBy("run_id", "_slice", group.alias("_group"), piece.alias("_piece")).agg(
        F.sort_array(F.collect_list(request)).alias("_requests")
    )
    inner = F.struct(
        F.col("_piece").alias("at"),
        _from_every_state(lambda s: _fold("_requests", s)).alias("effect"),
        *([F.col("_requests").alias("requests")] if keep else []),
    )
    groups = pieces.groupBy("run_id", "_slice", "_group").agg(
        F.sort_array(F.collect_list(inner)).alias("_pieces"), F.sum(F.size("_requests")).alias("_n")
    )
    return groups.withColumn("_effect", _from_every_state(lambda s: _then("_pieces", s)))


def _slice_effects(groups: DataFrame) -> DataFrame:
    """Per (run, slice): the ordered effects of its groups and their composition."""
    inner = F.struct(F.col("_group").alias("at"), F.col("_effect").alias("effect"))
    slices = groups.groupBy("run_id", "_slice").agg(F.sort_array(F.collect_list(inner)).alias("_groups"), F.sum("_n").alias("_n"))
    return slices.withColumn("_effect", _from_every_state(lambda s: _then("_groups", s)))


def _block_effects(effects: DataFrame, slice_us: int, block_us: int) -> DataFrame:
    """Per (run, block): the ordered effects of its slices and their composition."""
    if effects.schema["_slice"].dataType.typeName() == "struct":
        block = F.call_function("div", F.col("_slice.at"), F.lit(max(block_us, slice_us)))
    else:
        block = F.call_function("div", F.col("_slice"), F.lit(max(block_us // slice_us, 1)))
    blocks = effects.groupBy("run_id", block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_slice").alias("at"), F.col("_effect").alias("effect")))).alias("_inner"),
        F.sum("_n").alias("_n"),
    )
    return blocks.withColumn("_effect", _from_every_state(lambda s: _then("_inner", s)))


def _entry_states(parts: str, first: Column) -> Column:
    """State in which each of an ordered array of effects is entered, as (at, entry) pairs."""
    states = F.aggregate(
        parts,
        F.array(first),
        lambda acc, e: F.concat(acc, F.array(F.element_at(e["effect"], F.element_at(acc, -1))["state"])),
    )
    return F.zip_with(
        F.col(parts),
        F.slice(states, F.lit(1), F.size(parts)),
        lambda e, s: F.struct(e["at"].alias("at"), s.alias("entry")),
    )


def replay_summary(events: DataFrame, slice_us: int = WEEK, block_us: int = 52 * WEEK) -> DataFrame:
    """Fold each run's requests: an invalid request is rejected and changes neither state nor history."""
    effects = _slice_effects(_group_effects(events, slice_us)).select("run_id", "_slice", "_effect", "_n")
    chained = (
        _block_effects(effects, slice_us, block_us)
        .groupBy("run_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("_block").alias("at"), F.col("_effect").alias("effect")))).alias("_blocks"),
            F.sum("_n").alias("n_requests"),
        )
    )
    return chained.withColumn("_end", _then("_blocks", F.lit(1))).select(
        "run_id",
        state_name(F.col("_end.state")).alias("state"),
        F.col("_end.accepted").alias("n_accepted"),
        (F.col("n_requests") - F.col("_end.accepted")).alias("n_rejected"),
        is_terminal(state_name(F.col("_end.state"))).alias("is_terminal"),
    )


def replay_transitions(events: DataFrame, slice_us: int = WEEK, block_us: int = 52 * WEEK) -> DataFrame:
    """One row per request with the state it met and whether it was accepted.

    The accepted rows are the run's history (kept as rows: an array per run would not be bounded). The grouped requests are written
    once to the shared folder; what is chained over them reads their effects only.
    """
    groups = settle(_group_effects(events, slice_us, keep=True))
    effects = _slice_effects(groups.select("run_id", "_slice", "_group", "_effect", "_n"))
    blocks = _block_effects(effects.select("run_id", "_slice", "_effect", "_n"), slice_us, block_us)
    block_entry = (
        blocks.groupBy("run_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("_block").alias("at"), F.col("_effect").alias("effect")))).alias("_blocks")
        )
        .select("run_id", F.explode(_entry_states("_blocks", F.lit(1))).alias("e"))
        .select("run_id", F.col("e.at").alias("_block"), F.col("e.entry").alias("_first"))
    )
    entered = (
        blocks.select("run_id", "_block", "_inner")
        .join(block_entry, ["run_id", "_block"])
        .select("run_id", F.explode(_entry_states("_inner", F.col("_first"))).alias("e"))
        .select("run_id", F.col("e.at").alias("_slice"), F.col("e.entry").alias("_entry"))
    )
    started = (
        effects.select("run_id", "_slice", "_groups")
        .join(entered, ["run_id", "_slice"])
        .select("run_id", "_slice", F.explode(_entry_states("_groups", F.col("_entry"))).alias("e"))
        .select("run_id", "_slice", F.col("e.at").alias("_group"), F.col("e.entry").alias("_entry"))
    )
    cut = F.zip_with(
        _entry_states("_pieces", F.col("_entry")),
        F.col("_pieces"),
        lambda e, p: F.struct(e["entry"].alias("entry"), p["requests"].alias("requests")),
    )
    states = F.aggregate(
        "_piece.requests",
        F.array("_piece.entry"),
        lambda acc, r: F.concat(
            acc,
            F.array(F.when(_apply(F.element_at(acc, -1), r["code"]), r["code"]).otherwise(F.element_at(acc, -1))),
        ),
    )
    return (
        groups.select("run_id", "_slice", "_group", "_pieces")
        .join(started, ["run_id", "_slice", "_group"])
        .select("run_id", F.explode(cut).alias("_piece"))
        .select("run_id", "_piece", states.alias("_states"))
        .select("run_id", "_states", F.posexplode("_piece.requests").alias("_i", "r"))
        .select(
            "run_id",
            "r.ts",
            "r.seq",
            state_name(F.get("_states", F.col("_i"))).alias("from_state"),
            "r.to_state",
            _apply(F.get("_states", F.col("_i")), F.col("r.code")).alias("accepted"),
        )
    )


def accepted_changes(events: DataFrame, slice_us: int = WEEK, block_us: int = 52 * WEEK) -> DataFrame:
    """A run's history: the requests that were accepted; rejected ones leave no trace in it.

    It is written to the shared folder once, since what is asked of a history reads it several times.
    """
    return settle(replay_transitions(events, slice_us, block_us).where("accepted").select("run_id", "ts", "seq", "to_state"))


def change_severity(previous: Column, state: Column) -> Column:
    return (
        F.when(state == "FAILED", "error")
        .when(state == "RECOVERING", "warning")
        .when((state == "RUNNING") & previous.isin("RECOVERING", "COMMITTED"), "success")
        .otherwise("info")
    )


def state_changes(snapshots: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """Polled snapshots reduced to the rows where the state differs from the previous poll."""
    return (
        _in_order(snapshots, slice_us, prev={"from_state": F.col("to_state")}, first={"_start": "ts"})
        .where(F.col("from_state") != F.col("to_state"))
        .select(
            "run_id",
            "ts",
            "seq",
            "from_state",
            "to_state",
            change_severity(F.col("from_state"), F.col("to_state")).alias("severity"),
            seconds_between(F.col("_start"), F.col("ts")).alias("elapsed_s"),
        )
    )


def state_visits(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """One row per uninterrupted stay in a state, from accepted changes; the last stay of a run has no end."""
    entered = settle(
        _in_order(events, slice_us, keep_slice=True, prev={"_before": F.col("to_state")}).where(~F.col("to_state").eqNullSafe(F.col("_before")))
    )
    return _in_order(entered, slice_us, next={"left_at": "ts"}).select(
        "run_id",
        F.col("to_state").alias("state"),
        F.col("ts").alias("entered_at"),
        "left_at",
        seconds_between(F.col("ts"), F.col("left_at")).alias("dwell_s"),
    )


def state_durations(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """Stays and seconds per state over all runs, from accepted changes."""
    return state_visits(events, slice_us).groupBy("state").agg(
        F.count("*").alias("visits"),
        F.sum("dwell_s").alias("total_s"),
        F.avg("dwell_s").alias("mean_s"),
        F.max("dwell_s").alias("longest_s"),
    )


def transition_matrix(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """Counts of consecutive states over accepted changes, one column per target and one for any other name."""
    pairs = check_transitions(events, slice_us).withColumn(
        "to_state", F.when(F.col("to_state").isin(STATES), F.col("to_state")).otherwise("other")
    )
    targets = [*STATES, "other"]
    return pairs.groupBy("from_state").pivot("to_state", targets).agg(F.count("to_state")).na.fill(0, targets)


def runs_by_state(runs: DataFrame) -> DataFrame:
    return runs.groupBy("state").agg(F.count("*").alias("n_runs")).orderBy("state")


def resumable_runs(runs: DataFrame) -> DataFrame:
    """Runs a restarted worker may pick up."""
    return runs.where(F.col("state").isin(RESUMABLE_STATES))


def first_active_run(runs: DataFrame) -> DataFrame:
    """The lowest run id that is running, checkpointing or committed."""
    active = runs.where(F.col("state").isin("RUNNING", "CHECKPOINTING", "COMMITTED"))
    return active.agg(F.min_by(F.struct("run_id", "state"), "run_id").alias("r")).select("r.*")


def apply_resume(runs: DataFrame) -> DataFrame:
    """Result of asking each run to resume: the states passed through, or a conflict."""
    state = F.col("state")
    path = (
        F.when(state == "FAILED", F.array(F.lit("RECOVERING"), F.lit("RUNNING")))
        .when(state.isin("COMMITTED", "CREATED", "CHECKPOINTING"), F.array(F.lit("RUNNING")))
        .otherwise(F.array().cast("array<string>"))
    )
    conflict = ~state.isin("FAILED", "RUNNING", "COMMITTED", "CREATED", "CHECKPOINTING")
    return runs.select(
        "run_id",
        "state",
        F.when(conflict, state).otherwise("RUNNING").alias("new_state"),
        path.alias("path"),
        conflict.alias("conflict"),
    )


def merge_metadata(changes: DataFrame, mode: str = "merge") -> DataFrame:
    """Current metadata as (entity_id, key, value) rows from a log of (entity_id, ts, seq, metadata map).

    ``merge`` keeps every key and the latest value of each; ``replace`` keeps the last map only.
    """
    position = F.struct("ts", "seq")
    if mode == "merge":
        pairs = changes.select("entity_id", "ts", "seq", F.explode("metadata").alias("key", "value"))
        return pairs.groupBy("entity_id", "key").agg(F.max_by("value", position).alias("value"))
    if mode == "replace":
        # maps cannot be aggregation buffers' sort keys, so the last map travels as its entries
        last = changes.groupBy("entity_id").agg(F.max_by(F.map_entries("metadata"), position).alias("m"))
        return last.select("entity_id", F.explode("m").alias("e")).select("entity_id", "e.key", "e.value")
    raise ValueError(f"mode must be merge or replace, not {mode!r}")


def metadata_maps(pairs: DataFrame) -> DataFrame:
    """(entity_id, key, value) rows back to one map per entity."""
    return pairs.groupBy("entity_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata")
    )


def incident_timeline(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """One row per failure of a run, from accepted changes: when it failed, began to recover and ran again."""
    marked = settle(
        _in_order(events, slice_us, keep_slice=True, prev={"_before": F.col("to_state")}).withColumn(
            "_fails", ((F.col("to_state") == "FAILED") & ~F.col("_before").eqNullSafe(F.lit("FAILED"))).cast("long")
        )
    )
    numbered = _in_order(marked, slice_us, total={"incident": F.col("_fails")}).where("incident > 0")

    def first_time(state: str) -> Column:
        return F.min(F.when(F.col("to_state") == state, F.col("ts")))

    spans = numbered.groupBy("run_id", "incident").agg(
        first_time("FAILED").alias("failed_at"),
        first_time("RECOVERING").alias("recovering_at"),
        first_time("RUNNING").alias("running_at"),
    )
    return spans.select(
        "*",
        seconds_between(F.col("failed_at"), F.col("recovering_at")).alias("detection_s"),
        seconds_between(F.col("failed_at"), F.col("running_at")).alias("recovery_s"),
    )


def plan_recovery(runs: DataFrame, deaths: DataFrame, checkpoints: DataFrame, auto: bool = True) -> DataFrame:
    """One action per run named in ``deaths`` (worker_id, run_id), however many workers died."""
    hit = deaths.groupBy("run_id").agg(F.count("*").alias("n_deaths"))
    open_ = (
        checkpoints.where(F.col("state").isin(OPEN_CHECKPOINT_STATES))
        .groupBy("run_id")
        .agg(F.count("*").alias("_open"))
    )
    state = F.col("state")
    action = (
        F.when(state.isNull(), "unknown_run")
        .when(is_terminal(state), "skip_terminal")
        .when(state == "FAILED", "recover")
        .when(is_allowed(state, F.lit("FAILED")), "fail_and_recover")
        .otherwise("invalid_transition")
    )
    acts = F.col("action").isin("recover", "fail_and_recover")
    return (
        hit.join(runs.select("run_id", "state"), "run_id", "left")
        .join(open_, "run_id", "left")
        .withColumn("action", action)
        .select(
            "run_id",
            "n_deaths",
            "state",
            "action",
            F.when(acts, F.lit("RUNNING" if auto else "FAILED")).otherwise(state).alias("target_state"),
            F.when(acts, F.coalesce("_open", F.lit(0))).otherwise(0).cast("long").alias("n_aborted"),
        )
    )


def reject_reason(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each requested change against the run's current state: 404 unknown run, 409 not allowed, 200."""
    current = runs.select("run_id", F.col("state").alias("current_state"))
    return requests.join(current, "run_id", "left").withColumn(
        "status",
        F.when(F.col("current_state").isNull(), 404)
        .when(~is_allowed(F.col("current_state"), F.col("to_state")), 409)
        .otherwise(200),
    )


def name_events(events: DataFrame, slice_us: int = WEEK) -> DataFrame:
    """Lifecycle event of each accepted change, and ``run_created`` before a run's first request."""
    source, target = F.col("from_state"), F.col("to_state")
    name = (
        F.when((source == "CREATED") & (target == "RUNNING"), "run_started")
        .when(target == "RUNNING", "run_resumed")
        .when(target == "CANCELLED", "run_cancelled")
        .when(target == "COMPLETED", "run_completed")
        .when(target == "CHECKPOINTING", "checkpoint_started")
        .when(target == "COMMITTED", "checkpoint_committed")
        .when(target == "FAILED", "run_failed")
    )
    named = (
        replay_transitions(events, slice_us)
        .where("accepted")
        .select("run_id", "ts", name.alias("event_name"))
        .where("event_name is not null")
    )
    created = events.groupBy("run_id").agg(F.min("ts").alias("ts")).withColumn("event_name", F.lit("run_created"))
    return named.unionByName(created)


def active_delta(state: Column, before: Column) -> Column:
    """+1 when a run becomes active, -1 when it stops being so."""
    return state.isin(ACTIVE_STATES).cast("int") - F.coalesce(before.isin(ACTIVE_STATES).cast("int"), F.lit(0))
