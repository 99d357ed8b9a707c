"""Metrics over operations, samples, counters and histograms.

Sliding windows are built from panes: rows are first aggregated per (key, step) with map-side
combining, and only the small panes are repeated for the windows they belong to. A window is named
by its end ``tick`` and covers (tick - range, tick].
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import DAY, HOUR, MINUTE, SECOND, from_micros, micros, seconds_between, tick_up
from runledger.functions.ordered import by_time, scan, scan_short
from runledger.functions.quantiles import exact_quantiles, quantile_name
from runledger.operators.lifecycle import active_delta
from runledger.schemas import ACTIVE_STATES, SHARD_BOUNDS
from runledger.session import settle

# Queue capacity, colour steps, retry delay cap.
QUEUE_CAPACITY = 32
LAG_STEPS = [(0, "green"), (15, "yellow"), (30, "red")]
DEPTH_STEPS = [(0, "green"), (22, "yellow"), (29, "red")]
UTILISATION_STEPS = [(0.0, "green"), (0.7, "yellow"), (0.9, "red")]
RETRY_CAP_MS = 30_000

# Load-test limits, times in milliseconds.
LOAD_LIMITS = [
    ("http_req_duration", "p(95)<3000"),
    ("http_req_duration", "p(99)<5000"),
    ("http_req_failed", "rate<0.05"),
    ("errors", "rate<0.1"),
    ("api_latency", "p(95)<1000"),
    ("checkpoint_latency", "p(95)<5000"),
]


# -- summaries ---------------------------------------------------------------------------------


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames with different columns side by side."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def metrics_summary(runs: DataFrame, checkpoints: DataFrame, workers: DataFrame) -> DataFrame:
    """Totals over runs, checkpoints (bytes of all states) and workers on one row."""
    took_ms = (micros("committed_at") - micros("created_at")) / F.lit(1000.0)
    summary = _one_row(
        [
            runs.agg(
                F.count("*").alias("total_runs"), F.count_if(F.col("state").isin(ACTIVE_STATES)).alias("active_runs")
            ),
            checkpoints.agg(
                F.count("*").alias("total_checkpoints"),
                F.count_if(F.col("state") == "COMMITTED").alias("committed"),
                F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_checkpoint_bytes"),
                F.coalesce(F.avg(took_ms), F.lit(0.0)).alias("avg_checkpoint_duration_ms"),
            ),
            workers.agg(
                F.count("*").alias("total_workers"), F.count_if(F.col("status") == "ACTIVE").alias("active_workers")
            ),
        ]
    )
    rate = F.when(F.col("total_checkpoints") > 0, F.col("committed") / F.col("total_checkpoints")).otherwise(0.0)
    return summary.withColumn("checkpoint_success_rate", F.round(rate, 4))


def health_summary(runs: DataFrame, started_at: Column, now: Column, store_ok: bool = True, data_ok: bool = True) -> DataFrame:
    """Active runs, uptime (2 dp) and service flags; the level is always HEALTHY."""
    uptime = F.round((micros(now) - micros(started_at)) / F.lit(1e6), 2)
    return runs.agg(F.count_if(F.col("state").isin(ACTIVE_STATES)).alias("active_runs")).select(
        F.lit("HEALTHY").alias("status"),
        uptime.alias("uptime_seconds"),
        "active_runs",
        F.lit(store_ok).alias("store_connected"),
        F.lit(data_ok).alias("data_connected"),
    )


# -- series ------------------------------------------------------------------------------------


def counter_series(ops: DataFrame, by: Sequence[str], slice_us: int = HOUR) -> DataFrame:
    """Monotone operation and byte counters per label set, one sample per operation."""
    return scan(
        ops, list(by), ["ts", "op_id"], by_time("ts", slice_us, "op_id"),
        total={"total_ops": F.lit(1).cast("long"), "total_bytes": F.col("bytes")},
    ).select(*by, "ts", "op_id", "total_ops", "total_bytes")


def _panes(df: DataFrame, keys: Sequence[str], step_us: int, *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, tick_up("ts", step_us).alias("_pane")).agg(*aggs)


def _to_windows(panes: DataFrame, range_us: int, step_us: int) -> DataFrame:
    if range_us % step_us:
        raise ValueError("the range must be a multiple of the step")
    last = F.col("_pane") + (range_us - step_us)
    return panes.withColumn("_tick", F.explode(F.sequence(F.col("_pane"), last, F.lit(step_us))))


def counter_rate(
    samples: DataFrame, keys: Sequence[str], range_s: int = 300, step_s: int = 15, extrapolate: bool = False,
    slice_us: int = HOUR,
) -> DataFrame:
    """Per-second increase of counter samples (keys, ts, value) per window.

    A value below its predecessor is a restart from 0. Windows with fewer than two samples give
    nothing. ``extrapolate`` stretches the increase toward the window edges as PromQL's rate() does.
    """
    range_us, step_us = range_s * SECOND, step_s * SECOND
    grown = scan(samples, list(keys), ["ts", "seq"], by_time("ts", slice_us, "seq"), prev={"_prev": F.col("value")})
    delta = F.when(F.col("value") >= F.col("_prev"), F.col("value") - F.col("_prev")).otherwise(F.col("value"))
    grown = grown.withColumn("_delta", F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(delta))
    order = F.struct("ts", "seq")
    panes = _panes(
        grown,
        keys,
        step_us,
        F.count("*").alias("_n"),
        F.sum("_delta").alias("_inc"),
        F.min_by(F.struct("ts", "seq", "_delta", "value"), order).alias("_first"),
        F.max("ts").alias("_last"),
    )
    windows = (
        _to_windows(panes, range_us, step_us)
        .groupBy(*keys, "_tick")
        .agg(
            F.sum("_n").alias("n"),
            F.sum("_inc").alias("_inc"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
        )
        .where("n >= 2")
        .withColumns(
            {
                # the first sample's own increase happened before the window
                "increase": F.col("_inc") - F.col("_first._delta"),
                "_span": seconds_between(F.col("_first.ts"), F.col("_last")),
            }
        )
        .where("_span > 0")
    )
    if not extrapolate:
        rate = F.col("increase") / F.col("_span")
    else:
        mean_gap = F.col("_span") / (F.col("n") - 1)
        to_start = (micros("_first.ts") - (F.col("_tick") - range_us)) / F.lit(1e6)
        to_end = (F.col("_tick") - micros("_last")) / F.lit(1e6)
        limit = mean_gap * 1.1
        to_start = F.when(to_start >= limit, mean_gap / 2).otherwise(to_start)
        to_end = F.when(to_end >= limit, mean_gap / 2).otherwise(to_end)
        zero_at = F.col("_span") * (F.col("_first.value") / F.col("increase"))
        to_start = F.when(
            (F.col("increase") > 0) & (F.col("_first.value") >= 0), F.least(to_start, zero_at)
        ).otherwise(to_start)
        rate = F.col("increase") * ((F.col("_span") + to_start + to_end) / F.col("_span")) / F.lit(float(range_s))
    return windows.select(*keys, from_micros(F.col("_tick")).alias("tick"), "n", "increase", rate.alias("rate"))


def sum_by(series: DataFrame, labels: Sequence[str] = (), value: str = "value") -> DataFrame:
    return series.groupBy(*labels).agg(F.sum(value).alias(value))


def label_match(series: DataFrame, matchers: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Keep series whose labels satisfy every (label, op, value): ``=``, ``!=``, ``=~``, ``!~`` (anchored), ``in``."""
    for label, op, value in matchers:
        column = F.coalesce(F.col(label).cast("string"), F.lit(""))
        if op == "in":
            test = column.isin(list(value))
        elif op in ("=~", "!~"):
            test = column.rlike(f"^(?:{value})$")
        elif op in ("=", "!="):
            test = column == str(value)
        else:
            raise ValueError(f"unknown label operator {op!r}")
        series = series.where(~test if op.startswith("!") else test)
    return series


def label_values(series: DataFrame, label: str) -> DataFrame:
    return series.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)


# -- histograms --------------------------------------------------------------------------------


def le_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    return [F.count_if(value <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]


def bucket_array(bounds: Sequence[float], total: str, only: Sequence[float] | None = None) -> Column:
    """Cumulative buckets as an array of (le, cum), the last one unbounded; of ``bounds``, all or ``only`` some."""
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cum"))
        for i, b in enumerate(bounds)
        if only is None or b in only
    ]
    return F.array(*rows, F.struct(F.lit(float("inf")).alias("le"), F.col(total).alias("cum")))


def bucketize(durations: DataFrame, bounds: Sequence[float] = SHARD_BOUNDS, keys: Sequence[str] = (), value: str = "duration_s") -> DataFrame:
    """Cumulative histogram rows (keys, le, cum) with the total count and sum beside each."""
    counted = durations.groupBy(*keys).agg(
        *le_counts(F.col(value), bounds), F.count(value).alias("count"), F.sum(value).alias("sum")
    )
    return counted.select(*keys, F.explode(bucket_array(bounds, "count")).alias("b"), "count", "sum").select(
        *keys, "b.le", "b.cum", "count", "sum"
    )


def quantile_of(buckets: Column, q: float) -> Column:
    """Quantile of a sorted array of cumulative (le, cum), linear inside a bucket, null when empty.

    In the unbounded bucket the largest finite bound is returned.
    """
    total = F.element_at(buckets, -1)["cum"]
    rank = total * F.lit(float(q))
    at = F.size(F.filter(buckets, lambda b: b["cum"] < rank))  # index of the first bucket reaching the rank
    here = F.get(buckets, F.least(at, F.size(buckets) - 1))
    before = F.get(buckets, at - 1)
    low, seen = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["cum"], F.lit(0))
    finite = F.element_at(F.filter(buckets, lambda b: b["le"] < float("inf")), -1)["le"]
    inside = here["cum"] - seen
    value = (
        F.when(here["le"] == float("inf"), finite)
        .when((at == 0) & (here["le"] <= 0), here["le"])
        .when(inside == 0, here["le"])
        .otherwise(low + (here["le"] - low) * ((rank - seen) / inside))
    )
    return F.when(total > 0, value)


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile per key of (keys, le, cum) rows; one key has as many rows as there are bounds."""
    packed = buckets.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("le", "cum"))).alias("_b"))
    return packed.select(*keys, quantile_of(F.col("_b"), q).alias("value"))


def windowed_quantile(
    ops: DataFrame, q: float, bounds: Sequence[float], by: Sequence[str] = (), range_s: int = 300, step_s: int = 15,
    value: str = "duration_s",
) -> DataFrame:
    """Histogram quantile per sliding window and label set."""
    range_us, step_us = range_s * SECOND, step_s * SECOND
    panes = _panes(ops, by, step_us, *le_counts(F.col(value), bounds), F.count(value).alias("_n"))
    sums = [F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(bounds))]
    windows = _to_windows(panes, range_us, step_us).groupBy(*by, "_tick").agg(*sums, F.sum("_n").alias("_n"))
    return windows.select(
        *by, from_micros(F.col("_tick")).alias("tick"), quantile_of(bucket_array(bounds, "_n"), q).alias("value")
    )


def latency_summary(
    df: DataFrame, value: str, keys: Sequence[str] = (), qs: Sequence[float] = (0.5, 0.95, 0.99), approximate: bool = False
) -> DataFrame:
    """n, sum (4 dp), mean, min, max and quantiles of raw values; ``approximate`` trades exactness for one pass."""
    if approximate:
        found = df.groupBy(*keys).agg(
            F.count(value).alias("n"),
            F.sum(value).alias("total"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            *[F.percentile_approx(value, float(q), 10_000).alias(quantile_name(q)) for q in qs],
        )
    else:
        found = exact_quantiles(df, keys, value, qs)
    return found.select(
        *keys,
        "n",
        F.round("total", 4).alias("sum"),
        (F.col("total") / F.col("n")).alias("mean"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        *[quantile_name(q) for q in qs],
    )


def error_ratio(ops: DataFrame, by: Sequence[str] = (), range_s: int = 300, step_s: int = 15) -> DataFrame:
    """Errors over all operations per window; null where there were none."""
    range_us, step_us = range_s * SECOND, step_s * SECOND
    panes = _panes(
        ops, by, step_us, F.count_if(F.col("status") == "error").alias("_bad"), F.count("*").alias("_all")
    )
    windows = _to_windows(panes, range_us, step_us).groupBy(*by, "_tick").agg(
        F.sum("_bad").alias("errors"), F.sum("_all").alias("total")
    )
    return windows.select(
        *by,
        from_micros(F.col("_tick")).alias("tick"),
        "errors",
        "total",
        F.try_divide(F.col("errors"), F.col("total")).alias("value"),
    )


def operation_rate(ops: DataFrame, by: Sequence[str] = (), range_s: int = 300, step_s: int = 15) -> DataFrame:
    """Operations per second per window."""
    range_us, step_us = range_s * SECOND, step_s * SECOND
    panes = _panes(ops, by, step_us, F.count("*").alias("_n"))
    windows = _to_windows(panes, range_us, step_us).groupBy(*by, "_tick").agg(F.sum("_n").alias("_n"))
    return windows.select(*by, from_micros(F.col("_tick")).alias("tick"), (F.col("_n") / F.lit(float(range_s))).alias("value"))


def method_windows(ops: DataFrame, bounds: Sequence[float], range_s: int = 300, step_s: int = 15) -> DataFrame:
    """Per sliding window the operations, errors and ``le_counts`` at three levels, from one pass over ``ops``.

    ``level`` says what a row counts: one ``status`` of a ``method``, a whole ``method``, or ``all`` operations.
    """
    range_us, step_us = range_s * SECOND, step_s * SECOND
    names = [f"_b{i}" for i in range(len(bounds))]
    panes = _panes(
        ops, ["method", "status"], step_us, *le_counts(F.col("duration_s"), bounds),
        F.count("duration_s").alias("_timed"), F.count("*").alias("total"),
    )
    sets = [("method", "status", "_tick"), ("method", "_tick"), ("_tick",)]
    levels = F.when(F.grouping("method") == 1, "all").when(F.grouping("status") == 1, "method").otherwise("status")
    bad = F.when(F.col("_state") == "error", F.col("total"))
    windows = _to_windows(panes, range_us, step_us).withColumn("_state", F.col("status"))
    return (
        windows.groupingSets(sets, "method", "status", "_tick")
        .agg(
            levels.alias("level"),
            *[F.sum(c).alias(c) for c in names],
            F.sum("_timed").alias("_timed"),
            F.coalesce(F.sum(bad), F.lit(0)).alias("errors"),
            F.sum("total").alias("total"),
        )
        .withColumn("tick", from_micros(F.col("_tick")))
        .drop("_tick")
    )


def resample(samples: DataFrame, keys: Sequence[str], step_s: int = 15, lookback_s: int = 300, slice_us: int = HOUR) -> DataFrame:
    """Last value at each grid tick, as long as it is younger than the look-back.

    Each sample covers the ticks from itself to its successor, so no grid has to be joined.
    """
    step_us, back_us = step_s * SECOND, lookback_s * SECOND
    followed = scan_short(samples, list(keys), ["ts", "seq"], by_time("ts", slice_us, "seq"), next={"_next": "ts"})
    start = tick_up("ts", step_us)
    until = F.least(micros("ts") + back_us, F.coalesce(micros("_next"), micros("ts") + back_us)) - 1
    covered = followed.withColumns({"_from": start, "_until": until}).where("_from <= _until")
    ticks = F.explode(F.sequence(F.col("_from"), F.col("_until"), F.lit(step_us)))
    return covered.select(*keys, ticks.alias("_tick"), "value", "ts").select(
        *keys, from_micros(F.col("_tick")).alias("tick"), "value", F.col("ts").alias("sampled_at")
    )


# -- gauges and concurrency --------------------------------------------------------------------


def gauge_max(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return series.groupBy(*by).agg(F.max(value).alias(value))


def gauge_utilisation(depth: Column, capacity: int = QUEUE_CAPACITY) -> Column:
    return depth / F.lit(float(capacity))


def threshold_band(value: Column, steps: Sequence[tuple[float, str]]) -> Column:
    """Name of the highest step at or below the value."""
    ordered = sorted(steps, reverse=True)
    band = F.when(value >= ordered[0][0], ordered[0][1])
    for bound, name in ordered[1:]:
        band = band.when(value >= bound, name)
    return band


def lag_band(lag_s: Column) -> Column:
    return F.when(lag_s < 5, "ok").when(lag_s < 30, "warn").otherwise("err")


def lag_bar(lag_s: Column) -> Column:
    """Length of the lag bar in percent of a minute."""
    return F.least(F.lit(100.0), lag_s / 60 * 100)


def concurrency_profile(
    intervals: DataFrame, keys: Sequence[str] = (), slice_us: int | None = None, keep_slice: bool = False
) -> DataFrame:
    """Depth after every start and end of (keys, op_id, started_at, ended_at); ends count before starts.

    Slices are an hour wide, or a minute where there are no keys to part the rows.
    """
    slice_us = slice_us or (HOUR if keys else MINUTE)
    edge = F.explode(
        F.array(
            F.struct(F.col("started_at").alias("ts"), F.lit(1).cast("long").alias("delta")),
            F.struct(F.col("ended_at").alias("ts"), F.lit(-1).cast("long").alias("delta")),
        )
    )
    edges = intervals.select(*keys, "op_id", "ended_at", edge.alias("e")).select(
        *keys, "op_id", "ended_at", "e.ts", "e.delta"
    )
    return scan(
        edges, list(keys), ["ts", "delta", "op_id"], by_time("ts", slice_us), keep_slice=keep_slice,
        total={"depth": F.col("delta")}, next={"next_ts": "ts"},
    )


def concurrency_levels(intervals: DataFrame, keys: Sequence[str] = (), slice_us: int | None = None) -> DataFrame:
    """Per instant with a start or an end: ``depth`` after all of them, and ``peak``, the greatest depth any of them leaves.

    The highest depths of ``concurrency_profile`` without its rows: starts and ends of an instant are added up before the shuffle, and
    only instants are put in order. Ends count before starts.
    """
    slice_us = slice_us or (HOUR if keys else MINUTE)
    edge = F.array(
        F.struct(F.col("started_at").alias("ts"), F.lit(1).cast("long").alias("starts"), F.lit(0).cast("long").alias("ends")),
        F.struct(F.col("ended_at").alias("ts"), F.lit(0).cast("long").alias("starts"), F.lit(1).cast("long").alias("ends")),
    )
    instants = intervals.select(*keys, F.explode(edge).alias("e")).groupBy(*keys, F.col("e.ts").alias("ts")).agg(
        F.sum("e.starts").alias("starts"), F.sum("e.ends").alias("ends")
    )
    levels = scan(instants, list(keys), ["ts"], by_time("ts", slice_us), total={"depth": F.col("starts") - F.col("ends")})
    first_end = F.col("depth") - F.col("starts") + F.col("ends") - 1
    peak = F.greatest(F.when(F.col("ends") > 0, first_end), F.when(F.col("starts") > 0, F.col("depth")))
    return levels.select(*keys, "ts", "starts", "ends", "depth", peak.alias("peak"))


def concurrency_summary(profile: DataFrame, capacity: int, keys: Sequence[str] = ()) -> DataFrame:
    """Peak depth, and seconds spent at or above capacity."""
    full_us = F.when(F.col("depth") >= capacity, micros("next_ts") - micros("ts")).otherwise(0)
    return profile.groupBy(*keys).agg(
        F.max("depth").alias("peak"), (F.coalesce(F.sum(full_us), F.lit(0)) / F.lit(1e6)).alias("full_s")
    )


def busy_periods(intervals: DataFrame, keys: Sequence[str] = ("server",), slice_us: int = HOUR) -> DataFrame:
    """Every start and end with the number of the busy period it is in; a server is empty between periods."""
    profile = concurrency_profile(intervals, keys, slice_us, keep_slice=True)
    opens = ((F.col("delta") == 1) & (F.col("depth") == 1)).cast("long")
    return scan(profile, list(keys), ["ts", "delta", "op_id"], F.col("_slice"), total={"period": opens})


def _admission_fold(group: list[str], capacity: int):
    """Task function over rows sorted by group, ``is_op``, start: at most ``capacity`` end times in memory.

    A row that is no operation carries the end times running on entry; one such row is returned per group.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        parts = dict(zip([*group, "op_id", "admitted", "running"], zip(*rows))) if rows else {}
        # nullable types keep large ids exact beside the missing ones
        ids, flags = pd.array(parts.pop("op_id", []), dtype="Int64"), pd.array(parts.pop("admitted", []), dtype="boolean")
        running = parts.pop("running", [])
        out = pd.DataFrame({c: list(parts.get(c, [])) for c in group})
        return out.assign(op_id=ids, admitted=flags, running=pd.Series(list(running), dtype=object))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, running = None, []
        for batch in batches:
            out = []
            for row in batch[[*group, "is_op", "started_at", "op_id", "ended_at", "running"]].itertuples(index=False, name=None):
                *here, is_op, start, op, end, entered = row
                if here != current:
                    if current is not None:
                        out.append((*current, None, None, sorted(running)))
                    current, running = here, []
                if not is_op:
                    running = sorted(entered)
                    continue
                while running and running[0] <= start:
                    heapq.heappop(running)
                taken = len(running) < capacity
                if taken:
                    heapq.heappush(running, end)
                out.append((*here, op, taken, None))
            if out:
                yield frame(out)
        if current is not None:
            yield frame([(*current, None, None, sorted(running))])

    return run


def _fold_admissions(ops: DataFrame, entries: DataFrame, group: list[str], capacity: int) -> DataFrame:
    """Fold every group of operations from the end times it is entered with (microseconds)."""
    unused = F.lit(0).cast("long")
    rows = ops.select(
        *group, F.lit(True).alias("is_op"), "started_at", "op_id", "ended_at", F.lit(None).cast("array<bigint>").alias("running")
    ).unionByName(
        entries.select(
            *group, F.lit(False).alias("is_op"), unused.alias("started_at"), unused.alias("op_id"), unused.alias("ended_at"), "running"
        )
    )
    placed = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "is_op", "started_at", "op_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ops.select(*group).schema.fields)
    schema = f"{kinds}, op_id bigint, admitted boolean, running array<bigint>"
    return placed.mapInPandas(_admission_fold(group, capacity), schema)


def _settling_fold(group: list[str], capacity: int, slice_us: int):
    """Task function over rows sorted by period, slice, ``is_op``, start: one pass over a period's slices in order.

    A row that is no operation opens a slice and carries the end times with which it was folded before and those it then left
    behind. Where a slice is really entered with the former, its rows are passed over and the latter go on; else it is folded again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        period, running, skip = None, [], False
        for batch in batches:
            out = []
            columns = [*group, "_slice", "is_op", "started_at", "op_id", "ended_at", "running", "left_behind"]
            for row in batch[columns].itertuples(index=False, name=None):
                *here, at, is_op, start, op, end, entered, left = row
                if here != period:
                    period, running = here, []
                if not is_op:
                    running = sorted(e for e in running if e > at * slice_us)
                    skip = running == sorted(entered)
                    running = sorted(left) if skip else running
                    continue
                if skip:
                    continue
                while running and running[0] <= start:
                    heapq.heappop(running)
                taken = len(running) < capacity
                if taken:
                    heapq.heappush(running, end)
                out.append((*here, op, taken))
            if out:
                parts = dict(zip([*group, "op_id", "admitted"], zip(*out)))
                yield pd.DataFrame({c: list(v) for c, v in parts.items()})

    return run


def _admit_in_slices(ops: DataFrame, capacity: int, keys: list[str], slice_us: int, rounds: int) -> DataFrame:
    """Admission inside busy periods. All time slices are folded at once, as if entered empty, then those again that
    their predecessor enters otherwise, ``rounds`` times in all; what still differs is put right by one pass over the slices of its period.

    The running operations of one slice rarely matter for more than the next, so few slices are left for the last pass,
    and it folds only those that are entered differently than assumed.
    """
    period = [*keys, "period"]
    group = [*period, "_slice"]
    sliced = settle(ops.withColumn("_slice", F.call_function("div", F.col("started_at"), F.lit(slice_us))))
    order = Window.partitionBy(*period).orderBy("_slice")
    none = F.array().cast("array<bigint>")
    used = settle(sliced.select(*group).distinct().withColumn("running", none))
    flags, exits = [], None
    for n in range(rounds):
        todo = sliced if not n else sliced.join(used.select(*group), group, "left_semi")
        folded = settle(_fold_admissions(todo, used, group, capacity))
        flags.append(folded.where("op_id is not null").select(*keys, "op_id", "admitted", F.lit(n).alias("round")))
        left = folded.where("op_id is null").select(*group, F.col("running").alias("left_behind")).join(
            used.select(*group, F.col("running").alias("entered")), group
        )
        if exits is not None:
            left = left.unionByName(exits.join(used.select(*group), group, "left_anti"))
        exits = settle(left)
        # what is over before the slice begins makes no difference to it
        arriving = F.filter(F.lag("left_behind").over(order), lambda e: e > F.col("_slice") * slice_us)
        due = exits.withColumn("running", F.coalesce(arriving, none))
        used = settle(due.where(F.col("running") != F.col("entered")).select(*group, "running"))
    unsettled = used.select(*period).distinct()
    none_yet = F.lit(None).cast("array<bigint>")
    rows = sliced.select(
        *group, F.lit(True).alias("is_op"), "started_at", "op_id", "ended_at", none_yet.alias("running"), none_yet.alias("left_behind")
    ).unionByName(
        exits.select(
            *group, F.lit(False).alias("is_op"), *[F.lit(0).cast("long").alias(c) for c in ("started_at", "op_id", "ended_at")],
            F.col("entered").alias("running"), "left_behind",
        )
    )
    placed = rows.join(unsettled, period, "left_semi").repartition(*[F.col(c) for c in period])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ops.select(*period).schema.fields)
    last = placed.sortWithinPartitions(*group, "is_op", "started_at", "op_id").mapInPandas(
        _settling_fold(period, capacity, slice_us), f"{kinds}, op_id bigint, admitted boolean"
    )
    flags.append(last.select(*keys, "op_id", "admitted", F.lit(rounds).alias("round")))
    every = reduce(DataFrame.unionByName, flags)
    return every.groupBy(*keys, "op_id").agg(F.max_by("admitted", "round").alias("admitted"))


def admit(
    periods: DataFrame, capacity: int = QUEUE_CAPACITY, keys: Sequence[str] = ("server",), slice_us: int = DAY, rounds: int = 2
) -> DataFrame:
    """Mark each operation admitted or rejected when a server turns arrivals away at ``capacity``.

    ``periods`` comes from ``busy_periods``; it is read more than once, so settle it first on large inputs.
    Rejections change the later depth, so this is an ordered fold. It is only needed inside busy periods
    whose unrestricted depth passes the capacity. Those are folded in time slices that are brought into agreement in a fixed number of steps.
    """
    keys = list(keys)
    group = [*keys, "period"]
    sizes = periods.groupBy(*group).agg(F.max("depth").alias("_peak"))
    starts = periods.where("delta = 1").select(
        *group, "op_id", micros("ts").alias("started_at"), micros("ended_at").alias("ended_at")
    )
    placed = starts.join(sizes, group)
    calm = placed.where(F.col("_peak") <= capacity).select(*keys, "op_id", F.lit(True).alias("admitted"))
    busy = placed.where(F.col("_peak") > capacity).drop("_peak")
    return calm.unionByName(_admit_in_slices(busy, capacity, keys, slice_us, rounds))


def active_runs_over_time(events: DataFrame, slice_us: int = HOUR, total_us: int = MINUTE) -> DataFrame:
    """Number of running or checkpointing runs after every accepted change of state.

    Changes are compared per run in slices of ``slice_us``; the count over all runs is taken in slices of ``total_us``.
    """
    before = scan(events, ["run_id"], ["ts", "seq"], by_time("ts", slice_us, "seq"), prev={"_before": F.col("to_state")})
    edges = before.withColumn("_delta", active_delta(F.col("to_state"), F.col("_before")).cast("long"))
    # written, as a scan reads its rows twice
    return scan(
        settle(edges.where("_delta <> 0").select("ts", "seq", "_delta")), [], ["ts", "seq"], by_time("ts", total_us, "seq"), total={"active": F.col("_delta")}
    ).select("ts", "seq", "active")


def active_runs_per_day(profile: DataFrame) -> DataFrame:
    return profile.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.max("active").alias("peak"), F.max_by("active", F.struct("ts", "seq")).alias("closing")
    )


# -- trials ------------------------------------------------------------------------------------


def throughput(trials: DataFrame) -> DataFrame:
    """Mean and best times (ms, 1 dp) and MiB/s per payload size."""
    grouped = trials.groupBy("size_mb").agg(
        F.count("*").alias("iterations"),
        F.avg("save_s").alias("_save"),
        F.avg("restore_s").alias("_restore"),
        F.min("save_s").alias("_min_save"),
        F.min("restore_s").alias("_min_restore"),
    )

    def ms(name: str) -> Column:
        return F.round(F.col(name) * 1000, 1)

    def speed(name: str) -> Column:
        return F.round(F.when(F.col(name) > 0, F.col("size_mb") / F.col(name)).otherwise(0.0), 1)

    return grouped.select(
        "size_mb",
        (F.col("size_mb") * F.lit(1048576).cast("long")).alias("size_bytes"),
        "iterations",
        ms("_save").alias("avg_save_ms"),
        ms("_restore").alias("avg_restore_ms"),
        ms("_min_save").alias("min_save_ms"),
        ms("_min_restore").alias("min_restore_ms"),
        speed("_save").alias("save_mib_s"),
        speed("_restore").alias("restore_mib_s"),
    )


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    results.write.mode("overwrite").json(path)


def compare_baseline(before: DataFrame, after: DataFrame, higher_is_better: Sequence[str] = ()) -> DataFrame:
    """Change in percent per (metric, value) row, and whether it is an improvement."""
    joined = before.select("metric", F.col("value").alias("before")).join(
        after.select("metric", F.col("value").alias("after")), "metric"
    )
    change = F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100
    up = F.col("metric").isin(list(higher_is_better)) if higher_is_better else F.lit(False)
    return joined.withColumns(
        {
            "change_pct": F.round(change, 1),
            "improved": F.when(up, F.col("after") > F.col("before")).otherwise(F.col("after") < F.col("before")),
        }
    )


def as_metric_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide figures to (keys, metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("m")).select(*keys, "m.metric", "m.value")


def check_thresholds(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Limits like ``p(95)<3000``, ``med<=5`` or ``rate<0.05`` over samples (metric, value).

    A rate is the share of non-zero values. The quantiles are those the rules name (rules are a small table).
    ``verdict`` is ok, exceeded, no_data (no sample of the metric) or unknown_rule; only ok has passed.
    """
    limit = r"^\s*(?:p\((\d+(?:\.\d+)?)\)|(med|rate|avg|min|max))\s*(<=|>=|==|!=|<|>)\s*(\S+)\s*$"
    share = F.expr(f"try_cast(regexp_extract(rule, r'{limit}', 1) as double)")
    named = F.regexp_extract("rule", limit, 2)
    share = F.when(named == "med", F.lit(50.0)).when(share <= 100, share)
    wanted = rules.select(
        "metric",
        "rule",
        share.alias("_share"),
        F.when(share.isNull() & (named != ""), named).alias("_named"),
        F.regexp_extract("rule", limit, 3).alias("_op"),
        F.expr(f"try_cast(regexp_extract(rule, r'{limit}', 4) as double)").alias("bound"),
    )
    shares = sorted(r["_share"] for r in wanted.select("_share").distinct().collect() if r["_share"] is not None)
    names = {s: quantile_name(s / 100) for s in shares}
    stat = F.col("_named")
    for s, name in names.items():
        stat = F.when(F.col("_share") == s, name).otherwise(stat)
    wanted = wanted.withColumn("stat", stat)
    quantiles = exact_quantiles(samples, ["metric"], "value", [s / 100 for s in shares])
    rates = samples.groupBy("metric").agg(
        F.avg((F.col("value") != 0).cast("double")).alias("rate"), F.avg("value").alias("avg")
    )
    stats = quantiles.withColumnsRenamed({"low": "min", "high": "max"}).join(rates, "metric")
    observed = as_metric_rows(
        stats.withColumnRenamed("metric", "_m"), [*names.values(), "rate", "avg", "min", "max"], ["_m"]
    ).select(F.col("_m").alias("metric"), F.col("metric").alias("stat"), F.col("value").alias("observed"))
    seen, bound, op = F.col("observed"), F.col("bound"), F.col("_op")
    holds = (
        F.when(op == "<", seen < bound).when(op == "<=", seen <= bound).when(op == ">", seen > bound)
        .when(op == ">=", seen >= bound).when(op == "==", seen == bound).when(op == "!=", seen != bound)
    )
    verdict = (
        F.when(F.col("stat").isNull() | bound.isNull(), "unknown_rule").when(seen.isNull(), "no_data")
        .when(holds, "ok").otherwise("exceeded")
    )
    return wanted.join(observed, ["metric", "stat"], "left").select(
        "metric", "rule", "observed", (verdict == "ok").alias("passed"), verdict.alias("verdict")
    )


def trial_summary(trials: DataFrame, level: str, value: str, ok: str = "ok") -> DataFrame:
    """Per load level: checks passed in percent, latency figures and the error rate."""
    checks = trials.groupBy(level).agg(
        F.count("*").alias("checks"), F.count_if(F.col(ok)).alias("passed")
    )
    return (
        latency_summary(trials, value, [level])
        .join(checks, level)
        .select(
            level,
            "checks",
            "passed",
            F.round(F.col("passed") * 100 / F.col("checks"), 2).alias("passed_pct"),
            "mean",
            "min",
            "p50",
            "max",
            "p95",
            "p99",
            F.round((F.col("checks") - F.col("passed")) / F.col("checks"), 4).alias("error_rate"),
        )
    )


def attempt_summary(attempts: DataFrame, max_attempts: int = 3, base_ms: int = 500) -> DataFrame:
    """Per operation of (op_id, attempt, ok, error): attempts used, outcome, last error, nominal wait and jitter bound."""
    used = F.coalesce(F.min(F.when(F.col("ok"), F.col("attempt"))), F.max("attempt"))
    grouped = attempts.groupBy("op_id").agg(
        used.alias("attempts"),
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("_won"),
        F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("last_error"),
    )
    waits = F.when(
        F.col("attempts") > 1,
        F.transform(
            F.sequence(F.lit(1), F.col("attempts").cast("int") - 1),
            lambda n: F.least(F.lit(base_ms) * F.pow(F.lit(2), n - 1), F.lit(RETRY_CAP_MS)).cast("long"),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    outcome = (
        F.when(F.col("_won").isNotNull(), "success")
        .when(F.col("attempts") >= max_attempts, "exhausted")
        .otherwise("pending")
    )
    return grouped.withColumn("_waits", waits).select(
        "op_id",
        F.col("attempts").cast("long").alias("attempts"),
        outcome.alias("outcome"),
        "last_error",
        F.aggregate("_waits", zero, lambda a, w: a + w).alias("wait_ms"),
        F.aggregate("_waits", zero, lambda a, w: a + F.call_function("div", w, F.lit(2))).alias("jitter_bound_ms"),
    )
