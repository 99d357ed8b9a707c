"""Metrics in text exposition form: reading samples, and writing the summary of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.lifecycle import runs_by_state
from runledger.operators.metrics import metrics_summary

# Exported gauge names, types and help texts in output order.
TOTALS = [
    ("controlplane_runs_total", "gauge", "Total number of training runs", "total_runs"),
    ("controlplane_active_runs", "gauge", "Number of currently active runs", "active_runs"),
    ("controlplane_workers_total", "gauge", "Total registered workers", "total_workers"),
    ("controlplane_active_workers", "gauge", "Number of active workers", "active_workers"),
    ("controlplane_checkpoints_total", "gauge", "Total checkpoints created", "total_checkpoints"),
    ("controlplane_checkpoint_commits_total", "counter", "Total committed checkpoints", "committed"),
]
BY_STATE = ("controlplane_runs_by_state", "gauge", "Runs by state")
DURATION = ("controlplane_checkpoint_duration_seconds", "summary", "Checkpoint commit duration")
LAG = ("controlplane_worker_heartbeat_lag_seconds", "gauge", "Heartbeat lag per worker")

SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def _unescape(text: Column) -> Column:
    # an escaped backslash is set aside first, so that what follows it is not taken for an escape
    aside = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    plain = F.replace(F.replace(aside, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\0"), F.lit("\\"))


def read_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """Samples (name, labels, value, family, type) of exposition lines.

    A TYPE line without a type is passed over; of several types given to one family the first by name counts.
    """
    line = F.col(column)
    kinds = (
        lines.where(line.startswith("# TYPE "))
        .select(F.get(F.split(line, " "), F.lit(2)).alias("family"), F.get(F.split(line, " "), F.lit(3)).alias("type"))
        .where("family <> '' and type <> ''")
        .groupBy("family")
        .agg(F.min("type").alias("type"))
    )
    name = F.regexp_extract(line, SAMPLE, 1)
    body = F.regexp_extract(line, SAMPLE, 2)
    samples = lines.where(~line.startswith("#") & (name != "")).select(
        name.alias("name"),
        F.map_from_arrays(
            F.regexp_extract_all(body, F.lit(LABEL), F.lit(1)),
            F.transform(F.regexp_extract_all(body, F.lit(LABEL), F.lit(2)), _unescape),
        ).alias("labels"),
        F.expr(f"try_cast(regexp_extract({column}, r'{SAMPLE}', 3) as double)").alias("value"),
    )
    # a family's samples carry its name or the name with one of the known endings
    names = kinds.select(
        F.explode(F.array("family", *[F.concat("family", F.lit(e)) for e in ("_sum", "_count", "_bucket")])).alias("name"),
        "family",
        "type",
    ).where("name = family or type in ('histogram', 'summary')")
    return samples.join(names, "name", "left").select(
        "name", "labels", "value", F.coalesce("family", "name").alias("family"), F.coalesce("type", F.lit("untyped")).alias("type")
    )


def read_exposition_files(spark: SparkSession, path: str) -> DataFrame:
    return read_exposition(spark.read.text(path))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _head(name: str, kind: str, help_: str) -> list[str]:
    return [f"# HELP {name} {help_}", f"# TYPE {name} {kind}"]


def _rows(part: int, lines: list[Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(i).alias("place"), x.alias("line")) for i, x in enumerate(lines)]))


def write_exposition(
    runs: DataFrame, checkpoints: DataFrame, workers: DataFrame, durations: DataFrame, lags: DataFrame
) -> DataFrame:
    """Exposition lines in order (part, place, line): totals, runs by state, durations, lag per worker."""
    summary = metrics_summary(runs, checkpoints, workers)
    totals = [
        line
        for name, kind, help_, column in TOTALS
        for line in [*map(F.lit, _head(name, kind, help_)), F.concat(F.lit(f"{name} "), F.col(column))]
    ]
    parts = [summary.select(_rows(0, totals).alias("r"))]

    name, kind, help_ = BY_STATE
    state_line = F.concat(F.lit(name + '{state="'), _escape(F.col("state")), F.lit('"} '), F.col("n_runs"))
    parts.append(summary.select(_rows(1, [F.lit(x) for x in _head(name, kind, help_)]).alias("r")))
    parts.append(runs_by_state(runs).select(F.struct(F.lit(1).alias("part"), F.lit(2).alias("place"), state_line.alias("line")).alias("r")))

    name, kind, help_ = DURATION
    spent = durations.agg(F.sum("duration_s").alias("s"), F.count("duration_s").alias("n")).where("n > 0")
    parts.append(
        spent.select(
            _rows(
                2,
                [
                    *[F.lit(x) for x in _head(name, kind, help_)],
                    F.concat(F.lit(f"{name}_sum "), F.format_string("%.4f", "s")),
                    F.concat(F.lit(f"{name}_count "), F.col("n")),
                ],
            ).alias("r")
        )
    )

    name, kind, help_ = LAG
    lag_text = F.format_string("%.2f", "lag_s")
    lag_line = F.concat(F.lit(name + '{worker_id="'), _escape(F.col("worker_id").cast("string")), F.lit('"} '), lag_text)
    any_lag = lags.agg(F.count("*").alias("n")).where("n > 0")
    parts.append(any_lag.select(_rows(3, [F.lit(x) for x in _head(name, kind, help_)]).alias("r")))
    parts.append(lags.select(F.struct(F.lit(3).alias("part"), F.lit(2).alias("place"), lag_line.alias("line")).alias("r")))

    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines.select("r.*").orderBy("part", "place", "line")


def write_exposition_text(lines: DataFrame, path: str) -> None:
    """Write the ordered lines as text; the range-partitioned sort keeps files in order."""
    lines.select("line").write.mode("overwrite").text(path)
