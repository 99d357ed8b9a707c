"""Training log lines and event-stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The log line layout.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] rank=(\d+) (.*)$"
NUMBER = r"[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[nN]a[nN]|inf)"
STEP = rf"^step=(\d+)/(\d+)\s+loss=({NUMBER})\s+steps/s=({NUMBER})(?:\s|$)"
SAVED = r"^Checkpoint saved"
RESTORED = r"^Restored from"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_training_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    """Split each line into time, level, rank, kind and figures.

    Unknown lines, and step lines whose figures are no numbers, keep their row as ``other``; a figure that doesn't fit
    its type is null.
    """
    # a line of the known layout has its fields between the first four blanks
    words = F.split(column, " ", 5)
    laid_out = lines.withColumn("_w", F.when(F.col(column).rlike(LINE), words))

    def word(i: int) -> Column:
        return F.get("_w", F.lit(i))

    parsed = laid_out.withColumns(
        {
            "logged_at": F.try_to_timestamp(F.concat_ws(" ", word(0), word(1)), F.lit("yyyy-MM-dd HH:mm:ss")),
            "level": F.btrim(word(2), F.lit("[]")),
            "rank": F.substring_index(word(3), "=", -1).try_cast("int"),
            "message": word(4),
        }
    ).drop("_w")
    message = F.col("message")
    kind = (
        F.when(message.startswith("step=") & message.rlike(STEP), "step")
        .when(message.rlike(SAVED), "saved")
        .when(message.rlike(RESTORED), "restored")
        .otherwise("other")
    )

    def figure(pattern: str, *kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), _found(message, pattern))

    return parsed.withColumn("kind", kind).withColumns(
        {
            "step": figure(r"step=(\d+)", "step", "saved", "restored").try_cast("long"),
            "total_steps": figure(r"step=\d+/(\d+)", "step").try_cast("long"),
            "loss": figure(rf"loss=({NUMBER})(?:[\s,)]|$)", "step", "saved").try_cast("double"),
            "steps_per_s": figure(rf"steps/s=({NUMBER})(?:\s|$)", "step").try_cast("double"),
            "size_bytes": figure(r"size=(\d+)", "saved", "restored").try_cast("long"),
            "sha256": figure(r"sha256=(\w+)", "saved"),
            "checkpoint_id": figure(r"checkpoint_id=(\S+)", "restored"),
            "time_s": figure(r"time=([0-9.]+)s", "saved", "restored").try_cast("double"),
        }
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (source, line), the source being the file name without its ending."""
    lines = spark.read.text(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return lines.select(name.alias("source"), F.col("value").alias("line"))


def read_event_frames(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``event:``/``data:`` frames divided by blank lines."""
    return parse_event_frames(spark.read.option("lineSep", "\n\n").text(path))


def parse_event_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """event_type, run_id and payload of each frame; any event name is accepted."""
    frame = F.col(column)
    # the frame separator leaves no trailing newline, and data may span several lines
    data = F.regexp_replace(F.array_join(F.regexp_extract_all(frame, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n"), r"\s+$", "")
    return (
        frames.where(F.length(F.trim(frame)) > 0)
        .select(F.regexp_extract(frame, r"(?m)^event: ?(.*)$", 1).alias("event_type"), data.alias("payload"))
        .withColumn("run_id", F.get_json_object("payload", "$.run_id"))
    )


def frame_text(event_type: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), event_type, F.lit("\ndata: "), payload)
