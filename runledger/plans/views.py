"""Domain tables derived from the sample star schema; the only module that knows its names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.schemas import SHARDING_POLICIES, STATES

EVENT_TARGETS = ["RUNNING", "CHECKPOINTING", "COMMITTED", "FAILED", "RECOVERING"]
LOG_SOURCES = ["worker-0", "worker-1", "controlplane", "dataplane"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return as_instants(df)


def as_instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants (session zone UTC), as watermarks need them."""
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def hours(n: Column) -> Column:
    return F.make_interval(hours=n.cast("int"))


def runs(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("run_id"),
        F.col("c_name").alias("name"),
        pick(STATES, key % 8).alias("state"),
        (key * 37 % 3000).alias("current_step"),
        (key % 5).cast("int").alias("num_workers"),
        F.lit(500).alias("checkpoint_interval_steps"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 7 == 0, 0).otherwise(3000).cast("long").alias("max_steps"),
        F.col("c_mktsegment").alias("dataset_id"),
        pick([*SHARDING_POLICIES, "CUSTOM"], key % 5).alias("sharding_policy"),
    )


def checkpoints(spark, d) -> DataFrame:
    status, made = F.col("o_orderstatus"), F.col("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("checkpoint_id"),
        F.col("o_custkey").alias("run_id"),
        F.datediff(made, F.lit("1995-01-01")).cast("long").alias("step"),
        F.when(status == "F", "COMMITTED").when(status == "O", "IN_PROGRESS").otherwise("PENDING").alias("state"),
        made.alias("created_at"),
        F.when(status == "F", made + hours(F.col("o_orderkey") % 72 + 1)).alias("committed_at"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_bytes"),
    )


def plain_shards(spark, d) -> DataFrame:
    """Shards without their names and digests, which ``named_shards`` adds: both follow from the rest and would be most of a shuffled row."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("checkpoint_id"),
        F.col("l_linenumber").alias("rank"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"),
        F.col("l_shipdate").alias("uploaded_at"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("host_no"),
    )


def named_shards(plain: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "checkpoint_id", "rank", "part_no", "host_no", "size_bytes"), 256)
    return plain.withColumns({"shard_id": F.concat(F.lit("rank-"), "rank"), "sha256": digest})


def shards(spark, d) -> DataFrame:
    return named_shards(plain_shards(spark, d)).select(
        "checkpoint_id", "shard_id", "rank", "size_bytes", "uploaded_at", "part_no", "host_no", "sha256"
    )


def run_shards(spark, d) -> DataFrame:
    """Shards with the run of their checkpoint."""
    owner = checkpoints(spark, d).select("checkpoint_id", "run_id", "step", "state", "committed_at")
    return named_shards(plain_shards(spark, d).join(owner, "checkpoint_id")).select(
        "checkpoint_id", "shard_id", "rank", "size_bytes", "uploaded_at", "part_no", "host_no", "sha256", "run_id", "step", "state", "committed_at"
    )


def objects(spark, d) -> DataFrame:
    folder = F.concat_ws("/", "run_id", "checkpoint_id")
    stored = run_shards(spark, d).select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(
                        folder, F.lit("/sha256-"), F.substring("sha256", 1, 16), F.lit("-"), "shard_id", F.lit(".bin")
                    ).alias("key"),
                    F.col("size_bytes").alias("size"),
                ),
                F.struct(
                    F.concat(folder, F.lit("/"), "shard_id", F.lit(".sha256")).alias("key"),
                    F.lit(64).cast("long").alias("size"),
                ),
            )
        ).alias("o"),
        F.col("uploaded_at").alias("modified"),
    ).select("o.key", "o.size", "modified")
    manifests = checkpoints(spark, d).where("state = 'COMMITTED'").select(
        F.concat(folder, F.lit("/_manifest.json")).alias("key"),
        F.lit(512).cast("long").alias("size"),
        F.col("committed_at").alias("modified"),
    )
    return stored.unionByName(manifests)


def failures(spark, d) -> DataFrame:
    return (
        table(spark, d, "orders")
        .where(F.col("o_orderpriority").startswith("1-"))
        .select(
            F.col("o_orderkey").alias("failure_id"),
            F.col("o_custkey").alias("run_id"),
            (F.col("o_orderdate") + hours(F.lit(12))).alias("failed_at"),
        )
    )


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def heartbeats(spark, d) -> DataFrame:
    return heartbeats_of(events(spark, d))


def heartbeats_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("worker_id"),
        (F.col("user_id") % 50).alias("run_id"),
        "ts",
        F.col("event_id").alias("step"),
    )


def registrations(spark, d) -> DataFrame:
    """Each worker registers at its first heartbeat."""
    return heartbeats(spark, d).groupBy("worker_id", "run_id").agg(F.min("ts").alias("registered_at"))


def state_events(spark, d) -> DataFrame:
    return state_events_of(events(spark, d))


def state_events_of(events: DataFrame) -> DataFrame:
    k = F.col("k")
    target = F.when(k == 99, "CANCELLED").when(k == 98, "COMPLETED").otherwise(pick(EVENT_TARGETS, k % 5))
    return events.withColumn("k", props_k()).select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), target.alias("to_state")
    )


def op_log(spark, d) -> DataFrame:
    return op_log_of(events(spark, d))


def op_log_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("op_id"),
        "ts",
        F.col("event_type").alias("method"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("user_id").alias("run_id"),
        (F.col("value") / 50).alias("duration_s"),
        F.round(F.col("value") * 1000).cast("long").alias("bytes"),
        (props_k() % 4).alias("level"),
    )


def trials(spark, d) -> DataFrame:
    k = F.col("k")
    return events(spark, d).withColumn("k", props_k()).select(
        F.col("event_id").alias("trial_id"),
        F.element_at(F.array(F.lit(1), F.lit(10), F.lit(100)), (k % 3 + 1).cast("int")).alias("size_mb"),
        (k % 4 + 1).alias("vus"),
        (F.col("value") / 50).alias("save_s"),
        (F.col("value") / 100).alias("restore_s"),
        (F.col("event_type") != "error").alias("ok"),
    )


def payloads(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("shard_id"),
        F.encode("text", "UTF-8").alias("payload"),
        F.col("source").alias("run_id"),
        F.col("lang").alias("checkpoint_id"),
        F.col("n_chars").alias("size"),
    )


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def train_steps(spark, d) -> DataFrame:
    return events(spark, d).select(
        (F.col("event_id") % 7).alias("run_id"),
        (F.expr("event_id div 7") + 1).alias("step"),
        (F.col("value") / 50).alias("loss"),
        "ts",
    )


def log_lines(spark, d) -> DataFrame:
    return log_lines_of(events(spark, d)).unionByName(notes_of(table(spark, d, "conversations")))


def notes_of(conversations: DataFrame) -> DataFrame:
    minute, second = F.col("conv_id").cast("int"), F.col("turn").cast("int")
    return conversations.select(
        F.lit("notes").alias("source"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=minute, secs=second)).alias("ts"),
        ((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("seq"),
        F.regexp_replace("text", "\n", " ").alias("line"),
    )


def log_lines_of(events: DataFrame) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")

    def fixed(places: int) -> Column:
        unit = 10**places
        tail = F.lpad((F.col("c") % unit).cast("string"), places, "0")
        return F.concat(F.expr(f"c div {unit}").cast("string"), F.lit("."), tail)

    kind, step = F.col("event_type"), F.col("event_id") + 1
    size = F.col("c") * 10
    digest = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16)
    message = (
        F.when(kind == "view", F.concat(F.lit("step="), step, F.lit("/200000  loss="), fixed(4), F.lit("  steps/s="), fixed(1)))
        .when(
            kind == "click",
            F.concat(
                F.lit("Checkpoint saved (runtime): step="), step, F.lit(" loss="), fixed(4), F.lit(" size="), size,
                F.lit(" bytes sha256="), digest, F.lit(" time="), fixed(2), F.lit("s"),
            ),
        )
        .when(
            kind == "purchase",
            F.concat(
                F.lit("Restored from runtime checkpoint: checkpoint_id=ck"), F.col("k"), F.lit(" step="), step,
                F.lit(" size="), size, F.lit(" bytes time="), fixed(2), F.lit("s"),
            ),
        )
        .when((kind == "error") & (F.col("k") % 2 == 0), "Heartbeat to coordinator ended in timeout")
        .when(kind == "error", "Runtime checkpoint failed: connection reset")
        .when(F.col("k") < 50, F.concat(F.lit("Checkpoint ck"), F.col("k"), F.lit(" committed")))
        .otherwise("Registered as worker")
    )
    return events.withColumns({"c": cents, "k": props_k()}).select(
        pick(LOG_SOURCES, F.col("user_id") % 4).alias("source"),
        "ts",
        (F.col("event_id") * 2).alias("seq"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.when(kind == "error", " [ERROR] rank=").otherwise(" [INFO] rank="),
            F.col("user_id") % 4,
            F.lit(" "),
            message,
        ).alias("line"),
    )


def pings(spark, d) -> DataFrame:
    """Visitor pings: one per event, with a forwarded address that is private for some visitors."""
    return events(spark, d).select(
        F.col("user_id").alias("session_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 6 == 0, F.concat(F.lit("10.0.0."), F.col("user_id")))
        .when(F.col("user_id") % 6 == 1, F.concat(F.lit(" 203.0.113."), F.col("user_id"), F.lit(" , 10.1.1.1")))
        .when(F.col("user_id") % 6 == 2, "")
        .otherwise(F.concat(F.lit("198.51.100."), F.col("user_id") % 25, F.lit(",172.16.0.1")))
        .alias("forwarded"),
        F.when(F.col("user_id") % 12 == 2, F.concat(F.lit("192.168.1."), F.col("user_id"))).alias("peer"),
    )


def geo(spark, d) -> DataFrame:
    """Address dimension made of the nations; one of them has no code."""
    key = F.col("n_nationkey")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return table(spark, d, "nation").select(
        F.concat(F.lit("198.51.100."), key).alias("address"),
        F.col("n_name").alias("country"),
        F.when(key == 7, "")
        .otherwise(F.concat(F.substring(F.lit(letters), key + 1, F.lit(1)), F.substring(F.lit(letters), key % 5 + 1, F.lit(1))))
        .alias("country_code"),
    )
