"""Entities kept as JSON values under path-like keys, their validation, and change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.schemas import ENTITIES, ENTITY_DEFAULTS, RUN_CONFIG, RUN_CONFIG_DEFAULTS, SHARDING_POLICIES

ROOT = "/runledger"


def entity_key(kind: str, *ids: Column | str, root: str = ROOT) -> Column:
    return F.concat_ws("/", F.lit(f"{root}/{kind}"), *ids)


def _with_defaults(entity: Column, schema: T.StructType, defaults: dict) -> list[Column]:
    """The fields of an entity, those with a default without nulls."""

    def value(field: T.StructField) -> Column:
        found = entity[field.name]
        if field.name not in defaults:
            return found
        default = defaults[field.name]
        if isinstance(default, dict):
            return F.coalesce(found, F.create_map().cast(field.dataType))
        return F.coalesce(found, (F.array() if isinstance(default, list) else F.lit(default)).cast(field.dataType))

    return [value(f).alias(f.name) for f in schema.fields]


def read_entities(kv: DataFrame, kind: str, *ids: str, root: str = ROOT) -> DataFrame:
    """Decode the values of one kind from (key, value) rows.

    Without ids all entities; with all ids of a key that one entity; workers also take just a run id.
    An unknown id gives no row. On Parquet laid out by kind the prefix is a pushed-down filter.
    Fields that a value leaves out or holds as null are read as their defaults; a value that is no JSON gives a row of defaults and nulls.
    """
    path = "/".join([f"{root}/{kind}", *ids])
    depth = 2 if kind == "workers" else 1
    wanted = F.col("key") == path if len(ids) == depth else F.col("key").startswith(path + "/")
    entities = kv.where(wanted).select(F.from_json("value", ENTITIES[kind]).alias("e"))
    fields = entities.select(*_with_defaults(F.col("e"), ENTITIES[kind], ENTITY_DEFAULTS[kind]))
    if kind != "runs":
        return fields
    config = F.struct(*_with_defaults(F.col("config"), RUN_CONFIG, RUN_CONFIG_DEFAULTS))
    return fields.withColumn("config", F.when(F.col("config").isNotNull(), config))


def run_errors() -> Column:
    """Every rule a run configuration breaks."""
    length = F.length("name")
    rules = {
        "name length outside 1..256": length.isNull() | (length < 1) | (length > 256),
        "num_workers not positive": F.coalesce(F.col("num_workers") <= 0, F.lit(True)),
        "checkpoint_interval_steps not positive": F.coalesce(F.col("checkpoint_interval_steps") <= 0, F.lit(True)),
        "max_steps not positive": F.coalesce(F.col("max_steps") <= 0, F.lit(False)),
        "unknown sharding_policy": ~F.coalesce(F.col("sharding_policy").isin(SHARDING_POLICIES), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for text, broken in rules.items()]))


def validate_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with the list of broken rules)."""
    checked = runs.withColumn("errors", run_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def latest_by_key(changes: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Current rows of a put/delete log: the last put wins, a delete removes, deleting nothing is no error."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.where(F.col(f"r.{op}") != "delete").select(*key, *[f"r.{c}" for c in rest if c != op])
