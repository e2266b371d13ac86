"""The registry of devices from the state that a stream keeps, without a replay; and streams that begin with a registry.

Spark's state data source reads a checkpoint's state as a table: looking a device up makes no entry, listing is a select, and ``batch`` gives the state as it was
after an earlier micro-batch that is still kept. A registry has a row a device (RECORDS); ``of_stream`` takes it from a checkpoint of ``stream_full_state``,
``of_packets`` from a table of packets, with aggregates that tasks add up before anything is shuffled. ``stream_from`` starts a stream with one: after a batch run,
after devices were purged from it (``purged``), or under a new checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions.tables import kept
from beaconlake.params import SYSTEM_TAG
from beaconlake.sources.frames import FIELDS, expand_payloads, task_names
from beaconlake.streaming.processors import full_state_rows, use_rocksdb

FIELD_NAMES = [name for name, _ in FIELDS.values()]
_TASK, _SYSTEM = FIELD_NAMES[:4], FIELD_NAMES[4:]
#: Of devices without a keyframe the epoch is 0, the system's fields are null and there are no tasks; tasks come in order.
RECORDS = (
    f"device_id string, pkt_no long, epoch long, {', '.join(f'{f} long' for f in _SYSTEM)}, tasks array<struct<task_idx:int,task_name:string,{','.join(f'{f}:bigint' for f in _TASK)}>>"
)


def read_state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """The entries of one state variable: the key's columns, those of a map's key, and those of the value."""
    use_rocksdb(spark)
    reader = spark.read.format("statestore").option("stateVarName", variable).option("operatorId", operator)
    found = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    parts = [c for c in ("key", "user_map_key", "value", "user_map_value") if c in found.columns]
    return found.select(*[f"{c}.*" for c in parts])


def of_stream(spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """Columns of RECORDS from a checkpoint of ``stream_full_state``; in a chain, ``operator`` says which stateful operator that is."""
    system = read_state(spark, checkpoint, "system", operator, batch)
    task = F.struct("task_idx", "task_name", *_TASK)
    tasks = read_state(spark, checkpoint, "tasks", operator, batch).groupBy("device_id").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    joined = system.alias("s").join(tasks.alias("t"), F.expr("s.device_id <=> t.device_id"), "left")
    return _records(joined.select("s.*", "t.tasks"))


def of_packets(packets: DataFrame) -> DataFrame:
    """Columns of RECORDS from ``device_id, pkt_no, packet_type, payload``: the state after each device's last packet."""
    changes = kept(expand_payloads(packets), "changes")
    last = F.max_by(F.struct("epoch", "value"), F.struct("epoch", "pkt_no", "place")).alias("of")
    fields = changes.filter("field is not null").groupBy("device_id", "scope", "task_idx", "field").agg(last)
    names = task_names(packets).groupBy("device_id", "task_idx").agg(F.max_by("task_name", "epoch").alias("task_name"))
    named = fields.alias("f").join(names.alias("n"), F.expr("f.device_id <=> n.device_id and f.task_idx = n.task_idx and f.scope = 'task'"), "left")
    wide = named.groupBy("f.device_id", "f.task_idx").agg(
        F.max("of.epoch").alias("epoch"), F.first("task_name").alias("task_name"), *[F.max(F.when((F.col("field") == f), F.col("of.value"))).alias(f) for f in FIELD_NAMES]
    )
    # a keyframe gives every field of all tasks that there are, so what has an older epoch is gone
    task = F.when(F.col("task_idx") != SYSTEM_TAG, F.struct(F.col("epoch").alias("of"), F.struct("task_idx", "task_name", *_TASK).alias("t")))
    own = [F.max(F.when(F.col("task_idx") == SYSTEM_TAG, F.col(f))).alias(f) for f in _SYSTEM]
    states = wide.groupBy("device_id").agg(F.max("epoch").alias("epoch"), *own, F.collect_list(task).alias("all"))
    living = F.array_sort(F.transform(F.filter("all", lambda x: x["of"] == F.col("epoch")), lambda x: x["t"]))
    states = states.select("device_id", "epoch", *_SYSTEM, living.alias("tasks"))
    ends = packets.groupBy("device_id").agg(F.max("pkt_no").alias("pkt_no"))
    joined = ends.alias("e").join(states.alias("s"), F.expr("e.device_id <=> s.device_id"), "left")
    return _records(joined.select("e.device_id", "e.pkt_no", F.coalesce("s.epoch", F.lit(0)).alias("epoch"), *_SYSTEM, "tasks"))


def _records(rows: DataFrame) -> DataFrame:
    names = ["device_id", "pkt_no", "epoch", *_SYSTEM]
    kind = RECORDS.split("tasks ")[1]
    return rows.select(*names, F.coalesce(F.col("tasks").cast(kind), F.array().cast(kind)).alias("tasks"))


def purged(records: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry without the devices of ``gone``."""
    return records.join(gone.select("device_id").distinct(), "device_id", "left_anti")


def stream_from(packets: DataFrame, records: DataFrame, samples: bool = False) -> DataFrame:
    """``stream_full_state`` that begins with a registry: packets up to a device's ``pkt_no`` there are late, and the next ones go on from its state.

    Only a new checkpoint takes the registry in; a restarted stream goes on from its own.
    """
    return full_state_rows(packets, samples, records.select(*[f.split()[0] for f in RECORDS.split(", ")]))
