"""Telemetry-shaped views over the provided tables, in Spark and as SQL text for the twins.

Packets of a device are numbered and summed by ranges of event numbers, so that a device with most events isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.functions.scan import WIDTH, Scan, ranges
from beaconlake.params import COUNTER_MOD, MAX_TASKS, SEQ_MOD



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_event(**sums: Column) -> Scan:
    """Running sums over the events of each user."""
    return Scan(["user_id"], ["event_id"], ranges("event_id", WIDTH), sums=sums)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet an event; heap falls, is noisy, or swings, by user."""
    state = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 4)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("arrival_ts"), state.alias("state"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    numbered = by_event(pkt_no=F.lit(1).cast("long"), spent=F.col("cents")).over(events)
    spent = F.col("spent")
    heap = (
        F.when(F.col("user_id") % 3 == 0, 1000000 - spent)
        .when(F.col("user_id") % 3 == 1, 500000 + F.col("cents"))
        .otherwise(F.when(F.col("pkt_no") % 2 == 0, F.lit(900000)).otherwise(800000 - 4000 * F.col("pkt_no")))
    )
    return numbered.select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), "pkt_no", "arrival_ts",
        (F.col("event_id") % SEQ_MOD).cast("int").alias("sequence_num"), "state", heap.cast("long").alias("heap_free_bytes"),
        (F.floor("value") % 101).cast("int").alias("cpu_utilization_pct"), "event_id",
    )


TELEMETRY = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pkt_no, CAST(round(value * 100) AS BIGINT) AS cents,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS state
  FROM events
), telemetry AS (
  SELECT 'dev-' || user_id AS device_id, pkt_no, ts AS arrival_ts, CAST(event_id % 65536 AS INTEGER) AS sequence_num, state,
    CAST(CASE user_id % 3 WHEN 0 THEN 1000000 - sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
      WHEN 1 THEN 500000 + cents ELSE CASE WHEN pkt_no % 2 = 0 THEN 900000 ELSE 800000 - 4000 * pkt_no END END AS BIGINT) AS heap_free_bytes,
    CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS cpu_utilization_pct, event_id
  FROM numbered
)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as keyframes (every 50th packet from the third) and deltas with some fields absent and one task change each."""
    key = F.col("pkt_no") % 50 == 3
    return telemetry(spark, sf_dir).select(
        "device_id", "pkt_no", "event_id", "state", "sequence_num", key.alias("is_valid_keyframe"), F.when(key, 2).otherwise(1).alias("packet_type"),
        F.when(key | (F.col("event_id") % 3 != 0), F.col("heap_free_bytes")).alias("heap_d"), F.when(key | (F.col("event_id") % 2 != 1), F.col("cpu_utilization_pct")).alias("cpu_d"),
        F.when(~key, (F.col("event_id") % 6).cast("int")).alias("task_idx_d"), F.when(~key, F.col("state")).alias("state_d"), F.when(key, F.lit(4)).alias("task_count"),
    )


CHANGES = (
    TELEMETRY
    + """, changes AS (
  SELECT device_id, pkt_no, event_id, state, sequence_num, pkt_no % 50 = 3 AS is_valid_keyframe, CASE WHEN pkt_no % 50 = 3 THEN 2 ELSE 1 END AS packet_type,
    CASE WHEN pkt_no % 50 = 3 OR event_id % 3 <> 0 THEN heap_free_bytes END AS heap_d, CASE WHEN pkt_no % 50 = 3 OR event_id % 2 <> 1 THEN cpu_utilization_pct END AS cpu_d,
    CASE WHEN pkt_no % 50 <> 3 THEN CAST(event_id % 6 AS INTEGER) END AS task_idx_d, CASE WHEN pkt_no % 50 <> 3 THEN state END AS state_d, CASE WHEN pkt_no % 50 = 3 THEN 4 END AS task_count
  FROM telemetry
), epochs AS (
  SELECT *, CAST(sum(CASE WHEN is_valid_keyframe THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY pkt_no) AS BIGINT) AS epoch FROM changes
)"""
)

#: Apart from the orders' numbers: what the second and later snapshots of an order are moved by.
SNAPSHOT_PARTS = 1 << 40
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task a line item; a snapshot for every 16 line items of an order (the first has the order's number)."""
    by_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    code = F.concat("l_returnflag", "l_linestatus")
    state = F.when(code == "AF", 0).when(code == "AO", 1).when(code == "NF", 2).when(code == "NO", 3).when(code == "RF", 4).otherwise(5)
    place = F.row_number().over(by_order) - 1
    numbered = table(spark, sf_dir, "lineitem").withColumns({"task_idx": place % MAX_TASKS, "part": F.floor(place / MAX_TASKS)})
    return numbered.select(
        F.concat(F.lit("dev-"), (F.col("l_orderkey") % 100).cast("string")).alias("device_id"), (F.col("l_orderkey") + F.col("part") * F.lit(SNAPSHOT_PARTS)).alias("snapshot_id"), "task_idx",
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("task-"), F.col("l_linenumber").cast("string"))).alias("task_name"), state.alias("state"),
        F.col("l_linenumber").alias("priority"), F.col("l_quantity").cast("int").alias("stack_hwm_words"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("runtime_ticks"),
    )


TASKS = f"""task_rows AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS place FROM lineitem
), tasks AS (
  SELECT 'dev-' || (l_orderkey % 100) AS device_id, l_orderkey + place // {MAX_TASKS} * {SNAPSHOT_PARTS} AS snapshot_id, CAST(place % {MAX_TASKS} AS INTEGER) AS task_idx, CASE WHEN l_linenumber = 7 THEN '' ELSE 'task-' || l_linenumber END AS task_name,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS state,
    l_linenumber AS priority, CAST(l_quantity AS INTEGER) AS stack_hwm_words, CAST(round(l_extendedprice * 100) AS BIGINT) AS runtime_ticks
  FROM task_rows
)"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle samples of three labels; ``n`` numbers the samples of a label.

    The number is a global order of a label, so it is made from the counts of order ranges and a rank inside each: no task orders a whole label.
    """
    keys = ["l_orderkey", *LINE_ORDER]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), *keys, (F.col("l_orderkey") / 1000).cast("long").alias("bin"))
    counts = rows.groupBy("label", "bin").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("label", "bin", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("label", "bin").orderBy(*keys))
    ranked = rows.withColumn("inside", inside).join(placed, ["label", "bin"])
    return ranked.select("label", (F.col("before") + F.col("inside")).alias("n"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cycles"))


CYCLES = """cycles AS (
  SELECT l_returnflag AS label, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cycles FROM lineitem
)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of 32 bits that wraps."""
    summed = by_event(pkt_no=F.lit(1).cast("long"), total=F.round(F.col("value") * 5000000).cast("long")).over(table(spark, sf_dir, "events"))
    return summed.select(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), "pkt_no", F.pmod("total", F.lit(COUNTER_MOD)).alias("raw_ticks"))


COUNTERS = """counters AS (
  SELECT 'dev-' || user_id AS device_id, row_number() OVER w AS pkt_no, CAST(sum(CAST(round(value * 5000000) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) % 4294967296 AS BIGINT) AS raw_ticks
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
)"""


def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle and period counts, with periods of zero and idle over the period."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("idle"), (10 * F.col("l_linenumber") - 10).cast("long").alias("period"))
