"""The labelled metric table: one row a metric, label set and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.operators.quality import loss_ratio
from beaconlake.functions.scan import WIDTH, Scan, ranges
from beaconlake.params import COUNTER_MOD, METRICS, TASK_STATES, THRESHOLDS



def metric_dimension(spark: SparkSession) -> DataFrame:
    """``metric, otel_name, unit, scope, description``: one row a metric family."""
    return spark.createDataFrame(METRICS, "metric string, otel_name string, unit string, scope string, description string")


def task_label(name: Column) -> Column:
    """The name without trailing NULs; ``unknown`` if it is empty or null."""
    bare = F.regexp_replace(name, r"\x00+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def stack_bytes(words: Column) -> Column:
    """Bytes of 4-byte stack words."""
    return words.cast("long") * 4


def cpu_ratio(percent: Column) -> Column:
    return percent / 100.0


def task_cpu_share(tasks: DataFrame) -> DataFrame:
    """``cpu_share``: a task's ticks by all ticks of its device's snapshot (by 1 where there are none)."""
    total = F.sum("runtime_ticks").over(Window.partitionBy("device_id", "snapshot_id"))
    return tasks.withColumn("cpu_share", F.col("runtime_ticks") / F.when(total == 0, F.lit(1)).otherwise(total))


def interval_cpu_share(tasks: DataFrame) -> DataFrame:
    """``cpu_share`` of the ticks since the task's snapshot before (the counter wraps at 2^32); null where the snapshot has no such ticks."""
    before = Scan(["device_id", "task_idx"], ["snapshot_id"], ranges("snapshot_id", WIDTH), before={"_ticks_before": F.col("runtime_ticks")}).over(tasks)
    stepped = before.withColumn("interval_ticks", F.pmod(F.col("runtime_ticks") - F.col("_ticks_before"), F.lit(COUNTER_MOD))).drop("_ticks_before")
    total = F.sum("interval_ticks").over(Window.partitionBy("device_id", "snapshot_id"))
    return stepped.withColumn("cpu_share", F.col("interval_ticks") / F.nullif(total, F.lit(0)))


def cpu_heatmap(shares: DataFrame, seconds: int) -> DataFrame:
    """``device_id, task_label, bucket, cpu_share``: the mean share of each task in each interval, from rows with ``ts``."""
    return shares.groupBy("device_id", "task_label", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.avg("cpu_share").alias("cpu_share")).select("device_id", "task_label", F.col("w.start").alias("bucket"), "cpu_share")


def named_tasks(tasks: DataFrame) -> DataFrame:
    """One row a (device, snapshot, label): of tasks with one label the highest index counts; shares are of all tasks' ticks."""
    shared = task_cpu_share(tasks).withColumn("task_label", task_label(F.col("task_name")))
    kept = shared.groupBy("device_id", "snapshot_id", "task_label").agg(F.max_by(F.struct("task_idx", "state", "stack_hwm_words", "cpu_share"), "task_idx").alias("t"))
    return kept.select("device_id", "snapshot_id", "task_label", "t.*")


def state_onehot(tasks: DataFrame) -> DataFrame:
    """Each task once a state label, with ``value`` 1 for its state and 0 for the others; ids without a label give all zeros."""
    labels = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("state_label")) for i, label in enumerate(TASK_STATES)])
    return tasks.withColumn("s", F.explode(labels)).withColumn("state_label", F.col("s.state_label")).withColumn("value", F.coalesce((F.col("state") == F.col("s.id")).cast("int"), F.lit(0))).drop("s")


def device_metrics(states: DataFrame) -> DataFrame:
    """The device families of every state row: ``metric, device_id, attrs, ts, value``.

    A state has heap_free_bytes, heap_min_ever_bytes, projection, cpu_utilization_pct, drop_count, packet_count and arrival_ts.
    """
    values = {
        "rtos_heap_free_bytes": F.col("heap_free_bytes").cast("double"),
        "rtos_heap_min_ever_bytes": F.col("heap_min_ever_bytes").cast("double"),
        "rtos_heap_oom_projection_seconds": F.col("projection"),
        "rtos_cpu_utilization_ratio": cpu_ratio(F.col("cpu_utilization_pct")),
        "rtos_telemetry_packet_loss_ratio": loss_ratio(F.col("drop_count"), F.col("packet_count")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in values.items()]))
    attrs = F.create_map(F.lit("device_id"), F.col("device_id"))
    return states.select("device_id", attrs.alias("attrs"), F.col("arrival_ts").alias("ts"), each.alias("m")).select("m.metric", "device_id", "attrs", "ts", "m.value")


def task_metrics(tasks: DataFrame) -> DataFrame:
    """The task families of every snapshot, without a time."""
    named = named_tasks(tasks)
    base = F.create_map(F.lit("device_id"), F.col("device_id"), F.lit("task_name"), F.col("task_label"))
    no_time = F.lit(None).cast("timestamp").alias("ts")
    two = F.explode(F.array(
        F.struct(F.lit("rtos_task_stack_watermark_bytes").alias("metric"), stack_bytes(F.col("stack_hwm_words")).cast("double").alias("value")),
        F.struct(F.lit("rtos_task_cpu_ratio").alias("metric"), F.col("cpu_share").alias("value")),
    ))
    plain = named.select("device_id", base.alias("attrs"), two.alias("m")).select("m.metric", "device_id", "attrs", no_time, "m.value")
    states = state_onehot(named).select(
        F.lit("rtos_task_state").alias("metric"), "device_id",
        F.create_map(F.lit("device_id"), F.col("device_id"), F.lit("state"), F.col("state_label"), F.lit("task_name"), F.col("task_label")).alias("attrs"),
        no_time, F.col("value").cast("double").alias("value"),
    )
    return plain.unionByName(states)


def to_metrics(states: DataFrame, tasks: DataFrame) -> DataFrame:
    """All eight families in one table."""
    return device_metrics(states).unionByName(task_metrics(tasks))


def label_text(attrs: Column) -> Column:
    """Labels as ``name="value"`` in the order of names, values escaped."""
    def one(e: Column) -> Column:
        quoted = F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        return F.concat(e["key"], F.lit('="'), quoted, F.lit('"'))

    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), one), ",")


def render_exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of each device: ``device_id, metric, line_no, line`` with help and type first, then the samples in order."""
    dimension = metric_dimension(metrics.sparkSession).select("metric", "description")
    samples = metrics.select("device_id", "metric", F.lit(2).alias("part"), F.concat("metric", F.lit("{"), label_text(F.col("attrs")), F.lit("} "), F.col("value").cast("string")).alias("line"))
    heads = metrics.select("device_id", "metric").distinct().join(F.broadcast(dimension), "metric")
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), F.col("metric"), F.lit(" "), F.col("description")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" gauge")).alias("line")),
    ))
    headers = heads.select("device_id", "metric", both.alias("h")).select("device_id", "metric", "h.part", "h.line")
    place = F.row_number().over(Window.partitionBy("device_id").orderBy("metric", "part", "line"))
    return headers.unionByName(samples).withColumn("line_no", place).select("device_id", "metric", "line_no", "line")


def otel_rename(metrics: DataFrame) -> DataFrame:
    """The convention's names and attribute names, with units."""
    renamed = F.transform_keys("attrs", lambda k, v: F.when(k == "device_id", "device.id").when(k == "task_name", "task.name").otherwise(k))
    return metrics.join(F.broadcast(metric_dimension(metrics.sparkSession)), "metric").select(F.col("otel_name").alias("name"), "unit", renamed.alias("attributes"), "ts", "value")


def _last_values(metrics: DataFrame, seconds: int) -> DataFrame:
    """The last value of each series in each interval ``w``, with what its family is called; of values at one instant the largest.

    A series is its sorted labels: groups are made by them and ``attrs`` is made from them again, so that no row that is sorted holds them twice.
    """
    every = metrics.filter("ts is not null").select("metric", F.sort_array(F.map_entries("attrs")).alias("series"), F.window("ts", f"{seconds} seconds").alias("w"), F.struct("ts", "value").alias("s"))
    last = every.groupBy("metric", "series", "w").agg(F.max("s").alias("s"))
    return last.select("metric", "series", "w", "s.value", "s.ts", F.map_from_entries("series").alias("attrs")).join(F.broadcast(metric_dimension(metrics.sparkSession)), "metric")


def _payload() -> Column:
    points = F.transform("series", lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    return F.to_json(F.struct(F.col("otel_name").alias("name"), "unit", F.struct(F.array(F.struct(points.alias("attributes"), F.col("value").alias("asDouble"))).alias("dataPoints")).alias("data")))


def otlp_export(metrics: DataFrame, seconds: int) -> DataFrame:
    """The last value of each series in each push interval, and its JSON payload; of values at one instant the largest."""
    named = _last_values(metrics, seconds)
    return named.select(F.col("otel_name").alias("name"), "unit", "attrs", F.col("w.start").alias("push_start"), "ts", "value", _payload().alias("payload"))


def _objects(lines: DataFrame, text: Column) -> DataFrame:
    """``object, text``: one a device and interval; a device's series are at most its tasks' and its own."""
    each = lines.groupBy("device_id", "w").agg(F.array_sort(F.collect_list("line")).alias("found"))
    name = F.concat_ws("/", F.coalesce("device_id", F.lit("unknown")), F.date_format("w.start", "yyyy-MM-dd_HH-mm-ss"))
    return each.select(name.alias("object"), text.alias("text"))


def scrape_objects(metrics: DataFrame, seconds: int) -> DataFrame:
    """``object, text``: the metric text of every device and scrape interval, ``<device>/<start of the interval>``; rows of a table, or of a stream with a watermark on ``ts``.

    It has the last value of each series that has one in the interval, with help and type before the first of each family. Values without a time are left out.
    """
    sample = F.concat("metric", F.lit("{"), label_text(F.col("attrs")), F.lit("} "), F.coalesce(F.col("value").cast("string"), F.lit("NaN")))
    lines = _last_values(metrics, seconds).select(F.col("attrs")["device_id"].alias("device_id"), "w", F.struct("metric", sample.alias("sample"), "description").alias("line"))

    def with_head(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("# HELP "), x["metric"], F.lit(" "), x["description"], F.lit("\n# TYPE "), x["metric"], F.lit(" gauge\n"))
        return F.concat(F.when((i > 0) & (F.get("found", i - 1)["metric"] == x["metric"]), F.lit("")).otherwise(head), x["sample"], F.lit("\n"))

    return _objects(lines, F.array_join(F.transform("found", with_head), ""))


def push_objects(metrics: DataFrame, seconds: int) -> DataFrame:
    """``object, text``: what every device pushes in an interval, a payload of ``otlp_export`` a line; rows of a table, or of a stream with a watermark on ``ts``."""
    lines = _last_values(metrics, seconds).select(F.col("attrs")["device_id"].alias("device_id"), "w", _payload().alias("line"))
    return _objects(lines, F.array_join("found", "\n"))


def threshold_class(metrics: DataFrame) -> DataFrame:
    """``class`` of each value by the panel's steps; a projection of -1 is ``stable``; null without steps."""
    band = F.lit(None).cast("string")
    for metric, bound, name in THRESHOLDS:
        band = F.when((F.col("metric") == metric) & (F.col("value") >= F.lit(bound)), F.lit(name)).otherwise(band)
    stable = (F.col("metric") == "rtos_heap_oom_projection_seconds") & (F.col("value") == -1.0)
    return metrics.withColumn("class", F.when(stable, F.lit("stable")).otherwise(band))


def series_cardinality(metrics: DataFrame) -> DataFrame:
    """Distinct series of each device."""
    return metrics.select("device_id", "metric", F.to_json(F.array_sort(F.map_entries("attrs"))).alias("series")).distinct().groupBy("device_id").agg(F.count("*").alias("series"))


def _series() -> Column:
    return F.concat_ws("|", "metric", F.to_json(F.array_sort(F.map_entries("attrs"))))


def series_sketches(metrics: DataFrame, day: Column, bits: int = 12) -> DataFrame:
    """``device_id, day, sketch``: a mergeable sketch of the series that each device has on each day, of at most 2**bits bytes.

    A table of them answers for any range of days and any set of devices without the rows (``estimate_series``). The standard error is about 1 / sqrt(2**bits): 1.6 percent.
    """
    return metrics.groupBy("device_id", day.alias("day")).agg(F.hll_sketch_agg(_series(), F.lit(bits)).alias("sketch"))


def estimate_series(sketches: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``series``: how many distinct series the sketches of each group hold together."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series"))
