"""Dashboard questions over the metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.functions.scan import Scan


def of_device(metrics: DataFrame, device_id: str | None) -> DataFrame:
    """The rows of one device, or all."""
    return metrics if device_id is None else metrics.filter(F.col("device_id") == device_id)


def label_values(metrics: DataFrame, metric: str) -> DataFrame:
    """Devices that report a metric, ascending."""
    return metrics.filter(F.col("metric") == metric).select("device_id").distinct().orderBy("device_id")


def last_not_null(metrics: DataFrame, order: Column, device_id: str | None = None) -> DataFrame:
    """The last value that isn't null of each metric and device (or of one device), by ``order``."""
    return of_device(metrics, device_id).filter("value is not null").groupBy("metric", "device_id").agg(F.max_by("value", order).alias("value"))


def panel_timeseries(metrics: DataFrame, names: list[str], start: Column, end: Column, seconds: int, order: Column, device_id: str | None = None) -> DataFrame:
    """The last value of each bucket in [start, end) for each metric and device (or of one device)."""
    ranged = of_device(metrics, device_id).filter(F.col("metric").isin(*names) & (F.col("ts") >= start) & (F.col("ts") < end))
    return ranged.groupBy("metric", "device_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.max_by("value", order).alias("value")).select("metric", "device_id", F.col("w.start").alias("bucket"), "value")


def sampled(packets: DataFrame, seconds: int, value: str) -> DataFrame:
    """The last value in each interval in which the device sent one: ``device_id, bucket, value``."""
    last = packets.groupBy("device_id", F.window("arrival_ts", f"{seconds} seconds").alias("w")).agg(F.max_by(value, "pkt_no").alias(value))
    return last.select("device_id", F.col("w.start").alias("bucket"), value)


def sampled_asof(packets: DataFrame, scrapes: DataFrame, value: str, seconds: int = 3600) -> DataFrame:
    """The value that each scrape (device_id, scrape_ts) sees: that of the last packet at or before it; null before the first.

    Packets and scrapes are put in one order of each device, and the last value is carried forward: no range join. ``seconds`` of a device are scanned at once.
    """
    both = packets.select("device_id", F.col("arrival_ts").alias("ts"), F.lit(0).alias("scrape"), "pkt_no", F.col(value).alias("v")).unionByName(
        scrapes.select("device_id", F.col("scrape_ts").alias("ts"), F.lit(1).alias("scrape"), F.lit(None).cast("long").alias("pkt_no"), F.lit(None).cast(packets.schema[value].dataType).alias("v"))
    )
    seen = Scan(["device_id"], ["ts", "scrape", "pkt_no"], F.floor(F.unix_micros("ts") / (seconds * 1_000_000)), last={"seen": F.col("v")}).over(both)
    return seen.filter("scrape = 1").select("device_id", F.col("ts").alias("scrape_ts"), F.col("seen").alias(value))


def progress(packets: DataFrame, seconds: int) -> DataFrame:
    """Cumulative packets and gaps of each device at the end of each interval: ``device_id, bucket, packets, seq_gaps``."""
    each = packets.groupBy("device_id", F.window("arrival_ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("c"), F.sum("gap").alias("g"))
    so_far = Window.partitionBy("device_id").orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("device_id", F.col("w.start").alias("bucket"), F.sum("c").over(so_far).alias("packets"), F.sum("g").over(so_far).cast("long").alias("seq_gaps"))
