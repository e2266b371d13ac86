"""Packet order and counters: gaps, running counts, loss, wrapping counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.functions.scan import WIDTH, by_packet
from beaconlake.params import COUNTER_MOD, SEQ_MOD


def seq_gaps(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """``gap`` (1 at a discontinuity, the first packet never) and ``missing_packets`` (how many numbers were skipped).

    A number is compared with the last known one before it; a packet without a number is no gap itself. ``width`` packet numbers are scanned at once.
    """
    before = by_packet(width, known={"_before_num": F.col("sequence_num")}).over(packets)
    missing = F.pmod(F.col("sequence_num") - F.col("_before_num") - 1, F.lit(SEQ_MOD))
    return before.withColumns({"missing_packets": F.coalesce(missing, F.lit(0)).cast("long"), "gap": F.when(missing > 0, 1).otherwise(0)}).drop("_before_num")


def running_counters(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """``packet_count`` and ``drop_count`` after each packet."""
    return by_packet(width, sums={"packet_count": F.lit(1).cast("long"), "drop_count": F.col("gap").cast("long")}).over(seq_gaps(packets, width))


def loss_ratio(drops: Column, packets: Column) -> Column:
    """Drops by packets; 0 without packets."""
    return F.when(packets > 0, drops / packets).otherwise(F.lit(0.0))


def packet_quality(packets: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Packets, gaps, missing packets and loss of each device; with the decoded ``frames`` also ``crc_drops``, which the loss doesn't count."""
    sums = seq_gaps(packets).groupBy("device_id").agg(F.count("*").alias("packets"), F.sum("gap").cast("long").alias("seq_gaps"), F.sum("missing_packets").alias("missing_packets"))
    rated = sums.withColumn("loss_ratio", loss_ratio(F.col("seq_gaps"), F.col("packets")))
    if frames is None:
        return rated
    dropped = frames.groupBy("device_id").agg(F.count_if(F.col("status") == "crc").alias("crc_drops"))
    return rated.join(dropped, "device_id", "left").withColumn("crc_drops", F.coalesce("crc_drops", F.lit(0)))


def counter_unwrap(readings: DataFrame, value: str = "raw_ticks", modulus: int = COUNTER_MOD, width: int = WIDTH) -> DataFrame:
    """``elapsed`` since the reading before (modulo the counter's range) and ``unwrapped``, the sum of them."""
    before = by_packet(width, before={"_before_value": F.col(value)}, first={"_first_value": F.col(value)}).over(readings)
    elapsed = F.coalesce(F.pmod(F.col(value) - F.col("_before_value"), F.lit(modulus)), F.lit(0)).cast("long")
    summed = by_packet(width, sums={"_elapsed_sum": F.col("elapsed")}).over(before.withColumn("elapsed", elapsed))
    return summed.withColumn("unwrapped", F.col("_first_value") + F.col("_elapsed_sum")).drop("_before_value", "_first_value", "_elapsed_sum")


def device_offline(packets: DataFrame, now: Column | DataFrame, timeout_seconds: int) -> DataFrame:
    """``device_id, last_seen, offline``: silent for more than the timeout at ``now`` (strictly), a column or a table of one row with such a column."""
    last = packets.groupBy("device_id").agg(F.max("arrival_ts").alias("last_seen"))
    if isinstance(now, DataFrame):
        timed = last.crossJoin(F.broadcast(now.select("now")))
        return device_state_at(timed, F.col("now"), timeout_seconds).drop("now")
    return device_state_at(last, now, timeout_seconds)


def device_state_at(last: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """``offline`` for rows with ``last_seen``."""
    return last.withColumn("offline", (F.unix_micros(now) - F.unix_micros("last_seen")) > timeout_seconds * 1_000_000)


def last_n_per_device(packets: DataFrame, n: int) -> DataFrame:
    """The last n packets of each device."""
    place = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("pkt_no")))
    return packets.withColumn("from_end", place).filter(F.col("from_end") <= n)
