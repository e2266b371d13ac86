"""Validation reports: cycle cost, cadence, soak stability, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.params import PROFILE_BLOCK


def profile_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Least, most, number, total and whole mean of cycle samples by label (and further keys)."""
    return samples.groupBy("label", *keys).agg(
        F.min("cycles").alias("min_cycles"), F.max("cycles").alias("max_cycles"), F.count("*").alias("samples"), F.sum("cycles").alias("total_cycles"), F.expr("sum(cycles) div count(*)").alias("mean_cycles")
    )


def profile_blocks(samples: DataFrame, size: int = PROFILE_BLOCK) -> DataFrame:
    """``profile_stats`` of each block of samples of a label."""
    return profile_stats(samples.withColumn("block", F.expr(f"(n - 1) div {size}")), "block")


def cycles_to_overhead(stats: DataFrame, clock_mhz: float, period_us: float) -> DataFrame:
    """``mean_us`` and ``overhead_pct`` of the mean cycles."""
    us = F.col("mean_cycles") / F.lit(float(clock_mhz))
    return stats.withColumn("mean_us", us).withColumn("overhead_pct", us / F.lit(float(period_us)) * 100)


def cpu_from_idle(idle: Column, period: Column) -> Column:
    """Percent busy: 100 less idle's part of the period; 0 without a period, 100 where idle is over it."""
    busy = 100 - F.floor(idle * 100 / period).cast("long")
    return F.when(period == 0, F.lit(0)).when(busy.between(0, 100), busy).otherwise(F.lit(100)).cast("long")


def cadence(progress: DataFrame) -> DataFrame:
    """Packets a second of each device between the first and the last progress row (device_id, ts, packets); null for one instant."""
    ends = progress.groupBy("device_id").agg(F.min_by("packets", "ts").alias("n0"), F.max_by("packets", "ts").alias("n1"), F.unix_micros(F.min("ts")).alias("t0"), F.unix_micros(F.max("ts")).alias("t1"))
    seconds = (F.col("t1") - F.col("t0")) / 1e6
    return ends.select("device_id", F.when(seconds > 0, (F.col("n1") - F.col("n0")) / seconds).alias("hz"))


def soak_summary(metrics: DataFrame) -> DataFrame:
    """Of each metric and device: samples, least and most value, and whether it was constant."""
    found = metrics.groupBy("metric", "device_id").agg(F.count("*").alias("samples"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return found.withColumn("stable", F.col("min_value").eqNullSafe(F.col("max_value")))


def acceptance_gate(values: DataFrame, gates: list[tuple[str, float, float]]) -> DataFrame:
    """``passed`` for rows (name, value) by the gate of the name, bounds inclusive; null without a gate or value."""
    passed = F.lit(None).cast("boolean")
    for name, low, high in gates:
        passed = F.when(F.col("name") == name, F.col("value").between(low, high)).otherwise(passed)
    return values.withColumn("passed", passed)


def stack_risk(used: Column, total: Column) -> Column:
    """CRITICAL over 90 percent, HIGH over 80, MEDIUM over 70, else LOW; null without a total."""
    share = used * 100 / F.nullif(total, F.lit(0))
    return F.when(share > 90, "CRITICAL").when(share > 80, "HIGH").when(share > 70, "MEDIUM").when(share.isNotNull(), "LOW")


def stack_growth(samples: DataFrame, ahead_seconds: float = 3600.0, min_samples: int = 10) -> DataFrame:
    """``device_id, task_name, samples, predicted, overflow``: a parabola through a task's stack use (x seconds, used) and its value ahead of the last sample.

    Times count from the task's mean in units of its spread, which keeps the power sums well conditioned. Tasks with too few samples, or fewer than three times, have
    no prediction. ``overflow`` compares with the largest ``total``.
    """
    keys = ["device_id", "task_name"]
    base = samples.groupBy(*keys).agg(F.avg("x").alias("_mid"), F.stddev_pop("x").alias("_unit"), F.min("x").alias("_least"), F.max("x").alias("_most"))
    between = (F.col("x") > F.col("_least")) & (F.col("x") < F.col("_most"))  # a third time, found without a group for every time
    u, y = (F.col("x") - F.col("_mid")) / F.col("_unit"), F.col("used").cast("double")
    powers = samples.join(base, keys).filter("_unit > 0").groupBy(*keys).agg(
        F.count("*").alias("samples"), F.max(between).alias("_between"), F.max("total").alias("_total"), F.max((F.col("x") - F.col("_mid") + ahead_seconds) / F.col("_unit")).alias("_u"),
        *[F.sum(F.pow(u, k)).alias(f"_s{k}") for k in (1, 2, 3, 4)], *[F.sum(y * F.pow(u, k)).alias(f"_t{k}") for k in (0, 1, 2)],
    )
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("samples", "_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2"))

    def determinant(rows) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = rows
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = determinant([(n, s1, s2), (s1, s2, s3), (s2, s3, s4)])
    parts = [determinant([(t0, s1, s2), (t1, s2, s3), (t2, s3, s4)]), determinant([(n, t0, s2), (s1, t1, s3), (s2, t2, s4)]), determinant([(n, s1, t0), (s1, s2, t1), (s2, s3, t2)])]
    at = F.col("_u")
    enough = (F.col("samples") >= min_samples) & F.col("_between")
    predicted = F.when(enough, (parts[0] + parts[1] * at + parts[2] * at * at) / F.nullif(whole, F.lit(0.0)))
    return powers.select(*keys, "samples", predicted.alias("predicted"), "_total").withColumn("overflow", F.col("predicted") > F.col("_total")).drop("_total")


def latency(packets: DataFrame, ticks_per_second: int) -> DataFrame:
    """``latency_us`` of each packet: arrival less device time, over the least such difference of its device, which stands for the clocks' offset."""
    apart = F.unix_micros("arrival_ts") - F.expr(f"timestamp_ticks * 1000000 div {ticks_per_second}")
    timed = packets.withColumn("_apart", apart)
    least = timed.groupBy("device_id").agg(F.min("_apart").alias("_offset"))
    return timed.join(least, "device_id").withColumn("latency_us", F.col("_apart") - F.col("_offset")).drop("_apart", "_offset")


def zscore(samples: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """``z`` and ``anomaly`` of each value against its device's mean and population deviation; 0 where that is 0."""
    base = samples.groupBy("device_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    z = F.when(F.col("deviation") > 0, F.abs(F.col(value) - F.col("mean")) / F.col("deviation")).otherwise(F.lit(0.0))
    return samples.join(base, "device_id").withColumn("z", z).withColumn("anomaly", F.col("z") > limit).drop("mean", "deviation")
