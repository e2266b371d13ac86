"""Leak analytics over the last samples of each device.

Windows of ``window_size`` samples are not computed anew for every sample: a device's samples are cut into blocks of that size, a block and the one before it come
together, and a window is a difference of running sums or the minimum of two running minima there. The work is linear in the samples, and a device with very many
samples is as many groups as it has blocks. Sums are exact decimals of microseconds and bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.params import OomParams

#: Samples are numbered inside ranges of so many packet numbers, so that no task orders a whole device.
RANGE = 1 << 16


def numbered(samples: DataFrame) -> DataFrame:
    """``sample`` (0 for a device's first) and ``_window_samples`` (how many it has), in the order of ``pkt_no``."""
    ranged = samples.withColumn("_window_range", F.floor(F.col("pkt_no") / RANGE))
    counts = ranged.groupBy("device_id", "_window_range").agg(F.count("*").alias("_window_held"))
    of = Window.partitionBy("device_id").orderBy("_window_range")
    before = counts.select(
        "device_id", "_window_range", (F.sum("_window_held").over(of.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_window_held")).alias("_window_before"), F.sum("_window_held").over(Window.partitionBy("device_id")).alias("_window_samples")
    )
    inside = F.row_number().over(Window.partitionBy("device_id", "_window_range").orderBy("pkt_no")) - 1
    return ranged.withColumn("_window_inside", inside).join(before, ["device_id", "_window_range"]).withColumn("sample", F.col("_window_before") + F.col("_window_inside")).drop("_window_range", "_window_inside", "_window_before")


def windowed(samples: DataFrame, p: OomParams) -> DataFrame:
    """The samples with ``n``, ``window_min``, ``window_max``, ``window_first_pkt``, ``first_half_min``, ``one_time``, ``slope`` and ``r2`` of the last ``window_size``.

    ``first_half_min`` is the minimum of the first half (rounded down) of the window, null where it is empty; ``slope`` and ``r2`` are those of the least-squares
    line in bytes a second, 0 where all times or (r2) all values are equal. ``sample`` numbers a device's samples from 0. Columns of these names in ``samples`` are
    replaced, all others stay; names that begin with ``_window_`` are this module's own.
    """
    size, half = p.window_size, max(1, p.window_size // 2)
    block = F.expr(f"sample div {size}")
    # a block comes a second time as the one before the next, unless it is the device's last
    twice = F.when((block + 1) * size < F.col("_window_samples"), F.array(block, block + 1)).otherwise(F.array(block))
    each = numbered(samples).withColumn("_window_blk", F.explode(twice)).withColumns({"_window_at": F.unix_micros("arrival_ts"), "_window_y": F.col("heap_free_bytes").cast("long"), "_window_sub": F.expr(f"sample div {half}")})
    order = Window.partitionBy("device_id", "_window_blk").orderBy("sample")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sub = Window.partitionBy("device_id", "_window_blk", "_window_sub")
    running, ending = sub.orderBy("sample").rowsBetween(Window.unboundedPreceding, 0), sub.orderBy(F.desc("sample")).rowsBetween(Window.unboundedPreceding, 0)

    def exact(value: Column) -> Column:
        return value.cast("decimal(38,0)")

    x = F.col("_window_x").cast("decimal(19,0)")
    y = F.col("_window_y").cast("decimal(19,0)")
    moved = each.withColumns({
        "_window_x": F.col("_window_at") - F.first("_window_at").over(so_far),
        "_window_turn": F.coalesce((F.col("_window_at") != F.lag("_window_at").over(order)).cast("long"), F.lit(0)),
        "_window_min_run": F.min("_window_y").over(running), "_window_max_run": F.max("_window_y").over(running), "_window_min_end": F.min("_window_y").over(ending), "_window_max_end": F.max("_window_y").over(ending),
    })
    sums = {"_window_sx": x, "_window_sy": y, "_window_sxx": exact(x * x), "_window_sxy": exact(x * y), "_window_syy": exact(y * y)}
    run = moved.withColumns({
        **{name: exact(F.sum(value).over(so_far)) for name, value in sums.items()},
        "_window_turns": F.sum("_window_turn").over(so_far), "_window_least": F.min("_window_y").over(so_far), "_window_most": F.max("_window_y").over(so_far),
        # of the last half window, from a part's end and the next part's beginning
        "_window_min_half": F.least("_window_min_run", F.lag("_window_min_end", half - 1).over(order)), "_window_max_half": F.greatest("_window_max_run", F.lag("_window_max_end", half - 1).over(order)),
    })
    full = F.col("sample") >= size - 1
    inner = [F.lag("_window_y", half).over(order)] if size % 2 and size > 1 else []
    early = F.collect_list(F.when(F.col("sample") < size // 2, F.col("_window_least"))).over(Window.partitionBy("device_id", "_window_blk").orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.least(F.col("sample") + 1, F.lit(size))
    cut = run.withColumns({
        "n": n,
        "window_min": F.when(full, F.least("_window_min_half", F.lag("_window_min_half", size - half).over(order), *inner)).otherwise(F.col("_window_least")),
        "window_max": F.when(full, F.greatest("_window_max_half", F.lag("_window_max_half", size - half).over(order), *inner)).otherwise(F.col("_window_most")),
        "window_first_pkt": F.coalesce(F.lag("pkt_no", size - 1).over(order), F.first("pkt_no").over(so_far)),
        "first_half_min": (F.when(full, F.lag("_window_min_half", size - half).over(order)).otherwise(F.get(early, (n.cast("int") / 2).cast("int") - 1)) if size > 1 else F.lit(None).cast("long")),
        "one_time": F.col("_window_turns") == F.coalesce(F.lag("_window_turns", size - 1).over(order), F.lit(0)),
        **{name: exact(F.col(name) - F.coalesce(F.lag(name, size).over(order), F.lit(0).cast("decimal(38,0)"))) for name in sums},
    }).filter(block == F.col("_window_blk"))
    many = F.col("n").cast("decimal(10,0)")

    def spread(both: str, one: str, other: str) -> Column:
        """n times the sum of products about the means."""
        return (exact(many * F.col(both)) - exact(F.col(one) * F.col(other))).cast("double")

    fitted = cut.withColumns({"_window_xx": spread("_window_sxx", "_window_sx", "_window_sx"), "_window_xy": spread("_window_sxy", "_window_sx", "_window_sy"), "_window_yy": spread("_window_syy", "_window_sy", "_window_sy")})
    slope = F.when(F.col("one_time"), F.lit(0.0)).otherwise(F.col("_window_xy") / F.col("_window_xx") * 1e6)
    r2 = F.when(F.col("one_time") | (F.col("_window_yy") == 0), F.lit(0.0)).otherwise(F.col("_window_xy") / F.col("_window_xx") * (F.col("_window_xy") / F.col("_window_yy")))
    return fitted.withColumns({"slope": slope, "r2": r2}).drop(*[c for c in fitted.columns if c.startswith("_window_") and c not in samples.columns])


def heap_window(samples: DataFrame, p: OomParams) -> DataFrame:
    """``n``, ``window_min``, ``window_max`` and ``window_first_pkt`` of the last ``window_size`` samples, and ``sample`` (their number so far)."""
    return windowed(samples, p).withColumn("sample", F.col("sample") + 1).drop("first_half_min", "one_time", "slope", "r2")


def first_half_min(samples: DataFrame, p: OomParams) -> DataFrame:
    """``heap_window`` with ``first_half_min``: the minimum of the first half (rounded down) of the window; null where it is empty."""
    return windowed(samples, p).withColumn("sample", F.col("sample") + 1).drop("one_time", "slope", "r2")


def heap_trend(samples: DataFrame, p: OomParams) -> DataFrame:
    """``n, one_time, slope, r2`` of the least-squares line through the window, in bytes a second.

    Both are 0 where all times or (r2) all values are equal.
    """
    return windowed(samples, p).drop("sample", "window_min", "window_max", "window_first_pkt", "first_half_min")


def oom_series(samples: DataFrame, p: OomParams, devices: DataFrame | None = None) -> DataFrame:
    """``projection`` and ``verdict`` at every sample.

    Seconds to exhaustion for a leak (negative slope, r2 at the threshold or over), -2 where the window's minimum fell from its first half by more than the threshold's
    part of the total heap, else -1; -1 also with few samples or where all times are equal. ``devices`` may give ``total_heap_bytes`` by device_id.
    """
    trend = windowed(samples, p).withColumn("sample", F.col("sample") + 1)
    return _judged(trend, p, devices)


def _judged(trend: DataFrame, p: OomParams, devices: DataFrame | None) -> DataFrame:
    """``projection`` and ``verdict`` of rows with a window's measures."""
    total = F.lit(p.total_heap_bytes)
    if devices is not None:
        heaps = devices.select(F.col("device_id"), F.col("total_heap_bytes").alias("_device_heap"))
        trend = trend.join(heaps, "device_id", "left")
        total = F.coalesce(F.col("_device_heap"), total)
    leak = (F.col("slope") < 0) & (F.col("r2") >= p.r_squared_threshold)
    drop = (F.col("first_half_min") - F.col("window_min")) / total
    projection = (
        F.when((F.col("n") < p.min_samples) | F.col("one_time"), F.lit(-1.0))
        .when(leak, F.col("heap_free_bytes") / F.abs("slope"))
        .when(drop > p.rolling_min_threshold, F.lit(-2.0))
        .otherwise(F.lit(-1.0))
    )
    verdict = F.when(F.col("projection") >= 0, "leak").when(F.col("projection") == -2.0, "falling minimum").otherwise("stable")
    return trend.withColumn("projection", projection).withColumn("verdict", verdict).drop("_device_heap")


def latest_projection(samples: DataFrame, p: OomParams, devices: DataFrame | None = None) -> DataFrame:
    """``device_id, pkt_no, arrival_ts, heap_free_bytes, n, window_min, first_half_min, one_time, slope, r2, projection, verdict`` of each device's last sample.

    What ``oom_series`` says of it, without the series: tasks keep a device's last ``window_size`` samples at most before anything is sent, and one fit is made from their sums.
    """
    last = Window.partitionBy("device_id").orderBy(F.desc("pkt_no"))
    few = samples.select("device_id", "pkt_no", "arrival_ts", F.col("heap_free_bytes").cast("long").alias("heap_free_bytes"))
    kept = few.withColumn("from_end", F.row_number().over(last)).filter(F.col("from_end") <= p.window_size)
    window = Window.partitionBy("device_id")
    at, y = F.unix_micros("arrival_ts"), F.col("heap_free_bytes")
    placed = kept.withColumns({"n": F.count("*").over(window), "x": (at - F.min(at).over(window)).cast("decimal(19,0)"), "y": y.cast("decimal(19,0)")})
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("decimal(38,0)")
    early = F.when(F.col("from_end") > F.col("n") - F.floor(F.col("n") / 2), y)
    each = placed.groupBy("device_id").agg(
        F.max_by(F.struct("pkt_no", "arrival_ts", "heap_free_bytes"), "pkt_no").alias("latest"), F.max("n").alias("n"), F.min(y).alias("window_min"), F.min(early).alias("first_half_min"),
        (F.min("x") == F.max("x")).alias("one_time"), exact(F.col("x")).alias("sx"), exact(F.col("y")).alias("sy"),
        *[exact(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")],
    )
    many = F.col("n").cast("decimal(10,0)")

    def spread(both: str, one: str, other: str) -> Column:
        return ((many * F.col(both)).cast("decimal(38,0)") - (F.col(one) * F.col(other)).cast("decimal(38,0)")).cast("double")

    fitted = each.select("device_id", "latest.*", "n", "window_min", "first_half_min", "one_time", spread("sxx", "sx", "sx").alias("xx"), spread("sxy", "sx", "sy").alias("xy"), spread("syy", "sy", "sy").alias("yy"))
    slope = F.when(F.col("one_time"), F.lit(0.0)).otherwise(F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)) * 1e6)
    r2 = F.when(F.col("one_time") | (F.col("yy") == 0), F.lit(0.0)).otherwise(F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)) * (F.col("xy") / F.nullif(F.col("yy"), F.lit(0.0))))
    return _judged(fitted.withColumns({"slope": slope, "r2": r2}).drop("xx", "xy", "yy"), p, devices)


def leak_strict(samples: DataFrame, p: OomParams, max_slope: float = -10.0, min_r2: float = 0.8, min_samples: int = 60) -> DataFrame:
    """``leak`` of each sample's window by stricter rules: samples enough, a slope under ``max_slope`` and r2 over ``min_r2``; ``hours`` to exhaustion where it is one.

    The slope's test at the level 0.01 is implied: with 60 samples and an r2 of 0.8 its t value is over 15.
    """
    leak = (F.col("n") >= min_samples) & (F.col("slope") < max_slope) & (F.col("r2") > min_r2)
    return windowed(samples, p).withColumn("leak", leak).withColumn("hours", F.when(F.col("leak"), F.col("heap_free_bytes") / F.abs("slope") / 3600))


def leak_alerts(series: DataFrame) -> DataFrame:
    """Samples that call for an alert, of kind ``leak`` (projection over 0) or ``falling minimum``."""
    return series.filter((F.col("projection") > 0) | (F.col("projection") == -2.0)).withColumn("kind", F.col("verdict"))
