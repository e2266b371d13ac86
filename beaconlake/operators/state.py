"""Device state from keyframes and deltas, and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.functions.scan import WIDTH, Scan, by_packet, ranges
from beaconlake.operators.quality import seq_gaps
from beaconlake.params import KEYFRAME_EVERY, SYSTEM_TAG


def _epochs(packets: DataFrame, width: int, **what) -> DataFrame:
    """``epoch``, ``has_baseline`` and further columns of one scan; values in ``last`` are carried inside an epoch."""
    epoch = {"epoch": F.col("is_valid_keyframe").cast("long")}
    return by_packet(width, sums=epoch, reset=F.col("is_valid_keyframe"), **what).over(packets).withColumn("has_baseline", F.col("epoch") > 0)


def keyframe_epoch(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """``epoch``: number of valid keyframes so far; 0 before the first, when deltas mean nothing. ``width`` packet numbers are scanned at once."""
    return _epochs(packets, width)


def rebuild_state(packets: DataFrame, fields: dict[str, str], width: int = WIDTH) -> DataFrame:
    """The value of each field after each packet: the last one given since the epoch's keyframe.

    ``fields`` maps a delta column, null where the packet doesn't give it, to the state column. Packets before the first keyframe have no state.
    """
    return _epochs(packets, width, last={state: F.col(delta) for delta, state in fields.items()}).filter("has_baseline")


def stale_since_gap(packets: DataFrame, fields: dict[str, str], width: int = WIDTH) -> DataFrame:
    """``rebuild_state`` with ``<state column>_stale`` for each field, ``stale_since_gap`` (any of them), and ``last_gap_pkt``, the packet behind the epoch's last gap.

    A delta that was lost in a gap leaves a wrong value until the field is given again or the next keyframe comes: a value is stale if a gap of its epoch lies between it and
    now. A packet that comes behind a gap makes what it gives fresh; a field that the epoch hasn't given yet is stale after any gap.
    """
    own = {f"_given_{i}": F.when(F.col(delta).isNotNull(), F.col("pkt_no")) for i, delta in enumerate(fields)}
    gap = {"last_gap_pkt": F.when(F.col("gap") == 1, F.col("pkt_no"))}
    rebuilt = _epochs(seq_gaps(packets, width), width, last={**{state: F.col(delta) for delta, state in fields.items()}, **own, **gap}).filter("has_baseline")
    stale = {f"{state}_stale": F.coalesce(F.col("last_gap_pkt") > F.coalesce(f"_given_{i}", F.lit(-1)), F.lit(False)) for i, state in enumerate(fields.values())}
    marked = rebuilt.withColumns(stale).drop(*own)
    return marked.withColumn("stale_since_gap", F.greatest(F.lit(False), *[F.col(c) for c in stale]))


def delta_known_task(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Task changes that apply: their index is below the task count of the epoch's keyframe."""
    known = rebuild_state(packets, {"task_count": "epoch_task_count"}, width)
    return known.filter(~F.col("is_valid_keyframe") & (F.col("task_idx_d") < F.col("epoch_task_count")))


def rebuild_task_state(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """State of each task after each change that applies, with the state before it in the epoch."""
    return Scan(["device_id", "epoch", "task_idx_d"], ["pkt_no"], ranges("pkt_no", width), before={"state_before": F.col("state_d")}).over(delta_known_task(packets, width))


def full_state(changes: DataFrame) -> DataFrame:
    """``device_id, epoch, pkt_no, heap_free_bytes, heap_min_ever_bytes, cpu_utilization_pct`` after each packet that sets one of them.

    ``changes`` has the columns of ``expand_payloads``; of a field that is set twice in a packet, the later one holds.
    """
    return _carried(changes.filter("scope = 'system'"), ["device_id", "epoch"], ["heap_free_bytes", "heap_min_ever_bytes", "cpu_utilization_pct"])


def task_state(changes: DataFrame) -> DataFrame:
    """``device_id, epoch, task_idx, pkt_no, state, priority, stack_hwm_words, runtime_ticks`` of a task after each packet that sets one of them."""
    return _carried(changes.filter("scope = 'task'"), ["device_id", "epoch", "task_idx"], ["state", "priority", "stack_hwm_words", "runtime_ticks"])


def _carried(changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row a packet with the last value of every field: the fields of a packet come together first, then values are carried inside the epoch."""
    given = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("place"))).alias(f) for f in fields]
    packets = changes.groupBy(*keys, "pkt_no").agg(*given)
    carried = Scan(keys, ["pkt_no"], ranges("pkt_no", WIDTH), last={f: F.col(f) for f in fields}).over(packets)
    return carried.select(*keys, "pkt_no", *fields)


def current_tasks(tasks: DataFrame, names: DataFrame, include_stale: bool = False) -> DataFrame:
    """The last state of every task with its name: those of the device's last epoch or, with ``include_stale``, of all epochs by name.

    ``tasks`` has the columns of ``task_state``, ``names`` those of ``task_names``. ``snapshot_id`` is the epoch.
    """
    named = tasks.join(names, ["device_id", "epoch", "task_idx"])
    columns = ["pkt_no", "state", "priority", "stack_hwm_words", "runtime_ticks"]
    if include_stale:
        last = named.groupBy("device_id", "task_name").agg(F.max_by(F.struct("task_idx", *columns), F.struct("epoch", "pkt_no", "task_idx")).alias("s"))
        return last.select("device_id", F.lit(0).cast("long").alias("snapshot_id"), "s.task_idx", "task_name", *[f"s.{c}" for c in columns])
    last = named.groupBy("device_id", "epoch", "task_idx").agg(F.max_by(F.struct("task_name", *columns), "pkt_no").alias("s"))
    newest = last.groupBy("device_id").agg(F.max("epoch").alias("epoch"))
    return last.join(newest, ["device_id", "epoch"]).select("device_id", F.col("epoch").alias("snapshot_id"), "task_idx", "s.*")


def heap_samples(packets: DataFrame, include_prebaseline: bool = False, width: int = WIDTH) -> DataFrame:
    """``device_id, pkt_no, arrival_ts, heap_free_bytes`` after each packet: the samples of the leak analytics.

    Packets before the first keyframe give no sample or, with ``include_prebaseline``, one of 0 bytes.
    """
    epochs = _epochs(packets, width, last={"_heap": F.col("heap_d")})
    heap = F.when(F.col("has_baseline"), F.col("_heap")).otherwise(F.lit(0)).cast("long")
    samples = epochs.select("device_id", "pkt_no", "arrival_ts", heap.alias("heap_free_bytes"), "has_baseline")
    return (samples if include_prebaseline else samples.filter("has_baseline")).drop("has_baseline")


def latest_state(packets: DataFrame, columns: list[str]) -> DataFrame:
    """The last packet's columns of each device."""
    last = packets.groupBy("device_id").agg(F.max_by(F.struct("pkt_no", *columns), "pkt_no").alias("s"))
    return last.select("device_id", "s.*")


def device_get_or_create(wanted: DataFrame, states: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The state of each wanted device, or the defaults where it has none (``created``)."""
    joined = wanted.select("device_id").distinct().join(states.withColumn("found", F.lit(True)), "device_id", "left")
    return joined.select("device_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()], F.col("found").isNull().alias("created"))


def _by(keys: tuple[str, ...], width: int, **what) -> Scan:
    return Scan(["device_id", *keys], ["pkt_no"], ranges("pkt_no", width), **what)


def state_transitions(packets: DataFrame, *keys: str, width: int = WIDTH) -> DataFrame:
    """Runs of one state: ``run, state, first_pkt, last_pkt, packets`` of each device (and of further keys).

    Runs are found in each range of packet numbers by one sort of narrow rows; only those that touch a range's end, at most two a range, are put together over ranges.
    """
    names = ["device_id", *keys]
    # the key and the range are structs, so that nulls meet in the join
    rows = packets.select(F.struct(*names).alias("_key"), F.struct(ranges("pkt_no", width)).alias("_range"), "pkt_no", "state")
    inside = Window.partitionBy("_key", "_range").orderBy("pkt_no")
    place, after = F.row_number().over(inside).cast("long"), F.lead(F.struct("state")).over(inside)
    seen = rows.withColumns({"_n": place, "_opens": place == 1, "_closes": after.isNull(), "_new": (place == 1) | ~F.col("state").eqNullSafe(F.lag("state").over(inside)), "_end": after.isNull() | ~F.col("state").eqNullSafe(after["state"])})
    ends = seen.filter("_new or _end")
    last = lambda c: F.when(F.col("_end"), F.col(c)).otherwise(F.lead(c).over(inside))
    runs = ends.select(
        "_key", "_range", "state", F.col("pkt_no").alias("first_pkt"), last("pkt_no").alias("last_pkt"), (last("_n") - F.col("_n") + 1).alias("packets"), "_opens", last("_closes").alias("_closes"),
        F.sum(F.col("_new").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_place"), "_new",
    ).filter("_new").drop("_new")

    order = Window.partitionBy("_key").orderBy("_range", F.desc("_opens"))
    goes_on = F.col("_opens") & F.coalesce(F.lag(F.struct("state")).over(order) == F.struct("state"), F.lit(False))
    border = runs.filter("_opens or _closes").withColumn("_goes_on", goes_on)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("_opens"), F.when(F.col("_goes_on"), 0).otherwise(1)).otherwise(F.col("_place") - 1)
    counted = border.withColumns({"_whole": F.sum((~F.col("_goes_on")).cast("long")).over(so_far), "_run": F.sum(new).over(so_far)})
    whole = Window.partitionBy("_key", "_whole")
    joined = counted.withColumns({"_first": F.min("first_pkt").over(whole), "_last": F.max("last_pkt").over(whole), "_packets": F.sum("packets").over(whole)})
    closing, opening = (lambda c: F.max(F.when(F.col("_closes"), F.col(c)))), (lambda c: F.max(F.when(F.col("_opens"), F.col(c))))
    carry = joined.groupBy("_key", "_range").agg(closing("_first").alias("_first"), closing("_last").alias("_last"), closing("_packets").alias("_packets"), (opening("_run") - 1).alias("_before"), opening("_goes_on").alias("_goes_on"))
    known = runs.join(carry, ["_key", "_range"]).filter("not (_opens and _goes_on)")
    own = {"first_pkt": "_first", "last_pkt": "_last", "packets": "_packets"}
    return known.select(*[F.col("_key")[c].alias(c) for c in names], (F.col("_before") + F.col("_place")).alias("run"), "state", *[F.when(F.col("_closes"), F.col(w)).otherwise(F.col(c)).alias(c) for c, w in own.items()])


def _with_before(rows: DataFrame, fields: list[str], keys: tuple[str, ...], width: int) -> DataFrame:
    """``_first`` and, for each field, ``_before_<n>``: what the row before has."""
    before = {f"_before_{i}": F.col(f) for i, f in enumerate(fields)}
    return _by(keys, width, before={**before, "_pkt_before": F.col("pkt_no")}).over(rows).withColumn("_first", F.col("_pkt_before").isNull())


def change_capture(snapshots: DataFrame, fields: list[str], width: int = WIDTH) -> DataFrame:
    """``device_id, pkt_no, field, value`` of the fields that differ from the snapshot before; all of them in the first."""
    marked = _with_before(snapshots.select("device_id", "pkt_no", *fields), fields, (), width)
    each = F.array(*[F.when(F.col("_first") | ~F.col(f).eqNullSafe(F.col(f"_before_{i}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value"))) for i, f in enumerate(fields)])
    return marked.select("device_id", "pkt_no", F.explode(F.array_compact(each)).alias("c")).select("device_id", "pkt_no", "c.field", "c.value")


def task_timeline(tasks: DataFrame) -> DataFrame:
    """``device_id, task_idx, first_pkt, last_pkt, packets``: the intervals in which a task was running (state 0)."""
    return state_transitions(tasks, "task_idx").filter("state = 0").drop("run", "state")


def task_change_capture(tasks: DataFrame, fields: tuple[str, ...] = ("state", "priority", "stack_hwm_words", "runtime_ticks"), width: int = WIDTH) -> DataFrame:
    """``device_id, pkt_no, place, task_idx, field, value``: the task fields that differ from the task's snapshot before; all in its first.

    ``place`` orders a packet's changes as they are sent: by task, then in the order of ``fields``. Tasks over 14 have no tag of their own and are left out.
    """
    marked = _with_before(tasks.filter(F.col("task_idx") < SYSTEM_TAG).select("device_id", "pkt_no", "task_idx", *fields), list(fields), ("task_idx",), width)
    each = [
        F.when(F.col("_first") | ~F.col(f).eqNullSafe(F.col(f"_before_{i}")), F.struct((F.col("task_idx") * len(fields) + i).cast("int").alias("place"), F.lit(f).alias("field"), F.col(f).cast("long").alias("value")))
        for i, f in enumerate(fields)
    ]
    listed = marked.select("device_id", "pkt_no", "task_idx", F.explode(F.array_compact(F.array(*each))).alias("c"))
    return listed.select("device_id", "pkt_no", "c.place", "task_idx", "c.field", "c.value")


def snapshot_policy(snapshots: DataFrame, topology: str, every: int = KEYFRAME_EVERY, width: int = WIDTH) -> DataFrame:
    """``reason`` to store a full snapshot: first, forced (every n-th), topology (count or names changed); else null."""
    marked = _with_before(snapshots, [topology], (), width)
    reason = F.when(F.col("_first"), "first").when(F.col("pkt_no") % every == 0, "forced").when(~F.col(topology).eqNullSafe(F.col("_before_0")), "topology")
    return marked.withColumn("reason", reason).withColumn("is_keyframe", F.col("reason").isNotNull()).drop("_first", "_before_0", "_pkt_before")
