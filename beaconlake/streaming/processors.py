"""Stateful streams: reordering, incremental decoding, device state, and leak analytics, each keyed by device; ``stream_leaks`` chains them from chunks to projections.

Rows of a device are taken in the order of their number within each micro-batch; a row whose number isn't above the last one is late and goes out
marked so (``late``, or the status ``late`` of a chunk), without a change of state. ``stream_in_order`` puts rows that arrive out of order in order first, as long as they are not later than
its delay; ``write_with_late_rows`` keeps the later ones in a table of their own. State is bounded: one unfinished frame, one state record and at most 15 tasks,
``window_size`` samples a device, or the rows of the delay. The RocksDB state store is needed (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from beaconlake.params import OFFLINE_SECONDS, SEQ_MOD, SYSTEM_TAG, OomParams
from beaconlake.session import ship_package
from beaconlake.sources.frames import DELTA, FIELDS, KEYFRAME, parse_keyframe, scan

DECODED = "device_id string, chunk_no long, status string, packet_type int, sequence_num int, timestamp_ticks long, payload binary, pkt_no long, arrival_ts timestamp"
STATES = "device_id string, pkt_no long, late boolean, epoch long, heap_free_bytes long, cpu_utilization_pct long, packet_count long, drop_count long"
FIELD_NAMES = [name for name, _ in FIELDS.values()]
FULL = "device_id string, pkt_no long, late boolean, epoch long, task_idx int, task_name string, " + ", ".join(f"{name} long" for name in FIELD_NAMES) + ", arrival_ts timestamp"
PROJECTIONS = "device_id string, pkt_no long, late boolean, n long, slope double, r2 double, projection double, heap_free_bytes long, arrival_ts timestamp"
SILENT = "device_id string, last_seen timestamp, offline boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(spark)


def _in_order(rows: Iterator[pd.DataFrame], number: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(number, kind="stable")


class FrameDecoder(StatefulProcessor):
    """Frames from chunks that cut them anywhere; the unfinished frame waits in the state. Accepted frames are numbered (``pkt_no``) and have their last chunk's arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "bytes binary, chunk_no long, packets long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, last, packets = self.rest.get() if self.rest.exists() else (b"", None, 0)
        rest, out = bytes(rest), []
        for r in _in_order(rows, "chunk_no").itertuples(index=False):
            if last is not None and r.chunk_no <= last:
                out.append((key[0], r.chunk_no, "late", None, None, None, r.bytes, None, r.arrival_ts))
                continue
            last = int(r.chunk_no)
            found, rest = scan(rest + bytes(r.bytes or b""))
            for f in found:
                packets += f.status == "ok"
                out.append((key[0], r.chunk_no, f.status, f.packet_type, f.sequence_num, f.timestamp_ticks, f.payload, packets if f.status == "ok" else None, r.arrival_ts))
        self.rest.update((rest, last, packets))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in DECODED.split(", ")])
        yield frame.astype({"packet_type": "Int32", "sequence_num": "Int32", "timestamp_ticks": "Int64", "pkt_no": "Int64", "arrival_ts": "datetime64[ns]"})

    def close(self) -> None:
        pass


class StateTracker(StatefulProcessor):
    """Counters, gaps, epoch and the last given fields after each packet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pkt_no long, seq long, epoch long, heap long, cpu long, packets long, drops long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, seq, epoch, heap, cpu, packets, drops = self.state.get() if self.state.exists() else (None, None, 0, None, None, 0, 0)
        out = []
        for r in _in_order(rows, "pkt_no").itertuples(index=False):
            if last is not None and r.pkt_no <= last:
                out.append((key[0], r.pkt_no, True, epoch, heap, cpu, packets, drops))
                continue
            drops += int(seq is not None and (int(r.sequence_num) - seq - 1) % SEQ_MOD != 0)
            last, seq, packets = int(r.pkt_no), int(r.sequence_num), packets + 1
            if r.is_valid_keyframe:
                epoch, heap, cpu = epoch + 1, None, None
            if epoch:
                heap = heap if pd.isna(r.heap_d) else int(r.heap_d)
                cpu = cpu if pd.isna(r.cpu_d) else int(r.cpu_d)
            out.append((key[0], last, False, epoch, heap, cpu, packets, drops))
        self.state.update((last, seq, epoch, heap, cpu, packets, drops))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])
        yield frame.astype({"heap_free_bytes": "Int64", "cpu_utilization_pct": "Int64"})

    def close(self) -> None:
        pass


class FullStateTracker(StatefulProcessor):
    """The system fields and every task's after each packet that sets them, from keyframes and deltas.

    Input has ``keyframe`` (parsed, null where there is none or it is malformed) and ``payload``. A task goes out with its name and fields, the system as ``task_idx`` 15.
    With ``samples`` the system goes out after every packet since the first keyframe, whatever it sets, and nothing else does.
    """

    def __init__(self, samples: bool = False):
        self.samples = samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.system = handle.getValueState("system", "pkt_no long, epoch long, heap_free_bytes long, heap_min_ever_bytes long, cpu_utilization_pct long")
        self.tasks = handle.getMapState("tasks", "task_idx int", "task_name string, state long, priority long, stack_hwm_words long, runtime_ticks long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A record of the registry as the state, before the first packets."""
        for r in initialState.itertuples(index=False):
            numbers = [None if pd.isna(x) else int(x) for x in (r.pkt_no, r.epoch, *(getattr(r, f) for f in FIELD_NAMES[4:]))]
            self.system.update(tuple(numbers))
            for t in r.tasks:
                self.tasks.updateValue((int(t["task_idx"]),), (t["task_name"], *(int(t[f]) for f in FIELD_NAMES[:4])))

    @staticmethod
    def entries(payload: bytes, known) -> Iterator[tuple[int, str, int]]:
        """(task, field, value) of a delta; what it says of unknown tasks is skipped by the field's width, and elsewhere an unknown field or a cut-off value ends it."""
        at = 0
        while at < len(payload):
            task, (name, width) = payload[at] >> 4, FIELDS.get(payload[at] & 15, ("", 0))
            if (name in FIELD_NAMES[4:]) != (task == SYSTEM_TAG):
                width = 0
            at += 1
            if task == SYSTEM_TAG or task in known:
                if not width or at + width > len(payload):
                    return
                yield task, name, int.from_bytes(payload[at : at + width], "little")
            at += width

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, epoch, *values = self.system.get() if self.system.exists() else (None, 0, None, None, None)
        system = dict(zip(FIELD_NAMES[4:], values, strict=True))
        tasks = {k[0]: dict(zip(["task_name", *FIELD_NAMES[:4]], v, strict=True)) for k, v in self.tasks.iterator()}
        out = []
        for r in _in_order(rows, "pkt_no").itertuples(index=False):
            if last is not None and r.pkt_no <= last:
                out.append({"pkt_no": r.pkt_no, "late": True, "epoch": epoch, "arrival_ts": r.arrival_ts})
                continue
            last, changed = int(r.pkt_no), []
            if r.keyframe is not None:
                epoch, system = epoch + 1, {name: int(r.keyframe[name]) for name in FIELD_NAMES[4:]}
                tasks = {i: {"task_name": t["name"], **{name: int(t[name]) for name in FIELD_NAMES[:4]}} for i, t in enumerate(r.keyframe["tasks"])}
                changed = [SYSTEM_TAG, *tasks]
            elif r.packet_type == DELTA and epoch:
                for task, name, value in self.entries(bytes(r.payload or b""), tasks):
                    (system if task == SYSTEM_TAG else tasks[task])[name] = value
                    changed.append(task)
            if self.samples:
                changed = [SYSTEM_TAG] if epoch else []
            out += [{"pkt_no": last, "arrival_ts": r.arrival_ts, "late": False, "epoch": epoch, "task_idx": i, **(system if i == SYSTEM_TAG else tasks[i])} for i in dict.fromkeys(changed)]
        self.system.update((last, epoch, *system.values()))
        self.tasks.clear()
        for i, t in tasks.items():
            self.tasks.updateValue((i,), tuple(t.values()))
        frame = pd.DataFrame([{"device_id": key[0], **x} for x in out], columns=[c.split()[0] for c in FULL.split(", ")])
        yield frame.astype({"task_idx": "Int32", "task_name": object, "arrival_ts": "datetime64[ns]", **dict.fromkeys(FIELD_NAMES, "Int64")})

    def close(self) -> None:
        pass


class OfflineTracker(StatefulProcessor):
    """A row when a device appears, and one when it was silent for longer than the timeout; its state is removed then.

    The silence ends with the watermark's timer or with the device's next packet, whichever comes first.
    """

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else None
        out = []
        for t in sorted({int(t.timestamp() * 1000) for part in rows for t in part["arrival_ts"]}):
            if last is not None and t - last > self.timeout:
                out.append(self._row(key, last, True))
            if last is None or t - last > self.timeout:
                out.append(self._row(key, t, False))
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.timeout + 1)
        self.seen.update((last,))
        yield pd.concat(out) if out else self._row(key, last, False).iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.clear()
        yield self._row(key, last, True)

    @staticmethod
    def _row(key, last: int, offline: bool) -> pd.DataFrame:
        return pd.DataFrame({"device_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "offline": [offline]})

    def close(self) -> None:
        pass


class Changes:
    """A map state of whole numbers to tuples, read and changed in memory; ``flush`` writes the changed entries and no others."""

    def __init__(self, state):
        self.state, self.now, self.changed = state, {}, set()

    def get(self, key: int) -> tuple:
        if key not in self.now:
            self.now[key] = self.state.getValue((key,))
        return self.now[key]

    def put(self, key: int, value: tuple | None) -> None:
        self.now[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in sorted(self.changed):
            if self.now[key] is not None:
                self.state.updateValue((key,), self.now[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class Minimum:
    """The least of the samples in a window that only moves forward: a queue of rising values, each sample enters and leaves once."""

    def __init__(self, entries: Changes, head: int, tail: int):
        self.entries, self.head, self.tail = entries, head, tail

    def add(self, sample: int, value: int) -> None:
        while self.tail > self.head and self.entries.get(self.tail - 1)[1] >= value:
            self.tail -= 1
            self.entries.put(self.tail, None)
        self.entries.put(self.tail, (sample, value))
        self.tail += 1

    def least(self, start: int) -> int | None:
        """Of the samples from ``start`` on."""
        while self.tail > self.head and self.entries.get(self.head)[0] < start:
            self.entries.put(self.head, None)
            self.head += 1
        return self.entries.get(self.head)[1] if self.tail > self.head else None


class LeakTracker(StatefulProcessor):
    """The projection at every sample over the last ``window_size``, with constant work a sample.

    The window's samples are a ring in a map state, its sums exact whole numbers to which a sample is added and from which the one that leaves is taken, and both minima (of
    the window and of its first half) monotonic queues. A micro-batch reads and writes the entries that its samples touch. ``total_heap_bytes`` of a row, if it has one,
    stands in for the parameter.
    """

    SUMS = ("sx", "sy", "sxx", "sxy", "syy")

    def __init__(self, params: OomParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "slot long", "x long, heap long")
        self.lowest = handle.getMapState("lowest", "place long", "sample long, heap long")
        self.early = handle.getMapState("early", "place long", "sample long, heap long")
        # sums of squares of microseconds outgrow 64 bits, so they are kept as digits
        self.window = handle.getValueState("window", "pkt_no long, samples long, base long, next_early long, low_head long, low_tail long, early_head long, early_tail long, " + ", ".join(f"{name} string" for name in self.SUMS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size = self.params.window_size
        last, count, base, next_early, *ends_and_sums = self.window.get() if self.window.exists() else (None, 0, None, 0, 0, 0, 0, 0, *["0"] * 5)
        low_head, low_tail, early_head, early_tail = ends_and_sums[:4]
        sx, sy, sxx, sxy, syy = map(int, ends_and_sums[4:])
        ring = Changes(self.ring)
        lowest, early = Minimum(Changes(self.lowest), low_head, low_tail), Minimum(Changes(self.early), early_head, early_tail)
        out = []
        for r in _in_order(rows, "pkt_no").itertuples(index=False):
            if last is not None and r.pkt_no <= last:
                out.append((key[0], int(r.pkt_no), True, None, None, None, None, None, r.arrival_ts))
                continue
            at, y = r.arrival_ts.value // 1000, int(r.heap_free_bytes)
            base = at if base is None else base
            last, x, slot = int(r.pkt_no), at - base, count % size
            if count >= size:
                ox, oy = ring.get(slot)
                sx, sy, sxx, sxy, syy = sx - ox, sy - oy, sxx - ox * ox, sxy - ox * oy, syy - oy * oy
            sx, sy, sxx, sxy, syy = sx + x, sy + y, sxx + x * x, sxy + x * y, syy + y * y
            ring.put(slot, (x, y))
            lowest.add(count, y)
            start = max(0, count - size + 1)
            n = count - start + 1
            while next_early < start + n // 2:
                early.add(next_early, ring.get(next_early % size)[1])
                next_early += 1
            count += 1
            total = getattr(r, "total_heap_bytes", None)
            total = self.params.total_heap_bytes if total is None or pd.isna(total) else int(total)
            found = self.judged(n, y, (sx, sy, sxx, sxy, syy), lowest.least(start), early.least(start) if n > 1 else None, total)
            out.append((key[0], last, False, n, *found, y, r.arrival_ts))
        for entries in (ring, lowest.entries, early.entries):
            entries.flush()
        if count:
            self.window.update((last, count, base, next_early, lowest.head, lowest.tail, early.head, early.tail, *map(str, (sx, sy, sxx, sxy, syy))))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PROJECTIONS.split(", ")])
        yield frame.astype({"n": "Int64", "heap_free_bytes": "Int64", "arrival_ts": "datetime64[ns]"})

    def project(self, times: Iterable[float], heaps: Iterable[float]) -> tuple[float, float, float]:
        """Slope, r2 and projection of one window, given as its seconds and bytes in order."""
        at, y = [round(t * 1e6) for t in times], [int(h) for h in heaps]
        x, n = [t - at[0] for t in at], len(y)
        sums = (sum(x), sum(y), sum(a * a for a in x), sum(a * b for a, b in zip(x, y, strict=True)), sum(b * b for b in y))
        return self.judged(n, y[-1], sums, min(y), min(y[: n // 2], default=None), self.params.total_heap_bytes)

    def judged(self, n: int, y: int, sums: tuple, low: int, first_half: int | None, total: int) -> tuple[float, float, float]:
        """Slope, r2 and projection of a window's sums and minima, by the rules of the batch operator."""
        p, (sx, sy, sxx, sxy, syy) = self.params, sums
        xx, xy, yy = n * sxx - sx * sx, n * sxy - sx * sy, n * syy - sy * sy
        slope = float(xy) / float(xx) * 1e6 if xx else 0.0
        r2 = float(xy) / float(xx) * (float(xy) / float(yy)) if xx and yy else 0.0
        if n < p.min_samples or not xx:
            return slope, r2, -1.0
        if slope < 0 and r2 >= p.r_squared_threshold:
            return slope, r2, y / abs(slope)
        return slope, r2, -2.0 if first_half is not None and (first_half - low) / total > p.rolling_min_threshold else -1.0

    def close(self) -> None:
        pass


class Reorderer(StatefulProcessor):
    """Rows in the order of their numbers: each waits until the device's newest arrival is ``delay`` past its own, or until the device is silent for ``idle`` (None: it waits on).

    A row with a number that was passed already goes out at once as ``late``, and so does a second one of a waiting number; none is lost. The clock is the device's own: the
    engine's watermark would drop late rows before they come here.
    """

    def __init__(self, schema: StructType, delay_ms: int, idle_ms: int | None):
        self.schema, self.delay, self.idle = schema, delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "pkt_no long", self.schema)
        self.clock = handle.getValueState("clock", "released long, newest_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        released, newest = self.clock.get() if self.clock.exists() else (None, None)
        columns, late, own = self.schema.names, [], {}
        for part in rows:
            for row in part[columns].itertuples(index=False):
                row = tuple(None if not isinstance(x, (bytes, dict, list, tuple)) and pd.isna(x) else x for x in row)
                of = dict(zip(columns, row, strict=True))
                number = int(of["pkt_no"])
                if (released is not None and number <= released) or number in own or self.waiting.containsKey((number,)):
                    late.append(row)
                    continue
                own[number] = row
                newest = max(newest or 0, of["arrival_ts"].value // 1000)
        # what this batch brought is written only if it still waits afterwards
        out, released = self._released({**{k[0]: v for k, v in self.waiting.iterator()}, **own}, own, released, None if newest is None else newest - 1000 * self.delay)
        self.clock.update((released, newest))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._frame(out, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        released, newest = self.clock.get()
        out, released = self._released({k[0]: v for k, v in self.waiting.iterator()}, {}, released, None)
        self.clock.update((released, newest))
        yield self._frame(out, [])

    def _released(self, held: dict, own: dict, released: int | None, until: int | None) -> tuple[list[tuple], int | None]:
        """Rows from the lowest number on, up to the first that still has to wait (``until`` None: all); the others are kept in the state."""
        out, at = [], self.schema.names.index("arrival_ts")
        for number in sorted(held):
            if until is not None and pd.Timestamp(held[number][at]).value // 1000 > until:
                break
            out.append(tuple(held[number]))
            released = number
            if number not in own:
                self.waiting.removeKey((number,))
        for number, row in own.items():
            if released is None or number > released:
                self.waiting.updateValue((number,), row)
        return out, released

    def _frame(self, out: list[tuple], late: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([*((*row, False) for row in out), *((*row, True) for row in late)], columns=[*self.schema.names, "late"])
        kinds = {"bigint": "Int64", "int": "Int32", "timestamp": "datetime64[ns]", "boolean": "boolean", "double": "Float64"}
        return frame.astype({f.name: kinds[f.dataType.simpleString()] for f in self.schema.fields if f.dataType.simpleString() in kinds} | {"late": bool})

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "None", records: DataFrame | None = None) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    first = None if records is None else records.groupBy("device_id")
    return stream.groupBy("device_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode, initialState=first)


def stream_in_order(rows: DataFrame, delay_seconds: float, idle_seconds: float | None = None) -> DataFrame:
    """The rows of a stream with ``device_id, pkt_no, arrival_ts`` (and others) in the order of ``pkt_no`` of each device, and ``late``.

    A row waits for ``delay_seconds`` of the device's own time. What comes later than that is marked ``late`` and stands outside the order. With ``idle_seconds``,
    the waiting rows of a device that sends nothing for so long are released by a timer; such a query runs until it is stopped, as its timers need the clock.
    """
    schema = StructType([f for f in rows.schema.fields if f.name != "device_id"])
    use_rocksdb(rows.sparkSession)
    out = StructType([rows.schema["device_id"], *schema.fields, StructField("late", BooleanType())])
    inner = _WithKey(Reorderer(schema, int(delay_seconds * 1000), None if idle_seconds is None else int(idle_seconds * 1000)))
    mode = "None" if idle_seconds is None else "ProcessingTime"
    return rows.groupBy("device_id").transformWithStateInPandas(statefulProcessor=inner, outputStructType=out, outputMode="Append", timeMode=mode)


class _WithKey(StatefulProcessor):
    """A processor whose rows get the device's id in front."""

    def __init__(self, inner: StatefulProcessor):
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in self.inner.handleInputRows(key, rows, timerValues):
            frame.insert(0, "device_id", key[0])
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for frame in self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo):
            frame.insert(0, "device_id", key[0])
            yield frame

    def close(self) -> None:
        self.inner.close()


def write_with_late_rows(stream: DataFrame, path: str, late_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream that has ``late``: rows in time go to ``path``, the others to ``late_path``, both as Parquet in a folder a micro-batch (``batch=<id>``).

    A micro-batch that is run again replaces its own folders, so that either table has each row once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for rows, folder in ((batch.filter("not late"), path), (batch.filter("late"), late_path)):
            rows.drop("late").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")


def stream_decode(chunks: DataFrame) -> DataFrame:
    """Columns of DECODED from a stream of ``device_id, chunk_no, bytes`` and, if it has it, ``arrival_ts``."""
    arrival = F.col("arrival_ts") if "arrival_ts" in chunks.columns else F.lit(None).cast("timestamp")
    return _keyed(chunks.select("device_id", "chunk_no", "bytes", arrival.alias("arrival_ts")), FrameDecoder(), DECODED)


def stream_state(packets: DataFrame) -> DataFrame:
    """Columns of STATES from a stream of ``device_id, pkt_no, sequence_num, is_valid_keyframe, heap_d, cpu_d``."""
    return _keyed(packets.select("device_id", "pkt_no", "sequence_num", "is_valid_keyframe", "heap_d", "cpu_d"), StateTracker(), STATES)


def stream_full_state(packets: DataFrame, samples: bool = False) -> DataFrame:
    """Columns of FULL from a stream of ``device_id, pkt_no, packet_type, payload``: the task map and the system fields after every packet that sets them.

    With ``samples``, the system fields after every packet since a device's first keyframe.
    """
    return full_state_rows(packets, samples)


def full_state_rows(packets: DataFrame, samples: bool = False, records: DataFrame | None = None) -> DataFrame:
    """``stream_full_state``, from the state of ``records`` (a row a device) if they are given."""
    keyframe = F.when(F.col("packet_type") == KEYFRAME, parse_keyframe(F.col("payload")))
    arrival = F.col("arrival_ts") if "arrival_ts" in packets.columns else F.lit(None).cast("timestamp")
    return _keyed(packets.select("device_id", "pkt_no", "packet_type", "payload", arrival.alias("arrival_ts"), keyframe.alias("keyframe")), FullStateTracker(samples), FULL, records=records)


def stream_offline(packets: DataFrame, timeout_seconds: int = OFFLINE_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Columns of SILENT from a stream of ``device_id, arrival_ts``: each device when it appears and when the watermark says that it was silent too long."""
    return _keyed(packets.select("device_id", "arrival_ts").withWatermark("arrival_ts", lateness), OfflineTracker(timeout_seconds), SILENT, "EventTime")


def stream_oom(samples: DataFrame, params: OomParams = OomParams(), devices: DataFrame | None = None) -> DataFrame:
    """Columns of PROJECTIONS from a stream of ``device_id, pkt_no, arrival_ts, heap_free_bytes``; ``devices``, a table, may give ``total_heap_bytes`` by device_id."""
    few = samples.select("device_id", "pkt_no", "arrival_ts", "heap_free_bytes")
    if devices is not None:
        few = few.join(devices.select("device_id", "total_heap_bytes"), "device_id", "left")
    return _keyed(few, LeakTracker(params), PROJECTIONS)


def stream_leaks(chunks: DataFrame, params: OomParams = OomParams(), devices: DataFrame | None = None) -> DataFrame:
    """Columns of PROJECTIONS from a stream of ``device_id, chunk_no, arrival_ts, bytes``, as one query: frames, device state, projection at every packet.

    Late chunks give no rows. ``metrics_of`` and ``alerts_of`` say what its rows report.
    """
    packets = stream_decode(chunks).filter("status = 'ok'")
    samples = stream_full_state(packets, samples=True).filter("not late")
    return stream_oom(samples, params, devices)


def metrics_of(projections: DataFrame) -> DataFrame:
    """``device_id, pkt_no, ts, metric, value`` of a stream's (or table's) projections."""
    of = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in (("rtos_heap_free_bytes", "heap_free_bytes"), ("rtos_heap_oom_projection_seconds", "projection"))]))
    return projections.filter("not late").select("device_id", "pkt_no", F.col("arrival_ts").alias("ts"), of.alias("m")).select("device_id", "pkt_no", "ts", "m.*")


def alerts_of(projections: DataFrame) -> DataFrame:
    """The rows that call for an alert, with its ``kind``."""
    called = projections.filter("not late and (projection > 0 or projection = -2.0)")
    return called.withColumn("kind", F.when(F.col("projection") > 0, "leak").otherwise("falling minimum"))
