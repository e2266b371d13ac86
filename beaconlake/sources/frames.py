"""Captures of framed packets: decoding, checks, and payloads as field changes.

A frame is AA 55, then version, type, sequence (2 bytes), ticks (4), payload length (2), payload, and a CRC of what stands between. A
capture is a sequence of chunks that cut frames anywhere; ``ingest_frames`` scans splits of a capture at once and joins them where one's last frame
ends. ``parse_framed`` reads one frame a row.
"""

from __future__ import annotations

import binascii
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from beaconlake.functions.buffers import buffer_of, crc16, numbers
from beaconlake.functions.scan import WIDTH, Scan, ranges
from beaconlake.functions.tables import kept
from beaconlake.functions.wire import byte_values, checksum, let, number_at, to_little_endian
from beaconlake.operators.state import keyframe_epoch, rebuild_state
from beaconlake.params import MAX_TASKS, SYSTEM_TAG
from beaconlake.session import ship_package

SYNC, VERSION = b"\xaa\x55", 1
DELTA, KEYFRAME, DEVICE_INFO = 1, 2, 3
HEADER, CRC = struct.Struct("<BBHIH"), struct.Struct("<H")
#: Delta field to (name, bytes); 1 to 4 belong to tasks, 5 to 7 to the system.
FIELDS = {1: ("state", 1), 2: ("priority", 1), 3: ("stack_hwm_words", 2), 4: ("runtime_ticks", 4), 5: ("heap_free_bytes", 4), 6: ("heap_min_ever_bytes", 4), 7: ("cpu_utilization_pct", 1)}

FRAMES = "device_id string, capture_id string, chunk_no long, arrival_ts timestamp, frame_no long, status string, packet_type int, sequence_num int, timestamp_ticks long, payload binary"


@dataclass
class Frame:
    """``status`` is ok, crc (checksum differs) or version (unknown version; the rest is then scanned again)."""

    status: str
    packet_type: int | None = None
    sequence_num: int | None = None
    timestamp_ticks: int | None = None
    payload: bytes | None = None


def walk(data: bytes, at: int, limit: int) -> tuple[list[tuple[int, int, Frame]], int, bool]:
    """(begin, end, frame) of the frames that begin from ``at`` on and before ``limit``, where the scan stands then, and whether an unfinished frame begins there."""
    found = []
    while True:
        begin = data.find(SYNC, at, limit + 1)
        if begin < 0 or begin >= limit:
            return found, at, False
        body = begin + len(SYNC)
        if len(data) < body + HEADER.size:
            return found, begin, True
        version, kind, sequence, ticks, length = HEADER.unpack_from(data, body)
        if version != VERSION:
            at = body + HEADER.size
            found.append((begin, at, Frame("version")))
            continue
        end = body + HEADER.size + length
        if len(data) < end + CRC.size:
            return found, begin, True
        good = CRC.unpack_from(data, end)[0] == binascii.crc_hqx(data[body:end], 0xFFFF)
        at = end + CRC.size
        found.append((begin, at, Frame("ok" if good else "crc", kind, sequence, ticks, data[body + HEADER.size : end])))


def scan(data: bytes) -> tuple[list[Frame], bytes]:
    """Frames in the bytes, and the rest that may be the beginning of one."""
    found, at, unfinished = walk(data, 0, len(data))
    rest = data[at:] if unfinished else data[-1:] if data[at:].endswith(SYNC[:1]) else b""
    return [frame for _, _, frame in found], rest


def read_chunks(source, path: str) -> DataFrame:
    """Raw captures, one file a capture of one device (``<device_id>/<capture_id>``), from ``spark.read`` or ``spark.readStream``."""
    files = source.format("binaryFile").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("device_id"), F.element_at(parts, -1).alias("capture_id"), F.lit(0).cast("long").alias("chunk_no"), F.col("modificationTime").alias("arrival_ts"), F.col("content").alias("bytes"))


CHUNKS = "device_id string, capture_id string, chunk_no long, arrival_ts timestamp, bytes binary"


def read_chunk_table(source, path: str) -> DataFrame:
    """Raw chunks from Parquet with the columns of CHUNKS, by ``spark.read`` or ``spark.readStream``; many chunks a capture, in any files."""
    return source.schema(CHUNKS).parquet(path)


#: Bytes of a capture that one task scans at once, and those of the longest frame.
SPLIT, LONGEST = 4 << 20, len(SYNC) + HEADER.size + 0xFFFF + CRC.size
CAPTURE = ["device_id", "capture_id"]
EVENTS = "device_id string, capture_id string, split long, place long, begin long, end long, chunk_no long, arrival_ts timestamp, status string, packet_type int, sequence_num int, timestamp_ticks long, payload binary"


def _pieces(chunks: DataFrame, split_bytes: int) -> DataFrame:
    """``device_id, capture_id, split, kind, at, chunk_no, arrival_ts, bytes``: what each split of a capture reads, which is its own bytes and those that a frame of it may reach.

    Rows of kind 1 say where a capture ends (``at``), and which chunk is its last one.
    """
    sized = chunks.select(*CAPTURE, "chunk_no", "arrival_ts", F.coalesce("bytes", F.lit(b"")).alias("bytes")).withColumn("size", F.octet_length("bytes").cast("long"))
    placed = Scan(CAPTURE, ["chunk_no"], ranges("chunk_no", WIDTH), sums={"stop": F.col("size")}).over(sized).withColumn("start", F.col("stop") - F.col("size"))
    ends = chunks.groupBy(*CAPTURE).agg(F.sum(F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")).alias("start"), F.max_by(F.struct("chunk_no", "arrival_ts"), "chunk_no").alias("last"))

    def reached(first: Column, last: Column) -> Column:
        """The splits that read a place between these two."""
        return F.explode(F.sequence(F.greatest(F.floor((first - LONGEST) / split_bytes), F.lit(0)), F.greatest(F.floor((last - 1) / split_bytes), F.lit(0)))).alias("split")

    low = F.greatest("start", F.col("split") * split_bytes)
    cut = F.substring("bytes", (low - F.col("start") + 1).cast("int"), (F.least(F.col("stop"), (F.col("split") + 1) * split_bytes + LONGEST) - low).cast("int"))
    held = placed.filter("size > 0").select("*", reached(F.col("start"), F.col("stop"))).select(*CAPTURE, "split", F.lit(0).alias("kind"), low.alias("at"), "chunk_no", "arrival_ts", cut.alias("bytes"))
    marks = ends.select("*", reached(F.col("start"), F.col("start"))).select(*CAPTURE, "split", F.lit(1).alias("kind"), F.col("start").alias("at"), "last.chunk_no", "last.arrival_ts", F.lit(b"").alias("bytes"))
    return held.union(marks)


def _split_events(pieces: DataFrame, split_bytes: int) -> DataFrame:
    """Columns of EVENTS: the frames that begin in each split, scanned from ``entry`` (a column of ``pieces``), and a row without a status for where the scan entered (``begin``) and left (``end``) the split."""
    ship_package(pieces.sparkSession)
    schema = pa.schema([("device_id", pa.string()), ("capture_id", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("chunk_no", pa.int64()), ("arrival_ts", pa.timestamp("us", "UTC")), ("status", pa.string()), ("packet_type", pa.int32()), ("sequence_num", pa.int32()), ("timestamp_ticks", pa.int64()), ("payload", pa.binary())])

    def scanned(key: tuple, parts: list[tuple]) -> list[tuple]:
        device, capture, split, entry = key
        own = [x for x in parts if not x[0]]
        mark = next((x for x in parts if x[0]), None)
        base = own[0][1] if own else entry
        data, stops = b"".join(x[4] for x in own), np.cumsum([len(x[4]) for x in own])
        limit = min((split + 1) * split_bytes - base, len(data))
        found, at, unfinished = walk(data, max(0, entry - base), limit) if own and entry - base < limit else ([], entry - base, False)
        out = []
        if found:
            chunk = np.searchsorted(stops, np.array([end for _, end, _ in found]) - 1, "right")
            out = [(begin + base, end + base, *own[c][2:4], f.status, f.packet_type, f.sequence_num, f.timestamp_ticks, f.payload) for c, (begin, end, f) in zip(chunk.tolist(), found, strict=True)]
        if mark and own and base + len(data) == mark[1]:  # the capture ends here: what is left may be a frame's beginning
            left = at if unfinished else len(data) - 1 if data[max(at, 0) :].endswith(SYNC[:1]) and len(data) <= limit else None
            if left is not None:
                out.append((left + base, mark[1], *mark[2:4], "truncated", None, None, None, data[left:]))
                at = len(data)
        rows = [(device, capture, split, i, *x) for i, x in enumerate(out)]
        return [*rows, (device, capture, split, None, entry, max(at + base, entry), None, None, None, None, None, None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            rows = []
            for *of, kind, at, chunk_no, ts, data in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if tuple(of) != key:
                    if key is not None:
                        rows += scanned(key, parts)
                    key, parts = tuple(of), []
                parts.append((kind, at, chunk_no, ts, data))
            if rows:
                yield _batch(rows)
        if key is not None:
            yield _batch(scanned(key, parts))

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    order = [*CAPTURE, "split"]
    dealt = pieces.select(*order, "entry", "kind", "at", "chunk_no", "arrival_ts", "bytes").repartition(*order).sortWithinPartitions(*order, "kind", "at", "chunk_no")
    return dealt.mapInArrow(run, EVENTS)


def ingest_frames(chunks: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """Columns of FRAMES: every frame found, good or rejected, in order; a frame cut off by the capture's end has the status truncated.

    ``frame_no`` numbers the frames of a capture; ``chunk_no`` and ``arrival_ts`` are those of the chunk that completed it. The result is that of one scan from a capture's
    first byte to its last, but splits of ``split_bytes`` are scanned at once, each from its first byte as if no frame reached into it. Then each split is told where
    the scan of the one before it ended. Frames that begin before that place go. Unless one of them reaches over it, the others are right, as a scan depends on nothing
    but where it stands; a split where one does, or that was scanned from behind that place, is scanned again from there, and so on until no split's end moves.
    """
    cap = F.struct(*CAPTURE)  # null ids meet, too
    pieces = _pieces(chunks, split_bytes).withColumn("entry", F.col("split") * split_bytes)
    events = kept(_split_events(pieces, split_bytes), "events")
    places = events.select(cap.alias("cap"), "split", "begin", "end", F.col("status").isNull().alias("mark"))
    ends = places.filter("mark").select("cap", "split", F.col("end").alias("exit"))
    by_capture = Window.partitionBy("cap").orderBy("split")
    many = (ends.agg(F.max("split")).first()[0] or 0) > 0
    while True:
        entered = ends.select("cap", "split", "exit", F.greatest(F.col("split") * split_bytes, F.coalesce(F.lag("exit").over(by_capture), F.lit(0))).alias("entry"))
        met = places.join(entered, ["cap", "split"]).groupBy("cap", "split").agg(
            F.first("entry").alias("entry"), F.first("exit").alias("exit"), F.max(F.when(F.col("mark"), F.col("begin") > F.col("entry")).otherwise((F.col("begin") < F.col("entry")) & (F.col("entry") < F.col("end")))).alias("crossed"),
            F.greatest(F.max(F.when(F.col("mark") | (F.col("begin") >= F.col("entry")), F.col("end"))), F.first("entry")).alias("left"),
            F.count_if(~F.col("mark") & (F.col("begin") < F.col("entry"))).alias("dropped"), F.count_if(~F.col("mark") & (F.col("begin") >= F.col("entry"))).alias("stay"),
        )
        if not many:
            break
        met = kept(met, "splits")
        wrong = met.filter("crossed").select("cap", "split", F.col("entry").alias("from"))
        moved = met.filter("left <> exit").limit(1).count()
        if wrong.limit(1).count():
            again = pieces.drop("entry").withColumn("cap", cap).join(wrong, ["cap", "split"]).withColumn("entry", F.col("from"))
            right = events.withColumn("cap", cap).join(wrong, ["cap", "split"], "left_anti").select(*events.columns)
            events = kept(right.union(_split_events(again, split_bytes)), "events")
            places = events.select(cap.alias("cap"), "split", "begin", "end", F.col("status").isNull().alias("mark"))
            redone_ends = places.filter("mark").select("cap", "split", F.col("end").alias("mark_end"))
            ends = met.join(redone_ends, ["cap", "split"]).select("cap", "split", F.when(F.col("crossed"), F.col("mark_end")).otherwise(F.col("left")).alias("exit"))
        elif moved:
            ends = met.select("cap", "split", F.col("left").alias("exit"))
        else:
            break
    numbered = met.select("cap", "split", "entry", "dropped", F.coalesce(F.sum("stay").over(by_capture.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = events.filter("status is not null").withColumn("cap", cap).join(numbered, ["cap", "split"]).filter("begin >= entry")
    return found.select("device_id", "capture_id", "chunk_no", "arrival_ts", (F.col("place") - F.col("dropped") + F.col("before") + 1).alias("frame_no"), "status", "packet_type", "sequence_num", "timestamp_ticks", "payload")


PARSED = "status string, packet_type int, sequence_num int, timestamp_ticks long, payload binary"


def parse_framed(frames: DataFrame, data: str = "frame") -> DataFrame:
    """One frame a row: its columns, its fields and ``status``; other columns of these names are replaced. Header fields are null where the bytes end before them.

    All frames of a batch are read from one buffer, their fields at computed places and their checksums by ``buffers.crc16``.
    """
    ship_package(frames.sparkSession)
    new = StructType.fromDDL(PARSED)
    rows = frames.select(*[F.col(f"`{c}`").alias("_frame_bytes" if c in new.names else c) for c in frames.columns if c == data or c not in new.names])
    at_bytes = [c for c in frames.columns if c == data or c not in new.names].index(data)
    own = [f for f in rows.schema.fields if f.name != "_frame_bytes"]
    schema = StructType([*own, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = buffer_of(batch.column(at_bytes))
            start, size = offsets[:-1], np.diff(offsets)

            def field(at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
                known = size >= at + width  # noqa: B023
                return numbers(buffer, np.where(known, start + at, 0), width), ~known  # noqa: B023

            (version, _), (kind, no_kind), (sequence, no_sequence), (ticks, no_ticks), (length, no_length) = (field(*x) for x in ((2, 1), (3, 1), (4, 2), (6, 4), (10, 2)))
            sync, _ = field(0, 2)
            whole = (size >= 14) & (sync == int.from_bytes(SYNC, "little")) & (size == length + 14)
            end = np.where(whole, start + size - 2, start)
            good = crc16(buffer, np.where(whole, start + 2, start), end) == numbers(buffer, np.where(whole, end, 0), 2)
            status = np.where(~whole, "truncated", np.where(version != VERSION, "version", np.where(good, "ok", "crc")))
            raw = buffer.tobytes()
            payload = [None if n else raw[a + 12 : min(a + 12 + int(k), a + int(s))] for a, s, k, n in zip(start.tolist(), size, length, no_length, strict=True)]
            made = [
                pa.array(status.tolist(), pa.string()), pa.array(kind.astype(np.int32), mask=no_kind), pa.array(sequence.astype(np.int32), mask=no_sequence), pa.array(ticks, mask=no_ticks), pa.array(payload, pa.binary()),
            ]
            yield pa.record_batch([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_frame_bytes"), *made], schema.names)

    return rows.mapInArrow(run, schema)


def framed(packet_type: Column, sequence_num: Column, ticks: Column, payload: Column, broken: Column | None = None) -> Column:
    """A packet as the bytes of a frame; where ``broken``, all bits of its checksum are turned, so that it is wrong whatever it was."""
    body = F.concat(F.lit(bytes([VERSION])), to_little_endian(packet_type, 1), to_little_endian(sequence_num, 2), to_little_endian(ticks, 4), to_little_endian(F.octet_length(payload), 2), payload)
    turned = F.lit(0) if broken is None else F.when(broken, F.lit(0xFFFF)).otherwise(F.lit(0))
    return F.concat(F.lit(SYNC), body, to_little_endian(checksum(body).bitwiseXOR(turned), 2))


def packets_of(frames: DataFrame) -> DataFrame:
    """Accepted frames as packets, numbered in order for each device."""
    some = F.struct(F.col("capture_id"), ranges("frame_no", WIDTH))
    return Scan(["device_id"], ["capture_id", "frame_no"], some, sums={"pkt_no": F.lit(1).cast("long")}).over(frames.filter("status = 'ok'"))


def frame_quality(frames: DataFrame) -> DataFrame:
    """Accepted and rejected frames of each device by reason."""
    counts = [F.count_if(F.col("status") == s).alias(name) for s, name in (("ok", "packets"), ("crc", "crc_drops"), ("version", "version_rejects"), ("truncated", "truncated"))]
    return frames.groupBy("device_id").agg(*counts)


def parse_keyframe(payload: Column) -> Column:
    """struct(timestamp_ticks, task_count, tasks, heap_free_bytes, heap_min_ever_bytes, cpu_utilization_pct), or null where the length or task count is wrong."""
    def of(values: Column) -> Column:
        n = F.get(values, 6)
        good = (n <= MAX_TASKS) & (F.size(values) == 16 + 24 * n)

        def task(i: Column) -> Column:
            at = 7 + 24 * i
            return F.struct(
                F.regexp_replace(F.decode(F.substring(payload, at + 1, F.lit(16)), "US-ASCII"), r"\x00+$", "").alias("name"), F.get(values, at + 16).alias("state"), F.get(values, at + 17).alias("priority"),
                number_at(values, at + 18, 2).cast("int").alias("stack_hwm_words"), number_at(values, at + 20, 4).alias("runtime_ticks"),
            )

        tasks = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), task)
        end = 7 + 24 * n
        return F.when(good, F.struct(
            number_at(values, 2, 4).alias("timestamp_ticks"), n.alias("task_count"), tasks.alias("tasks"),
            number_at(values, end, 4).alias("heap_free_bytes"), number_at(values, end + 4, 4).alias("heap_min_ever_bytes"), F.get(values, end + 8).alias("cpu_utilization_pct"),
        ))

    return let(byte_values(payload), of)


def parse_delta(payload: Column, task_count: Column) -> Column:
    """array<struct<task_idx, field, value>> of a delta's entries; ``task_idx`` is 15 for the system.

    An entry of an unknown task is skipped by the width of its field (none if that is unknown too); elsewhere an unknown field or a cut-off value ends the
    parse, and what came before holds.
    """
    entry = "array<struct<task_idx:int,field:int,value:bigint>>"

    def width(field: Column, system: Column) -> Column:
        out = F.lit(0)
        for code, (_, w) in FIELDS.items():
            out = F.when((field == code) & (system == F.lit(code >= 5)), F.lit(w)).otherwise(out)
        return out

    def step(values: Column, acc: Column) -> Column:
        at, size = acc["at"], F.size(values)
        tag = F.get(values, at)
        task, field = F.call_function("shiftright", tag, F.lit(4)), tag.bitwiseAND(F.lit(15))
        system = task == SYSTEM_TAG
        w = width(field, system)
        known = system | (task < task_count)
        stops = (at >= size) | (known & ((w == 0) | (at + 1 + w > size)))
        value = F.when(w == 1, number_at(values, at + 1, 1)).when(w == 2, number_at(values, at + 1, 2)).otherwise(number_at(values, at + 1, 4))
        one = F.array(F.struct(task.alias("task_idx"), field.alias("field"), value.alias("value")))
        halted = acc["halted"] | stops
        return F.struct(
            F.when(halted, at).otherwise(at + 1 + w).alias("at"), halted.alias("halted"),
            F.when(halted | ~known, acc["entries"]).otherwise(F.concat(acc["entries"], one)).cast(entry).alias("entries"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("halted"), F.array().cast(entry).alias("entries"))
    # every entry takes a byte or more, so as many steps as bytes are enough
    return let(byte_values(payload), lambda values: F.aggregate(values, begin, lambda acc, _: step(values, acc), lambda acc: acc["entries"]))


CHANGED = "device_id string, epoch long, pkt_no long, place int, scope string, task_idx int, field string, value long"
#: Places of the fields inside a keyframe's task record, and behind the tasks.
_IN_TASK, _BEHIND = np.array([16, 17, 18, 20]), np.array([0, 4, 8])
_WIDTH = np.array([0, *(w for _, w in FIELDS.values()), *[0] * 8])


def _keyframe_entries(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """(packet, place, task, field, value) of every field of valid keyframes: the system's, then each task's."""
    many = len(_BEHIND) + len(_IN_TASK) * count
    packet = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(packet)) - np.repeat(np.cumsum(many) - many, many)
    of_task = place >= len(_BEHIND)
    task, field = np.divmod(np.maximum(place - len(_BEHIND), 0), len(_IN_TASK))
    at = start[packet] + 7 + np.where(of_task, 24 * task + _IN_TASK[field], 24 * count[packet] + _BEHIND[np.minimum(place, len(_BEHIND) - 1)])
    number = np.where(of_task, field + 1, len(_IN_TASK) + 1 + np.minimum(place, len(_BEHIND) - 1))
    return [packet, place, np.where(of_task, task, SYSTEM_TAG), number, numbers(data, at, _WIDTH[number])]


def _delta_entries(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """(packet, place, task, field, value) of deltas by the rules of ``parse_delta``: one entry of every packet a step."""
    at, place, found = start.copy(), np.zeros(len(start), np.int64), [np.zeros((5, 0), np.int64)]
    alive = np.flatnonzero(at < stop)
    while len(alive):
        tag = data[at[alive]].astype(np.int64)
        task, field = tag >> 4, tag & 15
        system = task == SYSTEM_TAG
        width = np.where((field > len(_IN_TASK)) == system, _WIDTH[field], 0)
        known = system | (task < count[alive])
        halts = known & ((width == 0) | (at[alive] + 1 + width > stop[alive]))
        given = known & ~halts
        at_value = at[alive] + 1
        found.append(np.stack([alive[given], place[alive[given]], task[given], field[given], numbers(data, at_value[given], width[given])]))
        place[alive[given]] += 1
        at[alive] += 1 + width
        alive = alive[~halts & (at[alive] < stop[alive])]
    return list(np.concatenate(found, 1))


def expand_payloads(packets: DataFrame) -> DataFrame:
    """``device_id, epoch, pkt_no, place, scope, task_idx, field, value``: what every keyframe and delta sets, in order.

    Deltas before a device's first valid keyframe say nothing. A keyframe sets all its fields. The fields of a batch are read from one buffer at computed places.
    """
    ship_package(packets.sparkSession)
    count = F.conv(F.hex(F.substring("payload", 7, 1)), 16, 10).cast("int")
    valid = F.coalesce((F.col("packet_type") == KEYFRAME) & (count <= MAX_TASKS) & (F.octet_length("payload") == 16 + 24 * count), F.lit(False))
    read = packets.select("device_id", "pkt_no", "packet_type", "payload", valid.alias("is_valid_keyframe"), F.when(valid, count).alias("given_count"))
    counted = rebuild_state(read, {"given_count": "task_count"}).filter(F.col("is_valid_keyframe") | (F.col("packet_type") == DELTA))
    names = pa.array([None, *(name for name, _ in FIELDS.values())])
    columns = [c.split()[0] for c in CHANGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(5))
            key, tasks = np.asarray(batch.column(3)), np.asarray(batch.column(4)).astype(np.int64)
            parts = []
            for some, entries in ((np.flatnonzero(key), lambda i: _keyframe_entries(data, offsets[i], tasks[i])), (np.flatnonzero(~key), lambda i: _delta_entries(data, offsets[i], offsets[i + 1], tasks[i]))):  # noqa: B023
                packet, *rest = entries(some)
                parts.append(np.stack([some[packet], *rest]))
            packet, place, task, field, value = np.concatenate(parts, 1)
            order = np.lexsort((place, packet))
            at, system = pa.array(packet[order]), task[order] == SYSTEM_TAG
            own = [batch.column(i).take(at) for i in range(3)]
            scope = pa.array(["task", "system"]).take(pa.array(system.astype(np.int8)))
            yield pa.record_batch([*own, pa.array(place[order].astype(np.int32)), scope, pa.array(task[order].astype(np.int32)), names.take(pa.array(field[order])), pa.array(value[order])], columns)

    return counted.select("device_id", "epoch", "pkt_no", "is_valid_keyframe", "task_count", "payload").mapInArrow(run, CHANGED)


def task_names(packets: DataFrame) -> DataFrame:
    """``device_id, epoch, task_idx, task_name`` of the tasks in every valid keyframe."""
    read = packets.withColumn("keyframe", F.when(F.col("packet_type") == KEYFRAME, parse_keyframe(F.col("payload"))))
    epochs = keyframe_epoch(read.withColumn("is_valid_keyframe", F.col("keyframe").isNotNull())).filter("is_valid_keyframe")
    return epochs.select("device_id", "epoch", F.posexplode("keyframe.tasks").alias("task_idx", "t")).select("device_id", "epoch", "task_idx", F.col("t.name").alias("task_name"))


def strict_delta(changes: DataFrame) -> DataFrame:
    """Field changes that break the wire contract: a task field on the system tag or the reverse, or a key set twice in a packet."""
    tasks_only = [name for number, (name, _) in FIELDS.items() if number < 5]
    misplaced = F.col("field").isNull() | (F.col("field").isin(*tasks_only) != (F.col("scope") == "task"))
    times = F.count("*").over(Window.partitionBy("device_id", "pkt_no", "task_idx", "field"))
    return changes.withColumn("problem", F.when(misplaced, "misplaced").when(times > 1, "repeated")).filter("problem is not null")


def keyframe_payload(sequence: Column, ticks: Column, tasks: Column, heap_free: Column, heap_min: Column, cpu: Column) -> Column:
    """The bytes of a keyframe; ``tasks`` is an array of structs like those of ``parse_keyframe``."""

    def one(t: Column) -> Column:
        name = F.rpad(F.encode(F.substring(t["name"], 1, 15), "US-ASCII"), 16, b"\x00")
        return F.concat(name, to_little_endian(t["state"], 1), to_little_endian(t["priority"], 1), to_little_endian(t["stack_hwm_words"], 2), to_little_endian(t["runtime_ticks"], 4))

    body = F.aggregate(F.transform(tasks, one), F.lit(b""), lambda a, x: F.concat(a, x))
    return F.concat(to_little_endian(sequence, 2), to_little_endian(ticks, 4), to_little_endian(F.size(tasks), 1), body, to_little_endian(heap_free, 4), to_little_endian(heap_min, 4), to_little_endian(cpu, 1))


def delta_payload(entries: Column) -> Column:
    """The bytes of entries (task_idx, field, value), in order."""

    def one(e: Column) -> Column:
        tag = to_little_endian(e["task_idx"] * 16 + e["field"], 1)
        wide = F.when(e["field"].isin(1, 2, 7), to_little_endian(e["value"], 1)).when(e["field"] == 3, to_little_endian(e["value"], 2)).otherwise(to_little_endian(e["value"], 4))
        return F.concat(tag, wide)

    return F.aggregate(F.transform(entries, one), F.lit(b""), lambda a, x: F.concat(a, x))
