"""Streams with linear windows, reordering and late rows, and the chain from chunks to alerts with a restart in the middle."""

import datetime
import glob
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.operators import trend
from beaconlake.params import OomParams
from beaconlake.sources import frames
from beaconlake.streaming import processors
from test_captures import frame

T0 = datetime.datetime(2024, 1, 1)
SAMPLES = "device_id string, pkt_no long, arrival_ts timestamp, heap_free_bytes long"


def folder():
    return tempfile.mkdtemp(prefix="spark-stream-")


def write_parts(spark, schema, parts, path):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert query.exception() is None
    return query


def heap_rows(seed, n):
    rng = random.Random(seed)
    rows, t = [], {"leak": 0.0, "saw": 0.0, "flat": 0.0, "still": 0.0}
    for i in range(n):
        for d in t:
            t[d] += 0 if d == "still" else rng.choice([0.1, 0.1, 0.3, 0.0])
            y = {"leak": 900_000 - 300 * i + rng.randint(-50, 50), "saw": 500_000 - (i % 50) * 4000, "flat": 4_000_000_000 + rng.randint(0, 9), "still": 1000 - i}[d]
            rows.append((d, i * 2 + 1, T0 + datetime.timedelta(seconds=round(t[d], 3)), y))
    return rows


@pytest.mark.parametrize("size", [7, 600])
def test_leak_stream_equals_batch(spark, size):
    p = OomParams(window_size=size, min_samples=5, total_heap_bytes=1 << 20)
    n = 40 if size == 7 else 650
    rows = heap_rows(size, n)
    parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    at = folder()
    write_parts(spark, SAMPLES, parts, f"{at}/in")
    run(processors.stream_oom(source(spark, SAMPLES, f"{at}/in"), p).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").outputMode("append"))
    got = {(r.device_id, r.pkt_no): r for r in spark.read.parquet(f"{at}/out").filter("not late").collect()}
    want = trend.oom_series(spark.createDataFrame(rows, SAMPLES), p).collect()
    assert len(got) == len(want) == len(rows)
    for w in want:
        g = got[(w.device_id, w.pkt_no)]
        assert (g.n, g.heap_free_bytes) == (w.n, w.heap_free_bytes)
        assert g.slope == pytest.approx(w.slope, rel=1e-12) and g.r2 == pytest.approx(w.r2, rel=1e-12) and g.projection == pytest.approx(w.projection, rel=1e-12)


class Counted(dict):
    """A map state in memory that counts calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


@pytest.mark.parametrize("shape", ["random", "rising", "falling"])
def test_queue_work_does_not_grow_with_the_window(shape):
    rng = np.random.default_rng(1)
    values = {"random": rng.integers(0, 1000, 3000), "rising": np.arange(3000), "falling": -np.arange(3000)}[shape].tolist()
    calls = {}
    for size in (10, 1000):
        state, head, tail = Counted(), 0, 0
        for first in range(0, 3000, 5):  # a micro-batch of five samples
            queue = processors.Minimum(processors.Changes(state), head, tail)
            for i in range(first, first + 5):
                queue.add(i, values[i])
                start = max(0, i - size + 1)
                assert queue.least(start) == min(values[start : i + 1])
            queue.entries.flush()
            head, tail = queue.head, queue.tail
            assert len(state) == tail - head
        calls[size] = state.calls / 3000
    assert calls[1000] <= 8 and calls[10] <= 8


def test_total_heap_by_device(spark):
    rows = [("a", i, T0 + datetime.timedelta(seconds=i), 1000 - 100 * (i % 10)) for i in range(40)] + [("b", i, T0 + datetime.timedelta(seconds=i), 1000 - 100 * (i % 10)) for i in range(40)]
    p, at = OomParams(min_samples=5, window_size=16, total_heap_bytes=1 << 30), folder()
    devices = spark.createDataFrame([("a", 2000)], "device_id string, total_heap_bytes long")
    write_parts(spark, SAMPLES, [rows], f"{at}/in")
    run(processors.stream_oom(source(spark, SAMPLES, f"{at}/in"), p, devices).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").outputMode("append"))
    got = {(r.device_id, r.pkt_no): r.projection for r in spark.read.parquet(f"{at}/out").collect()}
    want = {(r.device_id, r.pkt_no): r.projection for r in trend.oom_series(spark.createDataFrame(rows, SAMPLES), p, devices).collect()}
    assert got == pytest.approx(want) and any(x == -2.0 for (d, _), x in got.items() if d == "a") and all(x != -2.0 for (d, _), x in got.items() if d == "b")


ROWS = "device_id string, pkt_no long, arrival_ts timestamp, value string, payload binary"


def test_shuffled_rows_come_in_order(spark):
    """Arrival shuffled inside the delay equals sorted arrival; what is later is in the side table, and none is lost."""
    rng = random.Random(4)
    rows = [(d, i, T0 + datetime.timedelta(seconds=i), f"{d}{i}" if i % 3 else None, bytes([i])) for d in ("a", "b") for i in range(60)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 8))
    late = [("a", 2, T0 + datetime.timedelta(seconds=2), "again", b""), ("b", 30, T0 + datetime.timedelta(seconds=30), "twice", b"")]
    parts = [rows[:30], rows[30:70], rows[70:] + late, [("a", 1000, T0 + datetime.timedelta(seconds=1000), None, None), ("b", 1000, T0 + datetime.timedelta(seconds=1000), None, None)]]
    at = folder()
    write_parts(spark, ROWS, parts, f"{at}/in")
    ordered = processors.stream_in_order(source(spark, ROWS, f"{at}/in"), 10)
    assert ordered.columns == ["device_id", "pkt_no", "arrival_ts", "value", "payload", "late"]
    run(processors.write_with_late_rows(ordered, f"{at}/good", f"{at}/late", f"{at}/c"))
    good = spark.read.parquet(f"{at}/good").collect()
    assert sorted((r.device_id, r.pkt_no, r.value, bytes(r.payload)) for r in good) == sorted((d, i, v, bytes(x)) for d, i, _, v, x in rows)
    # a batch never releases a number below one of an earlier batch
    for d in ("a", "b"):
        seen = sorted((r.batch, r.pkt_no) for r in good if r.device_id == d)
        assert [n for _, n in seen] == sorted(n for _, n in seen)
    assert sorted((r.device_id, r.pkt_no, r.value) for r in spark.read.parquet(f"{at}/late").collect()) == [("a", 2, "again"), ("b", 30, "twice")]


def test_silent_devices_are_released(spark):
    """A device that says nothing more gives its waiting rows when its time is up, without a row of its own."""
    parts = [[("a", i, T0 + datetime.timedelta(seconds=i), "x", b"") for i in (3, 1, 2)], [("b", 1, T0, "y", b"")], [("b", 2, T0, "y", b"")]]
    at = folder()
    write_parts(spark, ROWS, parts, f"{at}/in")
    writer = processors.write_with_late_rows(processors.stream_in_order(source(spark, ROWS, f"{at}/in"), 10, idle_seconds=0.001), f"{at}/good", f"{at}/late", f"{at}/c")
    query, good = writer.trigger(processingTime="100 milliseconds").start(), []
    try:
        for _ in range(100):
            time.sleep(1)
            folders = glob.glob(f"{at}/good/batch=*")
            if folders and len(good := spark.read.option("basePath", f"{at}/good").schema(f"{ROWS}, batch int").parquet(*folders).filter("device_id = 'a'").collect()) == 3:
                break
    finally:
        query.stop()
    assert query.exception() is None
    assert sorted(r.pkt_no for r in good) == [1, 2, 3] and len({r.batch for r in good}) == 1


def test_a_repeated_batch_is_written_once(spark):
    at = folder()
    write_parts(spark, ROWS, [[("a", i, T0 + datetime.timedelta(seconds=i), "x", b"") for i in range(9)]], f"{at}/in")
    rows = source(spark, ROWS, f"{at}/in").withColumn("late", F.col("pkt_no") < 3)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint runs the batch again
        run(processors.write_with_late_rows(rows, f"{at}/good", f"{at}/late", f"{at}/{checkpoint}"))
    assert spark.read.parquet(f"{at}/good").count() == 6 and spark.read.parquet(f"{at}/late").count() == 3


CHUNK = "device_id string, chunk_no long, arrival_ts timestamp, bytes binary"


def capture(seed, packets):
    """Keyframes and deltas of a falling heap, cut into chunks, with damaged frames between them."""
    rng = random.Random(seed)
    data, ends, heap = b"", [], 1_000_000
    for i in range(packets):
        heap -= rng.randint(50, 150)
        if i % 20 == 2:
            payload = bytes(6) + b"\x01" + b"task".ljust(16, b"\0") + bytes([0, 1]) + (100).to_bytes(2, "little") + i.to_bytes(4, "little") + heap.to_bytes(4, "little") + heap.to_bytes(4, "little") + b"\x05"
            kind = 2
        else:
            payload, kind = (b"\xf5" + heap.to_bytes(4, "little")) if i % 3 else b"\xf7\x09", 1
        whole = bytearray(frame(i, payload))
        whole[3] = kind
        whole[-2:] = frames.CRC.pack(frames.binascii.crc_hqx(bytes(whole[2:-2]), 0xFFFF))
        data += bytes(whole) if i % 17 else bytes(whole[:-1]) + b"\x00"
        ends.append(len(data))
    chunks, at, number = [], 0, 0
    while at < len(data):
        stop = min(len(data), at + rng.randint(5, 60))
        chunks.append((number, T0 + datetime.timedelta(milliseconds=100 * number), data[at:stop]))
        at, number = stop, number + 1
    return chunks


def test_chain_with_a_restart_equals_batch(spark):
    p = OomParams(window_size=25, min_samples=5)
    rows = [(d, n, ts, b) for d, seed in (("a", 1), ("b", 2)) for n, ts, b in capture(seed, 120)]
    rows.sort(key=lambda r: r[1])
    third = len(rows) // 3
    at = folder()
    first, rest = [rows[:third]], [rows[third : 2 * third], rows[2 * third :]]

    def stream():
        return processors.stream_leaks(source(spark, CHUNK, f"{at}/in"), p).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").outputMode("append")

    write_parts(spark, CHUNK, first, f"{at}/in")
    run(stream())  # stopped between micro-batches, with frames cut at the border
    write_parts(spark, CHUNK, rest, f"{at}/in")
    run(stream())
    out = spark.read.parquet(f"{at}/out")

    table = spark.createDataFrame(rows, CHUNK).withColumn("capture_id", F.lit("c"))
    packets = frames.packets_of(frames.ingest_frames(table))
    sets = frames.expand_payloads(packets).filter("field = 'heap_free_bytes'").groupBy("device_id", "pkt_no").agg(F.max_by("value", "place").alias("heap_d"))
    keys = frames.task_names(packets).select("device_id", "epoch").distinct().count()
    from beaconlake.operators import state

    marked = packets.join(sets, ["device_id", "pkt_no"], "left").withColumn("is_valid_keyframe", F.col("packet_type") == 2)
    samples = state.heap_samples(marked)
    want = {(r.device_id, r.pkt_no): (r.n, round(r.projection, 6), r.heap_free_bytes) for r in trend.oom_series(samples, p).collect()}
    got = {(r.device_id, r.pkt_no): (r.n, round(r.projection, 6), r.heap_free_bytes) for r in out.collect()}
    assert keys > 2 and got == want and any(x[1] > 0 for x in want.values())
    alerts = processors.alerts_of(out).collect()
    assert {(r.device_id, r.pkt_no) for r in alerts} == {k for k, x in want.items() if x[1] > 0 or x[1] == -2.0}
    assert processors.metrics_of(out).count() == 2 * len(want)
