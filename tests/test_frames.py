"""Golden vectors, resynchronisation, and round trips of frames."""

import pytest
from pyspark.sql import functions as F

from beaconlake.functions.wire import crc16
from beaconlake.sources import frames

DELTA = bytes.fromhex("aa5501013512680302010700f5201e0000f70a362d")
KEY_PAYLOAD = bytes.fromhex("34120403020101") + b"IDLE".ljust(16, b"\0") + bytes.fromhex("0000200064000000401f0000001e000007")
KEY = bytes.fromhex("aa550102341204030201 2800") + KEY_PAYLOAD + bytes.fromhex("9685")


def test_crc_vector(spark):
    row = spark.range(1).select(crc16(F.lit(b"123456789")).alias("a"), crc16(F.lit(DELTA[2:-2])).alias("b"), crc16(F.lit(b"")).alias("c")).first()
    assert (row.a, row.b, row.c) == (0x29B1, 0x2D36, 0xFFFF)


def test_scan_delta():
    found, rest = frames.scan(DELTA)
    assert rest == b"" and [(f.status, f.packet_type, f.sequence_num, f.timestamp_ticks, f.payload) for f in found] == [("ok", 1, 0x1235, 0x01020368, DELTA[12:-2])]


def test_scan_byte_by_byte():
    rest, count = b"", []
    for i in range(len(DELTA)):
        found, rest = frames.scan(rest + DELTA[i : i + 1])
        count.append(len(found))
    assert count == [0] * 20 + [1] and rest == b""


def test_scan_rejects_and_resumes():
    bad = DELTA[:-1] + b"\xd2"
    assert [f.status for f in frames.scan(bad + DELTA)[0]] == ["crc", "ok"]
    assert [f.status for f in frames.scan(b"\x12\x34\xaa\xaa\x56" + DELTA)[0]] == ["ok"]
    assert [f.status for f in frames.scan(b"\xaa" + DELTA)[0]] == ["ok"]
    wrong = DELTA[:2] + b"\x09" + DELTA[3:]
    assert [f.status for f in frames.scan(wrong + DELTA)[0]] == ["version", "ok"]


@pytest.mark.parametrize("step", [1, 7, 64])
def test_ingest_chunks_equal_whole(spark, step):
    data = b"\x00\xaa" + DELTA + DELTA[:-1] + b"\xd2" + KEY + DELTA[:9]
    rows = [("d", "c", i, None, data[i * step : (i + 1) * step]) for i in range(-(-len(data) // step))]
    out = frames.ingest_frames(spark.createDataFrame(rows, "device_id string, capture_id string, chunk_no long, arrival_ts timestamp, bytes binary")).orderBy("frame_no").collect()
    assert [r.status for r in out] == ["ok", "crc", "ok", "truncated"]
    assert bytes(out[2].payload) == KEY_PAYLOAD


def test_ingest_empty(spark):
    none = spark.createDataFrame([], "device_id string, capture_id string, chunk_no long, arrival_ts timestamp, bytes binary")
    assert frames.ingest_frames(none).count() == 0


def test_parse_framed(spark):
    bad = DELTA[:-1] + b"\xd2"
    rows = spark.createDataFrame([(0, DELTA), (1, bad), (2, KEY), (3, DELTA[:5]), (4, None), (5, DELTA[:2] + b"\x02" + DELTA[3:])], "i int, frame binary")
    out = frames.parse_framed(rows).orderBy("i").collect()
    assert [r.status for r in out] == ["ok", "crc", "ok", "truncated", "truncated", "version"]
    assert out[0].sequence_num == 0x1235 and bytes(out[2].payload) == KEY_PAYLOAD


def test_framed_round_trip(spark):
    row = spark.range(1).select(frames.framed(F.lit(1), F.lit(0x1235), F.lit(0x01020368), F.lit(DELTA[12:-2])).alias("f")).first()
    assert bytes(row.f) == DELTA


def test_keyframe_golden(spark):
    row = spark.range(1).select(frames.parse_keyframe(F.lit(KEY_PAYLOAD)).alias("k"), frames.parse_keyframe(F.lit(KEY_PAYLOAD[:-1])).alias("cut"), frames.parse_keyframe(F.lit(KEY_PAYLOAD[:6] + b"\x11" + KEY_PAYLOAD[7:])).alias("many")).first()
    task = row.k.tasks[0]
    assert (row.k.timestamp_ticks, row.k.heap_free_bytes, row.k.heap_min_ever_bytes, row.k.cpu_utilization_pct) == (0x01020304, 8000, 7680, 7)
    assert (task.name, task.state, task.priority, task.stack_hwm_words, task.runtime_ticks) == ("IDLE", 0, 0, 32, 100)
    assert row.cut is None and row.many is None


def test_keyframe_sizes(spark):
    one = F.struct(F.lit("T").alias("name"), F.lit(1).alias("state"), F.lit(2).alias("priority"), F.lit(3).alias("stack_hwm_words"), F.lit(4).alias("runtime_ticks"))
    for n, size in ((0, 16), (1, 40), (2, 64)):
        payload = frames.keyframe_payload(F.lit(1), F.lit(2), F.slice(F.array(one, one), 1, n), F.lit(5), F.lit(6), F.lit(7))
        row = spark.range(1).select(payload.alias("p"), frames.parse_keyframe(payload).alias("k")).first()
        assert len(row.p) == size and row.k.task_count == n and len(row.k.tasks) == n


def test_delta_rules(spark):
    def parsed(data, n):
        return [tuple(e) for e in spark.range(1).select(frames.parse_delta(F.lit(bytes.fromhex(data)), F.lit(n)).alias("e")).first().e]

    assert parsed("f5201e0000f70a", 1) == [(15, 5, 7712), (15, 7, 10)]
    assert parsed("2105f70a", 2) == [(15, 7, 10)]  # unknown task: skipped by its field's width
    assert parsed("2905f70a", 2) == []  # unknown task and field: no width, then 05 is a tag of task 0 with an unknown field
    assert parsed("f70a0905f70b", 1) == [(15, 7, 10)]  # known task, unknown field: the parse ends
    assert parsed("f5201e", 1) == []  # cut off
    assert parsed("", 1) == []


def test_state_from_payloads(spark):
    delta = bytes.fromhex("f5201e0000f70a0102049600 0000".replace(" ", ""))
    rows = [("d", 1, 1, delta), ("d", 2, 2, KEY_PAYLOAD), ("d", 3, 1, delta)]
    out = frames.expand_payloads(spark.createDataFrame(rows, "device_id string, pkt_no long, packet_type int, payload binary"))
    last = {(r.scope, r.field): r.value for r in out.filter("pkt_no = 3").collect()}
    assert last == {("system", "heap_free_bytes"): 7712, ("system", "cpu_utilization_pct"): 10, ("task", "state"): 2, ("task", "runtime_ticks"): 150}
    assert out.filter("pkt_no = 1").count() == 0


def test_captures_as_files_and_as_chunk_tables(spark, tmp_path):
    """The same frames from one file a capture, from a table of chunks that cut them, and from a stream of that table."""
    for device in ("a", "b"):
        (tmp_path / "files" / device).mkdir(parents=True)
        (tmp_path / "files" / device / "run").write_bytes(b"xx" + DELTA + KEY)
    whole = frames.read_chunks(spark.read, f"{tmp_path}/files/*/*")
    columns = ["device_id", "capture_id", "frame_no", "status", "sequence_num", "payload"]
    want = sorted(map(tuple, frames.ingest_frames(whole).select(*columns).collect()))
    assert [(r[0], r[1], r[3]) for r in want] == [(d, "run", "ok") for d in "aabb"]
    data = b"xx" + DELTA + KEY
    rows = [(d, "run", i, None, data[i * 7 : i * 7 + 7]) for d in "ab" for i in range(-(-len(data) // 7))]
    spark.createDataFrame(rows, frames.CHUNKS).repartition(3).write.parquet(f"{tmp_path}/table")
    cut = frames.read_chunk_table(spark.read, f"{tmp_path}/table")
    assert sorted(map(tuple, frames.ingest_frames(cut).select(*columns).collect())) == want
    assert frames.read_chunk_table(spark.readStream, f"{tmp_path}/table").isStreaming


def test_broken_frames_are_never_ok(spark, tmp_path):
    """The frame of event 4295548 has the checksum 0, so that writing zeros over it would break nothing."""
    from beaconlake.plans import queries

    row = spark.range(1).select(F.lit(4295548).alias("event_id"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    row.select(F.col("event_id").cast("long").alias("event_id"), "ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    frame = queries.frame_rows(spark, str(tmp_path))
    right = crc16(F.substring("frame", F.lit(3), F.octet_length("frame") - 4))
    assert frame.select(right.alias("right")).first().right == 0
    assert [r.status for r in queries.parse_framed(spark, str(tmp_path)).collect()] == ["crc"]
