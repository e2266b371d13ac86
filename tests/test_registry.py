"""The registry read from the state store and made from packets, and streams that begin with one."""

import random

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import state
from beaconlake.sources.frames import DELTA, FIELDS, KEYFRAME
from beaconlake.streaming import processors, registry
from test_streams import folder, run, source, write_parts

PACKETS = "device_id string, pkt_no long, packet_type int, payload binary"


def keyframe(r, tasks):
    body = b"".join(f"t{r.randint(0, 5)}".encode().ljust(16, b"\0") + bytes([r.randint(0, 4), r.randint(0, 9)]) + r.randbytes(2) + r.randbytes(4) for _ in range(tasks))
    return r.randbytes(6) + bytes([tasks]) + body + r.randbytes(9)


def delta(r):
    out = b""
    for _ in range(r.randint(0, 4)):
        task = r.choice([0, 1, 2, 3, 15])
        field = r.choice([5, 6, 7] if task == 15 else [1, 2, 3, 4])
        out += bytes([task << 4 | field]) + r.randbytes(FIELDS[field][1])
    return out + (b"\xf5\x01" if r.random() < 0.1 else b"")  # cut off


def packets(seed):
    """Devices with keyframes of other sizes in between, damaged ones, and one device without any."""
    r, rows = random.Random(seed), []
    for d in ["a", "b", "c", "d", "none", None]:
        for i in range(1, 41):
            if d != "none" and r.random() < 0.12:
                payload = keyframe(r, r.randint(0, 4))
                rows.append((d, i, KEYFRAME, payload[: -r.randint(0, 1)] if r.random() < 0.2 else payload))
            else:
                rows.append((d, i, DELTA, delta(r)))
    return rows


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def both(spark):
    rows, at = packets(3), folder()
    early, late = [x for x in rows if x[1] <= 25], [x for x in rows if x[1] > 25]
    write_parts(spark, PACKETS, [early, late], f"{at}/in")
    whole = processors.stream_full_state(source(spark, PACKETS, f"{at}/in"))
    run(whole.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").outputMode("append"))
    return rows, early, late, at


def test_state_store_equals_packets(spark, both):
    rows, early, _, at = both
    made = registry.of_packets(spark.createDataFrame(rows, PACKETS))
    assert made.count() == 6 and made.schema.simpleString() == registry.of_stream(spark, f"{at}/c").schema.simpleString()
    assert rows_of(registry.of_stream(spark, f"{at}/c")) == rows_of(made)
    found = made.filter("device_id = 'none'").first()
    assert (found.pkt_no, found.epoch, found.heap_free_bytes, found.tasks) == (40, 0, None, [])
    # as it was after the first micro-batch
    before = [registry.of_stream(spark, f"{at}/c", batch=n) for n in (0, 1)]
    wanted = rows_of(registry.of_packets(spark.createDataFrame(early, PACKETS)))
    assert rows_of(before[0]) == wanted and rows_of(before[1]) != wanted


def test_lookup_makes_no_entry(spark, both):
    at = both[3]
    known = registry.of_stream(spark, f"{at}/c").drop("tasks")
    wanted = spark.createDataFrame([("a",), ("new",)], "device_id string")
    got = {r.device_id: r.created for r in state.device_get_or_create(wanted, known, {"epoch": 0}).collect()}
    assert got == {"a": False, "new": True}
    assert registry.of_stream(spark, f"{at}/c").filter("device_id = 'new'").count() == 0


def test_stream_from_a_registry(spark, both):
    """A batch over the first packets and a stream over the others give what one stream over all gives, and the same registry."""
    rows, early, late, at = both
    new = folder()
    write_parts(spark, PACKETS, [late[: len(late) // 2], late[len(late) // 2 :]], f"{new}/in")
    begun = registry.stream_from(source(spark, PACKETS, f"{new}/in"), registry.of_packets(spark.createDataFrame(early, PACKETS)))
    run(begun.writeStream.format("parquet").option("path", f"{new}/out").option("checkpointLocation", f"{new}/c").outputMode("append"))
    tail = spark.read.parquet(f"{at}/out").filter("pkt_no > 25 and not late")
    assert tail.count() > 20 and rows_of(spark.read.parquet(f"{new}/out").filter("not late")) == rows_of(tail)
    assert rows_of(registry.of_stream(spark, f"{new}/c")) == rows_of(registry.of_stream(spark, f"{at}/c"))


def test_purged_devices_begin_anew(spark, both):
    _, early, late, _ = both
    new = folder()
    write_parts(spark, PACKETS, [[x for x in late if x[0] in ("a", "b")]], f"{new}/in")
    records = registry.of_packets(spark.createDataFrame(early, PACKETS))
    few = registry.purged(records, spark.createDataFrame([("a",)], "device_id string"))
    assert few.count() == 5
    begun = registry.stream_from(source(spark, PACKETS, f"{new}/in"), few)
    run(begun.writeStream.format("noop").option("checkpointLocation", f"{new}/c").outputMode("append"))
    got = {r.device_id: r.epoch for r in registry.of_stream(spark, f"{new}/c").collect()}
    alone = {r.device_id: r.epoch for r in registry.of_packets(spark.createDataFrame([x for x in late if x[0] == "a"], PACKETS)).collect()}
    whole = {r.device_id: r.epoch for r in registry.of_packets(spark.createDataFrame([x for x in early + late if x[0] == "b"], PACKETS)).collect()}
    assert got["a"] == alone["a"] and got["b"] == whole["b"]


def test_running_counters_from_the_state(spark):
    rows = [(d, i, (i * 2) % 7 + i, i % 5 == 1, 100 - i, i) for d in ("a", "b") for i in range(1, 20)]
    schema, at = "device_id string, pkt_no long, sequence_num int, is_valid_keyframe boolean, heap_d long, cpu_d long", folder()
    write_parts(spark, schema, [rows], f"{at}/in")
    run(processors.stream_state(source(spark, schema, f"{at}/in")).writeStream.format("noop").option("checkpointLocation", f"{at}/c").outputMode("append"))
    from beaconlake.operators import quality

    rebuilt = state.rebuild_state(quality.running_counters(spark.createDataFrame(rows, schema)), {"heap_d": "heap", "cpu_d": "cpu"})
    want = state.latest_state(rebuilt.withColumnsRenamed({"packet_count": "packets", "drop_count": "drops"}), ["epoch", "heap", "cpu", "packets", "drops"])
    got = registry.read_state(spark, f"{at}/c", "state").select(want.columns)
    assert rows_of(got) == rows_of(want)
