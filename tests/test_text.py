"""Text sources on small copies of the documented formats."""

import datetime

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import metrics, reports
from beaconlake.sources import text


def test_exposition(spark):
    lines = ["# HELP m x", 'm{device_id="a",task_name="Tmr, \\"S\\" \\\\n"} 8.5e-07', "plain -1.0", "not a sample line here", ""]
    out = text.read_exposition(spark.createDataFrame([("2026-05-12_03-06-48.txt", x) for x in lines], "file string, line string")).orderBy("metric").collect()
    assert [(r.metric, r.attrs, r.value) for r in out] == [("m", {"device_id": "a", "task_name": 'Tmr, "S" \\n'}, 8.5e-07), ("plain", {}, -1.0)]
    assert out[0].ts.replace(tzinfo=None) == datetime.datetime(2026, 5, 12, 3, 6, 48)


def test_progress_and_cadence(spark):
    lines = ["22:49:07 [INFO] bridge.main: [main] 110 packets received | drops=0 | seq_gaps=0", "noise", "22:50:10 [INFO] bridge.main: [main] 710 packets received | drops=1 | seq_gaps=2", "00:00:01 [INFO] x: 720 packets received | drops=1 | seq_gaps=2"]
    out = text.read_progress_log(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")).orderBy("line_no").collect()
    assert [(r.packets, r.drops, r.seq_gaps) for r in out] == [(110, 0, 0), (710, 1, 2), (720, 1, 2)]
    assert out[2].seconds == 86401
    rows = spark.createDataFrame([("d", r.seconds, r.packets) for r in out[:2]], "device_id string, s long, packets long").select("device_id", F.timestamp_seconds("s").alias("ts"), "packets")
    assert reports.cadence(rows).first().hz == pytest.approx(9.52, abs=0.01)


def test_profile_and_overhead(spark):
    body = "junk\x00[PROFILER] snapshot_capture min=58644 max=70770 mean=58998 cycles samples=3700\n[MEASURE] telemetry_cycle min=71750 max=98624 mean=72987 cycles samples=100 tail"
    out = text.read_profile_lines(spark.createDataFrame([("f", body)], "file string, text string"))
    cost = reports.cycles_to_overhead(out.filter("kind = 'MEASURE'"), 84, 100000).first()
    assert cost.mean_us == pytest.approx(868.9, abs=0.05) and cost.overhead_pct == pytest.approx(0.869, abs=0.001)
    assert out.filter("kind = 'PROFILER'").first().samples == 3700


def test_profile_stats(spark):
    row = reports.profile_stats(spark.createDataFrame([("x", 150), ("x", 90), ("x", 210)], "label string, cycles long")).first()
    assert (row.min_cycles, row.max_cycles, row.samples, row.total_cycles, row.mean_cycles) == (90, 210, 3, 450, 150)


DUMP = """info Metrics
Metric #0
Descriptor:
     -> Name: rtos.heap.free_bytes
     -> Unit: By
NumberDataPoints #0
Data point attributes:
     -> device_id: Str(nucleo)
StartTimestamp: 1970-01-01 00:00:00 +0000 UTC
Timestamp: 2026-05-11 18:33:22.4971156 +0000 UTC
Value: 12568
Metric #1
Descriptor:
     -> Name: rtos.task.cpu_ratio
     -> Unit: 1
NumberDataPoints #0
Data point attributes:
     -> device_id: Str(nucleo)
     -> task_name: Str(IDLE)
Timestamp: 2026-05-11 18:33:22.4971156 +0000 UTC
Value: 0.900000
NumberDataPoints #1
Data point attributes:
     -> device_id: Str(nucleo)
     -> task_name: Str(Tmr Svc)
Timestamp: 2026-05-11 18:33:22.4971156 +0000 UTC
Value: 0.100000
"""


def test_otlp_dump(spark):
    out = text.read_otlp_dump(spark.createDataFrame([("f", DUMP)], "file string, text string")).collect()
    assert sorted((r.name, r.unit, tuple(sorted(r.attrs.items())), r.value) for r in out) == [
        ("rtos.heap.free_bytes", "By", (("device_id", "nucleo"),), 12568.0),
        ("rtos.task.cpu_ratio", "1", (("device_id", "nucleo"), ("task_name", "IDLE")), 0.9),
        ("rtos.task.cpu_ratio", "1", (("device_id", "nucleo"), ("task_name", "Tmr Svc")), 0.1),
    ]


def test_soak_texts(spark):
    body = 'Started\n\n[2026-05-12_03-06-48]\nm{device_id="a"} -1.0\nn{device_id="a"} 0.5\n\n[2026-05-12_03-11-50]\nm{device_id="a"} -1.0\n'
    out = text.read_soak_summary(spark.createDataFrame([("f", body)], "file string, text string"))
    assert {(r.metric, r.samples, r.stable) for r in reports.soak_summary(out.withColumn("device_id", out.attrs["device_id"])).collect()} == {("m", 2, True), ("n", 1, True)}
    meta = text.read_soak_metadata(spark.createDataFrame([("f", "Title\nBoard: X\nStart Time: 2026-05-12 03:06:58\n")], "file string, text string")).collect()
    assert {(r.key, r.value) for r in meta} == {("Board", "X"), ("Start Time", "2026-05-12 03:06:58")}


def test_otlp_json(spark):
    payload = '{"name":"rtos.task.stack_watermark","unit":"By","data":{"dataPoints":[{"attributes":[{"key":"device.id","value":{"stringValue":"STM32-01"}},{"key":"task.name","value":{"stringValue":"Blinky"}}],"asInt":512}]}}'
    out = text.read_otlp_json(spark.createDataFrame([(payload,), ("no json",)], "payload string")).collect()
    assert [(r.name, r.unit, r.attrs, r.value) for r in out] == [("rtos.task.stack_watermark", "By", {"device.id": "STM32-01", "task.name": "Blinky"}, 512.0)]


def test_cpu_from_idle(spark):
    rows = spark.createDataFrame([(200, 1000), (5, 0), (50, 10), (0, 10)], "idle long, period long")
    assert [r[0] for r in rows.select(reports.cpu_from_idle(F.col("idle"), F.col("period"))).collect()] == [80, 0, 100, 100]


def test_metric_families(spark):
    states = spark.createDataFrame([("demo", 7712, 7680, 12.5, 10, 1, 4)], "device_id string, heap_free_bytes long, heap_min_ever_bytes long, projection double, cpu_utilization_pct int, drop_count long, packet_count long").withColumn("arrival_ts", F.timestamp_seconds(F.lit(0)))
    tasks = spark.createDataFrame([("demo", 1, 0, "IDLE", 2, 32, 150)], "device_id string, snapshot_id long, task_idx int, task_name string, state int, stack_hwm_words int, runtime_ticks long")
    found = {(r.metric, r.attrs.get("state")): r.value for r in metrics.to_metrics(states, tasks).collect()}
    assert len({m for m, _ in found}) == 8 and len(found) == 12
    assert found["rtos_task_stack_watermark_bytes", None] == 128 and found["rtos_task_cpu_ratio", None] == 1.0 and found["rtos_telemetry_packet_loss_ratio", None] == 0.25
    assert found["rtos_task_state", "blocked"] == 1 and found["rtos_task_state", "ready"] == 0 and found["rtos_cpu_utilization_ratio", None] == 0.1


def test_lines_of_a_large_file_keep_their_order(spark, tmp_path):
    """A file of many splits, next to small ones that share their tasks."""
    for name, n in (("a", 300), ("b", 3), ("c", 200)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = text.lines_of(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a", 300), ("b", 3), ("c", 200)):
        own = sorted((r.line_no, r.line) for r in rows if r.file == name)
        assert [line for _, line in own] == [f"{name} {i}" for i in range(n)] and len({k for k, _ in own}) == n


def test_dumps_are_read_to_the_end(spark):
    """Every data point of a dump, however many there are."""
    point = "NumberDataPoints #{}\nData point attributes:\n     -> device.id: Str(d)\nTimestamp: 2026-01-01 00:00:00 +0000 UTC\nValue: {}\n"
    dump = "".join(f"Metric #{m}\nDescriptor:\n     -> Name: m{m}\n     -> Unit: By\n" + "".join(point.format(i, i) for i in range(50)) for m in range(40))
    rows = text.read_otlp_dump(spark.createDataFrame([(dump,)], "text string")).collect()
    assert sorted((r.name, r.value) for r in rows) == sorted((f"m{m}", float(i)) for m in range(40) for i in range(50))


def test_dump_heads_are_found_as_by_plain_patterns():
    """Searched by a line's first words: the same places as by a search at every line, whatever breaks lines."""
    import re

    odd = "Metric #1\nxMetric #2\nMetric #3 \n\nMetric #\nMetric #4\rMetric #5x\nNumberDataPoints #0\n NumberDataPoints #1\nValue: 1\nxValue: 2\nValue:  3\nTimestamp: 2024-01-01 00:00:00.5 +0000"
    for made, plain in ((text._METRIC, r"^Metric #\d+\s*$"), (text._POINT, r"^NumberDataPoints #\d+\s*$"), (text._VALUE, r"^Value: (\S+)"), (text._STAMP, r"^Timestamp: (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d{1,6})?)")):
        found = [m.span() for m in re.finditer(f"(?m){plain}", odd)]
        assert found and [m.span() for m in re.finditer(f"(?m){made}", odd)] == found


def test_pushed_series_are_sorted_without_a_second_copy(spark):
    """Groups are made by labels alone; the largest of values at one instant, nulls and labels in any order."""
    from beaconlake.operators import metrics

    rows = [("rtos_heap_free_bytes", {"b": "2", "a": 'x"1'}, 1.0, 5), ("rtos_heap_free_bytes", {"a": 'x"1', "b": "2"}, 3.0, 5), ("rtos_heap_free_bytes", {"a": 'x"1', "b": "2"}, 9.0, 4), ("rtos_heap_free_bytes", {"a": None}, None, 4), ("rtos_heap_free_bytes", None, 7.0, 4)]
    table = spark.createDataFrame(rows, "metric string, attrs map<string,string>, value double, s long").selectExpr("metric", "attrs", "value", "timestamp_seconds(s) as ts")
    found = metrics.otlp_export(table, 30)
    assert "first(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((repr(r.attrs), r.value) for r in found.collect() if r.value is not None) == [("None", 7.0), (repr({"a": 'x"1', "b": "2"}), 3.0)] and found.filter("value is null").first().attrs == {"a": None}
    read = {repr(r.attrs): r.value for r in text.read_otlp_json(found.filter("attrs is not null")).collect()}
    assert read == {repr({"a": 'x"1', "b": "2"}): 3.0, repr({"a": None}): None}
