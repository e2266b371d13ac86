"""Every registered query with SQL against DuckDB on the smallest tables, and streams against batch."""

import datetime
import glob
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beaconlake.plans import queries, views
from beaconlake.streaming import processors

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_render_exposition_order(spark):
    lines = queries.render_exposition(spark, SF).filter("device_id = 'dev-1'").orderBy("line_no").collect()
    assert lines[0].line.startswith("# HELP ") and lines[1].line.startswith("# TYPE ") and "{" in lines[2].line


def run_stream(spark, source, transform, batches):
    """The rows that a stream gives over files of ``source``, one file a micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for i, part in enumerate(batches(source)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out")


def in_two(column):
    return lambda source: [source.filter(F.col(column) <= 20), source.filter(F.col(column) > 20)]


def some_devices(frame):
    return frame.filter(F.col("device_id").isin("dev-1", "dev-2", "dev-3", "dev-4"))


def test_stream_decode_equals_batch(spark):
    chunks = some_devices(queries.chunks(spark, SF)).cache()
    got = run_stream(spark, chunks.select("device_id", "chunk_no", "bytes"), processors.stream_decode, in_two("chunk_no"))
    from beaconlake.sources import frames

    want = frames.ingest_frames(chunks).filter("status <> 'truncated'")
    columns = ["device_id", "status", "sequence_num", "timestamp_ticks"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_stream_state_equals_batch(spark):
    from beaconlake.operators import quality, state

    packets = some_devices(views.changes(spark, SF)).cache()
    got = run_stream(spark, packets, processors.stream_state, in_two("pkt_no")).filter("epoch > 0")
    counted = quality.running_counters(packets)
    want = state.rebuild_state(counted, {"heap_d": "heap_free_bytes", "cpu_d": "cpu_utilization_pct"})
    columns = ["device_id", "pkt_no", "epoch", "heap_free_bytes", "cpu_utilization_pct", "packet_count", "drop_count"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert got.count() > 0


def test_stream_oom_equals_batch(spark):
    from beaconlake.operators import trend

    samples = some_devices(views.telemetry(spark, SF)).cache()
    got = run_stream(spark, samples, lambda s: processors.stream_oom(s, queries.P40), in_two("pkt_no"))
    want = trend.oom_series(samples, queries.P40)
    columns = ["device_id", "pkt_no", "n", F.round("projection", 3).alias("projection")]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_stream_full_state_equals_batch(spark):
    from beaconlake.operators import state
    from beaconlake.sources import frames

    packets = frames.packets_of(frames.ingest_frames(some_devices(queries.chunks(spark, SF)))).select("device_id", "pkt_no", "packet_type", "payload").cache()
    got = run_stream(spark, packets, processors.stream_full_state, in_two("pkt_no")).filter("not late").cache()
    changes = frames.expand_payloads(packets).cache()
    system = ["device_id", "epoch", "pkt_no", "heap_free_bytes", "heap_min_ever_bytes", "cpu_utilization_pct"]
    want = state.full_state(changes).select(*system)
    assert want.count() > 0 and sorted(map(tuple, got.filter("task_idx = 15").select(*system).collect())) == sorted(map(tuple, want.collect()))
    task = ["device_id", "epoch", "pkt_no", "task_idx", "task_name", "state", "priority", "stack_hwm_words", "runtime_ticks"]
    want = state.task_state(changes).join(frames.task_names(packets), ["device_id", "epoch", "task_idx"]).select(*task)
    assert sorted(map(tuple, got.filter("task_idx < 15").select(*task).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("transform", [processors.stream_decode, processors.stream_full_state, processors.stream_oom])
def test_late_rows_change_nothing(spark, transform):
    """A row that comes again in a later micro-batch goes out marked, and what follows is as without it."""
    rows = [("d", i, i, 1, b"\xf7" + bytes([i]), datetime.datetime(2026, 1, 1, 0, 0, i), 1000 - i, b"") for i in range(1, 7)]
    source = spark.createDataFrame(rows, "device_id string, pkt_no long, chunk_no long, packet_type int, payload binary, arrival_ts timestamp, heap_free_bytes long, bytes binary")
    plain = run_stream(spark, source, transform, lambda s: [s.filter("pkt_no <= 3"), s.filter("pkt_no > 3")])
    again = run_stream(spark, source, transform, lambda s: [s.filter("pkt_no <= 3"), s.filter("pkt_no in (2, 3)").unionByName(s.filter("pkt_no > 3"))])
    late = "status = 'late'" if "status" in again.columns else "late"
    assert again.filter(late).count() == 2 and plain.filter(late).count() == 0
    assert sorted(map(str, again.filter(f"not ({late})").collect())) == sorted(map(str, plain.collect()))


def test_stream_offline(spark):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), 1), ("b", at(0), 1), ("a", at(20), 2), ("a", at(60), 3), ("a", at(95), 4), ("b", at(96), 4), ("a", at(97), 5)]
    source = spark.createDataFrame(rows, "device_id string, arrival_ts timestamp, part int")
    got = run_stream(spark, source, processors.stream_offline, lambda s: [s.filter(f"part = {i}") for i in range(1, 6)])
    found = sorted((r.device_id, (pd.Timestamp(r.last_seen) - pd.Timestamp(2026, 1, 1)).total_seconds(), r.offline) for r in got.collect())
    assert found == [("a", 0, False), ("a", 20, True), ("a", 60, False), ("a", 60, True), ("a", 95, False), ("b", 0, False), ("b", 0, True), ("b", 96, False)]
