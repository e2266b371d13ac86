"""The object sink: one copy of each batch whatever fails or is repeated, odd names, and its streams."""

import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import metrics
from beaconlake.sources import sinks, text
from test_streams import folder, run, source, write_parts

T0 = datetime.datetime(2024, 1, 1)
METRICS = "metric string, device_id string, attrs map<string,string>, ts timestamp, value double"


def objects(spark, path):
    return {(r.object, r.line) for r in sinks.read_objects(spark, path).collect()}, sinks.read_objects(spark, path).count()


def test_names_and_repeats(spark):
    names = ["a/b", "..", "_hidden", ".dot", "x.gz", "50%", "a+b c", "ü ", "", "long" * 80, "same", "same"]
    rows = [(n, f"line of {i}\nsecond") for i, n in enumerate(names)] + [(None, "none"), ("empty", None)]
    at = folder()
    assert sinks.read_objects(spark, at).count() == 0
    sinks.write_objects(spark.createDataFrame(rows, sinks.OBJECT).coalesce(1), at)
    got = sinks.read_objects(spark, at).collect()
    assert sorted(r.line for r in got) == sorted(x for _, t in rows if t for x in t.split("\n"))
    for i, n in enumerate(names):
        if len(n) < 100:
            assert {r.object for r in got if r.line == f"line of {i}"} == {n}
    assert {r.object for r in got if r.line == "none"} == {"unnamed"}
    assert len({r.path for r in got if r.object == "same"}) == 2


def test_a_batch_counts_once(spark):
    at = folder()
    rows = spark.range(50).select(F.concat(F.lit("o"), F.col("id")).alias("object"), F.col("id").cast("string").alias("text")).repartition(5)
    sinks.write_objects(rows, at, "one")
    sinks.write_objects(rows, at, "one")
    assert objects(spark, at)[1] == 50
    sinks.write_objects(rows, at, "two")
    assert objects(spark, at)[1] == 100
    sinks.write_objects(rows.filter("false"), at, "three")
    assert objects(spark, at)[1] == 100
    with pytest.raises(Exception, match="not replaced"):
        rows.write.format("objects").mode("overwrite").option("path", at).save()


def test_a_failed_batch_leaves_nothing(spark):
    at = folder()
    rows = spark.range(80).repartition(4).select(F.col("id").cast("string").alias("object"), F.when(F.col("id") == 77, F.raise_error("lost")).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_objects(rows, at, "b")
    assert objects(spark, at)[1] == 0
    sinks.write_objects(rows.filter("id <> 77"), at, "b")
    assert objects(spark, at)[1] == 79
    time.sleep(0.1)
    before = len(glob.glob(f"{at}/data/*"))
    removed = sinks.remove_leftovers(spark, at, 0)
    assert objects(spark, at)[1] == 79 and before - removed == len(sinks._committed(spark, at))


def series(n):
    return [(m, d, {"device_id": d}, T0 + datetime.timedelta(seconds=i), float(i * 10 + k)) for i in range(n) for d in ("a", "b") for k, m in enumerate(("rtos_heap_free_bytes", "rtos_cpu_utilization_ratio"))]


@pytest.mark.parametrize("kind", ["scrape", "push"])
def test_stream_with_a_repeated_micro_batch(spark, kind):
    """A micro-batch whose end Spark did not note is run again, and every object is there once, with the batch result's text."""
    at, make = folder(), {"scrape": metrics.scrape_objects, "push": metrics.push_objects}[kind]
    rows = series(60)
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    write_parts(spark, METRICS, [*parts, [("rtos_heap_free_bytes", "z", {"device_id": "z"}, T0 + datetime.timedelta(hours=1), 0.0)]], f"{at}/in")

    def stream():
        live = source(spark, METRICS, f"{at}/in").withWatermark("ts", "10 seconds")
        return sinks.stream_objects(make(live, 15), f"{at}/out", f"{at}/c")

    run(stream())
    once, n = objects(spark, f"{at}/out")
    wanted = make(spark.createDataFrame(rows, METRICS), 15).select("object", F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    assert once == {(r.object, r.line) for r in wanted.collect()} and n == wanted.count()
    for c in sorted(glob.glob(f"{at}/c/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))[-1:]:
        os.remove(c)
        for crc in glob.glob(f"{os.path.dirname(c)}/.{os.path.basename(c)}.crc"):
            os.remove(crc)
    run(stream())
    assert objects(spark, f"{at}/out") == (once, n)
    lines = sinks.read_objects(spark, f"{at}/out")
    if kind == "push":
        assert text.read_otlp_json(lines, "line").count() == n
    else:
        read = text.read_exposition(lines.withColumnRenamed("object", "file"))
        assert read.count() == 4 * 2 * 2 and read.filter("ts is null").count() == 0


def test_few_parts_of_many_objects(spark, tmp_path):
    """Writing is spread over tasks whatever the table's parts; lines end in any of three ways; a committed batch isn't computed again."""
    from pyspark.errors import PySparkException

    path, parts = f"file://{tmp_path}/objects", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(400).coalesce(1).select(F.concat(F.lit("a/ü "), F.col("id").cast("string")).alias("object"), F.lit("one\ntwo\r\n\rthree\n").alias("text"))
    sinks.write_objects(rows, path, "b")
    assert len(sinks._committed(spark, path)) == parts
    got = sinks.read_objects(spark, path).filter("object = 'a/ü 7'").orderBy("line_no").collect()
    assert [r.line for r in got] == ["one", "two", "", "three"]
    failing = rows.withColumn("text", F.raise_error(F.lit("computed again")).cast("string"))
    sinks.write_objects(failing, path, "b")
    with pytest.raises(PySparkException):
        sinks.write_objects(failing, path, "c")
