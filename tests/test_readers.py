"""Readers over damaged lines: no line ends a job, what can't be read is among the rejects, and sections over many splits give the whole text's rows."""

import random

import pytest
from pyspark.sql import functions as F

from beaconlake.sources import text

LINES = "path string, file string, line_no long, line string"
BIG = "9" * 30


def lines(spark, *each, file="f"):
    return spark.createDataFrame([(f"/{file}", file, i, x) for i, x in enumerate(each)], LINES)


def damaged(rng, good):
    """A good line with characters lost, doubled or changed."""
    out = list(good)
    for _ in range(rng.randint(1, 4)):
        at = rng.randrange(len(out)) if out else 0
        kind = rng.random()
        if kind < 0.3 and out:
            del out[at : at + rng.randint(1, 5)]
        elif kind < 0.6:
            out[at:at] = out[at : at + rng.randint(1, 8)]
        else:
            out[at : at + 1] = rng.choice(['"', "{", "}", "\\", ",", "=", "9" * 25, "\x00", "é", "NaN", "[", "\t", ")", "e"])
    return "".join(out)


def test_exposition_repeats_and_rejects(spark):
    table = lines(spark, '# HELP x y', 'm{a="1",a="2",b="3"} 4', "m nan", "m 1 2 3", "", "m{a=1} 5", "m{} x1", 'm{a="1",} 6')
    got = [(r.attrs, r.value) for r in text.read_exposition(table).collect()]
    assert ({"a": "2", "b": "3"}, 4.0) in got and ({"a": "1"}, 6.0) in got
    assert [(r.line_no, r.reason) for r in text.exposition_rejects(table).orderBy("line_no").collect()] == [(3, "no sample"), (5, "labels"), (6, "no number")]


def test_progress_numbers_and_paths(spark):
    line = "{} [INFO] x: {} packets received | drops={} | seq_gaps=0"
    rows = [("/a/run.log", "run.log", 0, line.format("10:00:00", 1, 0)), ("/b/run.log", "run.log", 0, line.format("09:00:00", 5, 0)), ("/a/run.log", "run.log", 9, line.format("23:00:00", BIG, 1)), ("/a/run.log", "run.log", 12, line.format("11:00:00", 7, 0))]
    table = spark.createDataFrame(rows, LINES)
    # two files of one name are two runs: no clock goes back in either
    assert sorted((r.packets, r.seconds) for r in text.read_progress_log(table).collect()) == [(1, 36000), (5, 32400), (7, 39600)]
    assert [(r.path, r.line_no, r.reason) for r in text.progress_rejects(table).collect()] == [("/a/run.log", 9, "number over 64 bits")]


def test_profile_numbers(spark):
    line = "[MEASURE] x min={} max=2 mean=3 cycles samples=4"
    table = spark.createDataFrame([("f", f"{line.format(1)} {line.format(BIG)}")], "file string, text string")
    assert [(r.place, r.min_cycles) for r in text.read_profile_lines(table).collect()] == [(0, 1)]
    assert [(r.place, r.reason) for r in text.profile_rejects(table).collect()] == [(1, "number over 64 bits")]
    assert [(r.line_no, r.min_cycles) for r in text.read_profile_lines(lines(spark, "x", line.format(7))).collect()] == [(1, 7)]


def dump(rng, metrics, points):
    out = ["info", "-> Name: stray"]
    for m in range(metrics):
        out += [f"Metric #{m}", "Descriptor:", f"     -> Name: m{m}", "     -> Unit: By"]
        for i in range(rng.randint(0, points)):
            out += [f"NumberDataPoints #{i}", "Data point attributes:", f"     -> device.id: Str(d{i})", "     -> device.id: Str(last)" if rng.random() < 0.2 else f"     -> name: Str(-> Name: x{i})"]
            out += ["StartTimestamp: 1970-01-01 00:00:00 +0000 UTC", f"Timestamp: 2026-01-01 00:00:{i % 60:02d} +0000 UTC"]
            out += [rng.choice([f"Value: {i}", f"Value: {i}", "Value: many", ""])]
    return out


def points(rows):
    return sorted((r.name, r.unit, tuple(sorted(r.attrs.items())), str(r.ts), r.value) for r in rows)


def test_dump_without_values(spark):
    whole = "\n".join(dump(random.Random(1), 6, 5))
    table = spark.createDataFrame([(whole,)], "text string")
    n = whole.count("NumberDataPoints")
    got, bad = text.read_otlp_dump(table).count(), text.otlp_dump_rejects(table).count()
    assert got + bad == n and bad == n - sum(x.startswith("Value: ") and x[7:].isdigit() for x in whole.split("\n"))


@pytest.mark.parametrize("span", [1 << 22, 64])
def test_dump_over_splits_equals_whole(spark, tmp_path, monkeypatch, span):
    """A dump cut at any byte into splits, and beside others, gives the rows of the whole text."""
    monkeypatch.setattr(text, "SPAN", span)
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(dump(random.Random(name), 12, 6)) + "\n")
    want = points(text.read_otlp_dump(text.texts_of(spark, str(tmp_path))).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        cut = text.lines_of(spark, str(tmp_path))
        assert cut.rdd.getNumPartitions() > 10
        assert points(text.read_otlp_dump(cut).collect()) == want and len(want) > 30
        assert text.otlp_dump_rejects(cut).count() == text.otlp_dump_rejects(text.texts_of(spark, str(tmp_path))).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_soak_over_splits_equals_whole(spark, tmp_path):
    body = ["Started", 'early{a="x"} 1']
    for i in range(60):
        body += [f"[2026-05-12_03-{i:02d}-48]", f'm{{device_id="d{i % 3}"}} {i}', "", f"n {i}.5"]
    (tmp_path / "soak.txt").write_text("\n".join(body))
    of = lambda rows: sorted((r.metric, tuple(r.attrs.items()), str(r.ts), r.value) for r in rows)
    want = of(text.read_soak_summary(text.texts_of(spark, str(tmp_path))).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert of(text.read_soak_summary(text.lines_of(spark, str(tmp_path))).collect()) == want and len(want) == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "meta.txt").write_text("Title\nBoard: X\n")
    assert [(r.file, r.key, r.value) for r in text.read_soak_metadata(text.lines_of(spark, str(tmp_path / "meta.txt"))).collect()] == [("meta.txt", "Board", "X")]


def test_json_repeats_and_rejects(spark):
    point = '{"attributes":[{"key":"a","value":{"stringValue":"1"}},{"key":"a","value":{"stringValue":"2"}},{"key":null,"value":{"stringValue":"3"}}],%s}'
    one = '{"name":"n","unit":"u","data":{"dataPoints":[%s]}}'
    table = spark.createDataFrame([(one % (point % '"asInt":5'),), (one % (point % '"x":5'),), ("no json",), (None,), (one % (point % f'"asInt":{BIG}'),)], "payload string")
    got = text.read_otlp_json(table).collect()
    assert ({"a": "2"}, 5.0) in [(r.attrs, r.value) for r in got]
    assert sorted(r.reason for r in text.otlp_json_rejects(table).collect()) == ["no metric JSON", "no metric JSON", "no number", "no number"]


def test_damaged_lines_end_no_job(spark):
    rng = random.Random(9)
    good = ['m{device_id="a",task_name="T, \\"x\\""} 8.5e-07', "22:49:07 [INFO] b: [main] 110 packets received | drops=0 | seq_gaps=0", "[PROFILER] s min=58644 max=70770 mean=58998 cycles samples=3700",
            '{"name":"n","unit":"By","data":{"dataPoints":[{"attributes":[{"key":"k","value":{"stringValue":"v"}}],"asInt":512}]}}', "[2026-05-12_03-06-48]", *dump(rng, 1, 2)]
    bad = [damaged(rng, rng.choice(good)) for _ in range(1500)] + good
    table = lines(spark, *bad)
    whole = table.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    payloads = table.select(F.col("line").alias("payload"))
    for read in (text.read_exposition, text.exposition_rejects, text.read_progress_log, text.progress_rejects, text.read_profile_lines, text.profile_rejects, text.read_otlp_dump, text.otlp_dump_rejects, text.read_soak_summary, text.read_soak_metadata):
        read(table).collect()
    for read in (text.read_profile_lines, text.profile_rejects, text.read_otlp_dump, text.otlp_dump_rejects, text.read_soak_summary, text.read_soak_metadata):
        read(whole).collect()
    text.read_otlp_json(payloads).collect()
    samples, rejects = text.read_exposition(table).filter("value is not null").count(), text.exposition_rejects(table).count()
    plain = sum(bool(x.strip()) and not x.startswith("#") for x in bad)
    assert samples <= plain and rejects <= plain and samples + rejects >= plain
    assert text.otlp_json_rejects(payloads).count() < len(bad)
