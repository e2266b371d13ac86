"""The two-level scan against a plain loop, over range borders, null keys and resets, and without a hot task."""

import random

import pytest
from pyspark.sql import functions as F

from beaconlake.functions.scan import Scan, by_packet, ranges
from beaconlake.operators import quality, state

SCHEMA = "device_id string, pkt_no long, x long, name string, reset boolean"


def made(seed, size=400):
    r = random.Random(seed)
    out = []
    for d in ("a", "b", None, "c"):
        at = 0
        for _ in range({"a": size, "b": 37, None: 20, "c": 1}[d]):
            at += r.choice([1, 1, 1, 2, 30])
            out.append((d, at, r.choice([None, r.randint(-5, 50)]), r.choice([None, "p", "q"]), r.choice([None, False, False, False, r.random() < 0.2])))
    r.shuffle(out)
    return out


def plain(rows):
    out = []
    for d in {row[0] for row in rows}:
        total, least, before, known, last, first, begun = None, None, None, None, None, None, False
        for row in sorted((x for x in rows if x[0] == d), key=lambda x: x[1]):
            _, at, x, name, reset = row
            if not begun:
                first, begun = x, True
            total = total if x is None else (total or 0) + x
            least = least if x is None else x if least is None else min(least, x)
            last = name if name is not None else None if reset else last
            out.append((d, at, total, least, before, known, last, first))
            before, known = x, known if x is None else x
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "width"), [(1, 7), (2, 64), (3, 1), (4, 1 << 16)])
def test_scan_equals_plain(spark, seed, width):
    rows = made(seed)
    x = F.col("x")
    scan = by_packet(width, sums={"total": x}, least={"low": x}, before={"before": x}, known={"known": x}, last={"last": F.col("name")}, first={"first": x}, reset=F.col("reset"))
    got = scan.over(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("device_id", "pkt_no", "total", "low", "before", "known", "last", "first").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_order_of_several_columns(spark):
    rows = [("d", "cap-2", 1, 5), ("d", "cap-1", 2, 7), ("d", "cap-1", 1, 3), ("e", "cap-1", 1, None)]
    scan = Scan(["device"], ["capture", "frame"], F.struct(F.col("capture"), ranges("frame", 1)), sums={"n": F.lit(1).cast("long")}, last={"seen": F.col("v")})
    got = scan.over(spark.createDataFrame(rows, "device string, capture string, frame long, v long")).collect()
    assert sorted((r.device, r.capture, r.frame, r.n, r.seen) for r in got) == [("d", "cap-1", 1, 1, 3), ("d", "cap-1", 2, 2, 7), ("d", "cap-2", 1, 3, 5), ("e", "cap-1", 1, 1, None)]


def test_scan_of_no_rows(spark):
    assert by_packet(sums={"n": F.lit(1)}).over(spark.createDataFrame([], SCHEMA)).columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "n"]
    assert by_packet(sums={"n": F.lit(1)}).over(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_device_is_many_tasks(spark):
    """Half of all packets are of one device: no task of the scan gets more than twice the rows of the median one."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("dev-"), (F.col("id") % 997).cast("string"))).alias("device_id"), F.col("id").alias("pkt_no"), (F.col("id") % 65536).cast("int").alias("sequence_num")
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = quality.seq_gaps(rows, width=1 << 9).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("count"), F.sum("missing_packets")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = sorted(r["count"] for r in counted)
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_gap_beside_an_unknown_number(spark):
    rows = [("d", 1, 10), ("d", 2, None), ("d", 3, 14), ("d", 4, 15)]
    for width in (1, 100):
        got = quality.seq_gaps(spark.createDataFrame(rows, "device_id string, pkt_no long, sequence_num int"), width).orderBy("pkt_no").collect()
        assert [(r.gap, r.missing_packets) for r in got] == [(0, 0), (0, 0), (1, 3), (0, 0)]


def test_counters_over_range_borders(spark):
    r = random.Random(5)
    rows, want = [], []
    for d in ("a", "b"):
        seq, total, drops, packets = None, 0, 0, 0
        for i in range(150):
            step = r.choice([1, 1, 1, 4])
            new, ticks = ((seq or 0) + step) % 65536, r.randint(0, 2**32 - 1)
            drops += int(seq is not None and step > 1)
            packets += 1
            rows.append((d, i * 3, new, ticks))
            want.append((d, i * 3, packets, drops))
            seq = new
    table = spark.createDataFrame(rows, "device_id string, pkt_no long, sequence_num int, raw_ticks long")
    got = quality.running_counters(table, width=20).select("device_id", "pkt_no", "packet_count", "drop_count").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    wide, narrow = (sorted(map(tuple, quality.counter_unwrap(table, width=w).select("device_id", "pkt_no", "elapsed", "unwrapped").collect())) for w in (1 << 16, 11))
    assert wide == narrow and wide[0][2:] == (0, rows[0][3])


def test_stale_marks_equal_plain(spark):
    r = random.Random(6)
    rows, want = [], []
    seq, last, epoch, state_of = 0, {}, 0, {}
    gap_at = None
    for i in range(300):
        lost = r.random() < 0.08
        seq += 1 + 2 * lost
        key = i > 4 and r.random() < 0.05
        heap, cpu = (i, i) if key else (r.choice([None, None, i]), r.choice([None, i]))
        rows.append(("d", i, seq, key, heap, cpu))
        if key:
            epoch, last, state_of, gap_at = epoch + 1, {}, {}, None
        if lost and i:
            gap_at = i
        for name, value in (("heap", heap), ("cpu", cpu)):
            if value is not None:
                last[name], state_of[name] = i, value
        if epoch:
            stale = tuple(gap_at is not None and gap_at > last.get(name, -1) for name in ("heap", "cpu"))
            want.append((i, state_of.get("heap"), state_of.get("cpu"), *stale, any(stale)))
    table = spark.createDataFrame(rows, "device_id string, pkt_no long, sequence_num int, is_valid_keyframe boolean, heap_d long, cpu_d long")
    for width in (9, 1 << 16):
        got = state.stale_since_gap(table, {"heap_d": "heap", "cpu_d": "cpu"}, width).orderBy("pkt_no").select("pkt_no", "heap", "cpu", "heap_stale", "cpu_stale", "stale_since_gap").collect()
        assert [tuple(x) for x in got] == want


def test_runs_over_range_borders(spark):
    rows = [("d", i, s) for i, s in enumerate([1, 1, 2, 2, 2, None, None, 1, 1, 1, 1])]
    table = spark.createDataFrame(rows, "device_id string, pkt_no long, state int")
    for width in (2, 1 << 16):
        got = state.state_transitions(table, width=width).orderBy("run").collect()
        assert [(x.run, x.state, x.first_pkt, x.last_pkt, x.packets) for x in got] == [(1, 1, 0, 1, 2), (2, 2, 2, 4, 3), (3, None, 5, 6, 2), (4, 1, 7, 10, 4)]


def test_runs_read_their_rows_twice(spark):
    """Once for the runs and once for those that go over a range's end: null keys, states and places among them, in narrow and wide ranges."""
    rows = [(d, t, n, n // 5 % 3 if n % 7 else None) for d in ("a", None) for t in (0, None) for n in range(0, 60, 1 if d else 3)]
    table = spark.createDataFrame(rows, "device_id string, task_idx int, pkt_no long, state int")
    want = []
    for d, t in {(d, t) for d, t, _, _ in rows}:
        run, before = 0, ()
        for n, s in sorted((n, s) for e, u, n, s in rows if (e, u) == (d, t)):
            if before != (s,):
                run, before = run + 1, (s,)
                want.append([d, t, run, s, n, n, 0])
            want[-1][5:] = [n, want[-1][6] + 1]
    for width in (1, 4, 64):
        found = state.state_transitions(table, "task_idx", width=width)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
        assert sorted(map(repr, map(list, found.select("device_id", "task_idx", "run", "state", "first_pkt", "last_pkt", "packets").collect()))) == sorted(map(repr, want))
