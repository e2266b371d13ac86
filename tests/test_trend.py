"""Leak analytics on the documented scenarios, in batch and as a stream."""

import datetime

import pytest

from beaconlake.operators import trend
from beaconlake.params import OomParams
from beaconlake.streaming.processors import LeakTracker

# The documented scenarios.
START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
MONOTONIC = [(float(t), 131072 - t) for t in range(600)]
SAWTOOTH = [(float(t), 100000 if t % 2 == 0 else 90000 - 50 * (t // 2)) for t in range(600)]
STABLE = [(float(t), 65536) for t in range(3600)]
SHORT = [(float(t), 131072 - 1000 * t) for t in range(20)]
SAME = [(1234.0, 1000 - t) for t in range(40)]


def last(spark, samples, params=OomParams()):
    rows = [("d", i + 1, START + datetime.timedelta(seconds=t), h) for i, (t, h) in enumerate(samples)]
    frame = spark.createDataFrame(rows, "device_id string, pkt_no long, arrival_ts timestamp, heap_free_bytes long")
    return trend.oom_series(frame, params).orderBy("pkt_no").collect()[-1]


@pytest.mark.parametrize(
    "samples, params, projection",
    [(MONOTONIC, OomParams(), 130473.0), (SAWTOOTH, OomParams(rolling_min_threshold=0.04), -2.0), (SAWTOOTH, OomParams(), -1.0), (STABLE, OomParams(), -1.0), (SHORT, OomParams(), -1.0), (SAME, OomParams(), -1.0)],
)
def test_scenarios(spark, samples, params, projection):
    row = last(spark, samples, params)
    assert row.projection == pytest.approx(projection)
    import numpy as np

    window = samples[-params.window_size :]
    assert LeakTracker(params).project(np.array([t for t, _ in window]), np.array([h for _, h in window], float))[2] == pytest.approx(projection)


def test_monotonic_trend(spark):
    row = last(spark, MONOTONIC)
    assert row.slope == pytest.approx(-1.0) and row.r2 > 0.99 and row.verdict == "leak"


def test_sawtooth_minima(spark):
    row = last(spark, SAWTOOTH)
    assert (row.first_half_min, row.window_min) == (82550, 75050)


@pytest.mark.parametrize("size", [1, 2, 5, 8, 40])
def test_windows_equal_brute_force(spark, size):
    """Blocks and running sums give what the windows themselves do, for full and partial windows, ties of time and a range of packet numbers that is cut."""
    import random

    import numpy as np

    r = random.Random(size)
    t, samples = 0.0, []
    for _ in range(130):
        t += r.choice([0, 0, 1, 2.5, 1000000])
        samples.append((t, r.choice([5, 100, 4294967295, r.randint(0, 10**6)])))
    rows = [(d, i * 1000 + 1, START + datetime.timedelta(seconds=t), h, "own") for d in ("a", "b") for i, (t, h) in enumerate(samples[: 130 if d == "a" else size])]
    frame = spark.createDataFrame(rows, "device_id string, pkt_no long, arrival_ts timestamp, heap_free_bytes long, _x string")
    got = {(x.device_id, x.pkt_no): x for x in trend.windowed(frame, OomParams(window_size=size)).collect()}
    assert len(got) == len(rows) and {x._x for x in got.values()} == {"own"}
    for (device, number), x in got.items():
        i = (number - 1) // 1000
        window = samples[max(0, i - size + 1) : i + 1]
        heaps, n = [h for _, h in window], len(window)
        assert (x.sample, x.n, x.window_min, x.window_max, x.window_first_pkt) == (i, n, min(heaps), max(heaps), (i - n + 1) * 1000 + 1), device
        assert x.first_half_min == (min(heaps[: n // 2]) if n > 1 else None)
        times = np.array([t for t, _ in window]) - window[0][0]
        y = np.array(heaps, float)
        sxx, sxy, syy = ((times - times.mean()) ** 2).sum(), ((times - times.mean()) * (y - y.mean())).sum(), ((y - y.mean()) ** 2).sum()
        assert x.one_time == (sxx == 0)
        assert x.slope == pytest.approx(sxy / sxx if sxx else 0.0, rel=1e-6, abs=1e-9)
        assert x.r2 == pytest.approx(sxy**2 / (sxx * syy) if sxx and syy else 0.0, rel=1e-6, abs=1e-9)


def test_stack_growth_makes_no_group_for_every_time(spark):
    """Two times give no prediction, three do; no aggregate groups by the time of a sample."""
    from beaconlake.operators import reports

    rows = [("d", f"t{k}", float(i % k), i, 50) for k in (1, 2, 3) for i in range(12)]
    found = reports.stack_growth(spark.createDataFrame(rows, "device_id string, task_name string, x double, used int, total int"))
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.task_name: r.predicted is not None for r in found.collect()} == {"t2": False, "t3": True}
