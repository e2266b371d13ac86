"""Hard negatives against all scores, on tables with and without structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import hard_negatives
from beaconlake.llm.hard_negatives import MiningParams, Stripe, hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, label int, stripe string, key string, low long"
SMALL = MiningParams(block_rows=8, stripe_rows=40, min_stripes=3, chunk=4, blocks_at_once=2, hilbert_dims=6)


def plain(rows, divisor, p=MiningParams()):
    """All scores; rows are (id, vector, label)."""
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        ints = [int(np.clip(np.floor(256 * float(np.float32(x))), -(1 << 26), 1 << 26)) for x in v]
        good[(i, label, tuple(ints + [0] * (width - len(v))))] = None
    good = list(good)
    out = []
    for a in good:
        if a[0] % divisor:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in good if b is not a), key=lambda x: x[:2])
        for ps, pid, _ in [x for x in scored if x[2] == a[1]][: p.positives]:
            fits = [(s, i) for s, i, label in scored if label != a[1] and p.low * -ps <= 100 * -s <= p.high * -ps]
            out += [(a[0], pid, rank, i, -ps, -s) for rank, (s, i) in enumerate(fits[: p.negatives], 1)]
    return sorted(out)


def mined(spark, rows, divisor, p=SMALL):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "s", "k", 1) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("label"), divisor, p).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_equals_all_scores(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + rng.standard_normal(8) / (1 if seed == 1 else 20)) / 3, int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, np.full(8, 0.25), i % 3) for i in range(1000, 1100)]  # a third alike: ties by id
    assert mined(spark, rows, 10) == plain(rows, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 2), (5, [0.9, 0.5, 0.1], 1), (10, [0.9, 0.5], 1), (15, [0.5, 0.2], 2), (20, [0.4, 0.3], 2), (25, None, 2), (30, [0.5, None], 2), (35, [float("nan"), 1.0], 2),
        (40, [float("inf"), 1.0], 1), (45, [0.6, 0.4], None), (None, [0.6, 0.4], 2), (50, [], 1), (55, [-1.0, -1.0], 2), (60, [3e38, 1.0], 2), (65, [0.45, 0.25], 2), (-10, [0.9, 0.4], 1),
    ]
    assert mined(spark, rows, 5) == plain(rows, 5)


def test_few_or_no_rows(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], 10) == []  # no positive
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], 10) == [(0, 1, 1, 2, 65536, 32768)]


def test_zone_maps_rule_blocks_out():
    """Of separate clusters along the curve, a query reads few blocks and still finds the best rows."""
    rng = np.random.default_rng(3)
    centres = 400 * rng.choice([-1, 1], (32, 8))
    stripe, vectors = Stripe(8), []
    for b in range(32):
        some = (centres[b] + rng.integers(-20, 21, (64, 8))).astype("<i4")
        vectors.append(some)
        ids = np.arange(64 * b, 64 * b + 64)
        stripe.add(ids.astype("<i8").tobytes(), np.zeros(64, "<i8").tobytes(), some.tobytes(), some.min(0).astype("<i4").tobytes(), some.max(0).astype("<i4").tobytes())
    every = np.concatenate(vectors).astype(np.int64)
    own = np.arange(0, 2048, 64)
    low, high = np.full((32, 1), hard_negatives.LEAST), np.full((32, 1), hard_negatives.MOST)
    found, read = stripe.search(own, np.zeros(32, np.int64), every[own].astype(np.int32), low, high, True, 5, 1)
    assert read < 32 * 8
    scores = every[own] @ every.T
    scores[np.arange(32), own] = hard_negatives.LEAST
    for q in range(32):
        want = sorted(zip((-scores[q]).tolist(), range(2048), strict=True))[:5]
        assert sorted((-s, i) for _, _, s, i in found[found[:, 0] == q].tolist()) == want


def test_bounds_hold():
    rng = np.random.default_rng(4)
    block, queries = rng.integers(-300, 300, (20, 5)), rng.integers(-300, 300, (9, 5))
    stripe = Stripe(5)
    stripe.add(np.arange(20).astype("<i8").tobytes(), np.zeros(20, "<i8").tobytes(), block.astype("<i4").tobytes(), block.min(0).astype("<i4").tobytes(), block.max(0).astype("<i4").tobytes())
    least, most = stripe.bounds(queries)
    scores = queries @ block.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
