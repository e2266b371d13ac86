"""The prefix trie against a plain count of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, seq string, k1 long, depth int"


def plain(conversations):
    """Nodes of rebuilt conversations {id: [(role, text), ...]} by a dictionary of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(of), len(n), min(members[n[:-1]]) if n else None, len(of), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, of in members.items()
    )


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, source = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        out[c] = own.get(source, [])[:h] + turns[h:]
    return out


def made(spark, rows, slice_rows=prefix_trie.SLICE):
    turns = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)
    own = prefix_trie.sequences(turns)
    members = prefix_trie.rebuilt(own, lambda c: F.crc32(c.cast("string")) % 6, lambda c: c - c % 100, 5)
    got = prefix_trie.trie(members, slice_rows).collect()
    assert got == [] or got[0].__fields__ == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in got)


def some_rows(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "é\U0001f600", "", None]
    rows = []
    for c in [0, 1, 2, 3, 100, 101, 102, 150, 199, 200, 250, 299, 305, 399, -7, *range(1000, 1060)]:
        for turn in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, turn, "user" if turn % 2 == 0 else rng.choice(["assistant", "tool", None]), rng.choice(words[: rng.choice([1, 3, 6])])))
    rows += [(400, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in range(500, 520) for t in range(30)] + [(520, 29, "user", "x")]
    return rows


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, prefix_trie.SLICE), (2, 4), (3, 1)])
def test_trie_equals_plain(spark, seed, slice_rows):
    rows = some_rows(seed)
    assert made(spark, rows, slice_rows) == plain(rebuilt(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (1, 0, "a", "tied"), (None, 0, "user", "nobody"), (2, 5, "user", "x" * 70_000), (7, 0, "user", "")]
    assert made(spark, rows) == plain(rebuilt(rows))


def test_turnless_and_empty(spark):
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    digest = hashlib.sha256(str(c).encode()).hexdigest()
    assert made(spark, rows) == [(c, 0, None, 1, 0, 1, 0, digest)]
    assert made(spark, []) == []


def test_many_copies(spark):
    """A third of all conversations are alike: one node, all ids in its digest, and runs of ids across partitions."""
    rows = [(c, t, "user", f"t{t}") for c in range(10_001, 10_301) for t in range(7)] + [(c, t, "user", f"{c}-{t}") for c in range(20_001, 20_601) for t in range(6)]
    assert made(spark, rows, 16) == plain(rebuilt(rows))


def test_sparse_table():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 37)
    table = prefix_trie.LeastOf(values)
    first = rng.integers(0, 37, 200)
    last = np.minimum(36, first + rng.integers(0, 37, 200))
    assert table.between(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]
    depth = rng.integers(0, 6, 200)
    right, left = table.reach_right(first, depth), table.reach_left(first, depth)
    for at, d, r, low in zip(first, depth, right, left, strict=True):
        assert all(values[at + 1 : r + 1] >= d) and (r == 36 or values[r + 1] < d)
        assert all(values[low + 1 : at + 1] >= d) and (low == 0 or values[low] < d)
