"""Prefix trie of conversations from sorted turn sequences.

A turn is a 128-bit digest of role and text and the text's length; texts are not shuffled. Distinct sequences are sorted, the longest common prefix (LCP) of
neighbours is found, and a sparse table over the LCPs gives the minimum of any range. Each candidate prefix, a first ``d`` turns that the row
before doesn't begin with, searches by halving steps in that table how far the rows to its left and to its right still share ``d`` turns. These
two extents are its member interval: its members are a difference of running sums, its smallest member a range minimum, and its subtree the candidates of the
interval's rows, which stand next to each other. No stack is kept, and candidates don't wait for each other.

Spark sorts by range, and every task works through its range in slices, so its memory is bounded. A node whose interval touches neither end of its slice is final there. The others, at most
two paths a slice, are ``open``: their parts are added up by node, and sums over subtrees are passed up among them by doubling steps (1, 2, 4, ... levels
at once), so deep tries take few rounds.

Bounds: one row holds a conversation's turns (24 bytes each), the range keys hold 16 turns. Sequences that share more turns than that are sorted in one task, which spills and
works in slices. The digest of a node's ids is made from sorted runs of ids, one after the other: of a hot node a task reads few rows and keeps none.

Defined results: rows with a null conv_id take no part; a null role or text is empty; turns of one number are ordered by role, then by the text's first 32 characters,
then by digest; repeated rows are turns of their own. A table without conversations has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.session import ship_package

from .chunks import sliced
from .scratch import dropped, temporary, written
from .shingles import mixed

#: So many sequences are worked on at once, and so many ids stand in one run at most.
SLICE = 8192
#: Turns and bytes of each in a range key.
HEAD, PART = 16, 8
NONE = hashlib.sha256(b"").digest()

TURN = "array<struct<key:binary,chars:bigint>>"
NODES = "k1 long, k2 long, p1 long, p2 long, depth long, chars long, n long, first long, parent_first long, children long, leaves long, saved long, ends binary, open boolean"


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq``: the turns of every conversation in order, as digests and lengths."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    place = F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"), r.alias("role"), F.substring(t, 1, 32).alias("begin"), digest.alias("key"), F.length(t).cast("long").alias("chars"))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), place.alias("p"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: F.struct(x["key"], x["chars"])).alias("seq"))


def rebuilt(own: DataFrame, shared: Callable[[Column], Column], source: Callable[[Column], Column], most: int) -> DataFrame:
    """``conv_id, seq``: the first ``h`` turns of conversation ``source(conv_id)``, then the conversation's own after its first ``h``; ``h`` = ``shared(conv_id)``, at most ``most``."""
    c = F.col("conv_id")
    begin = own.filter(c == source(c)).select(c.alias("_source"), F.slice("seq", 1, most).alias("_begin"))
    joined = own.withColumns({"_source": source(c), "_h": shared(c).cast("int")}).join(begin, "_source", "left")
    rest = F.slice("seq", F.col("_h") + 1, F.greatest(F.size("seq"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("_begin", F.array().cast(TURN)), F.lit(1), F.col("_h")), rest).alias("seq"))


def _digests(members: DataFrame, slice_rows: int) -> DataFrame:
    """``path, ends``: SHA-256 of the members' ids of each path, in ascending order and separated by commas.

    Ids are sorted by range and joined in runs; the runs of a path then go one after the other through one hash.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=slice_rows):
            path, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
            out = [(path[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], ["path", "first", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in sliced(batches, rows=256):
            done = []
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, state.digest()))
                now, state = path, hashlib.sha256(ids.encode())
            if done:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*done, strict=True)], ["path", "ends"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.digest()], pa.binary())], ["path", "ends"])

    ranged = members.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    dealt = ranged.mapInArrow(runs, "path binary, first long, ids string").repartition("path").sortWithinPartitions("path", "first")
    return dealt.mapInArrow(joined, "path binary, ends binary")


class LeastOf:
    """A sparse table: level k holds the minima of the ranges of 2**k places."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of first..last (both inside)."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def reach_right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind ``at`` are ``depth`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + (1 << k) < len(self.levels[0])
            fits[fits] = level[at[fits] + 1] >= depth[fits]
            at[fits] += 1 << k
        return at

    def reach_left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place down to which all values behind it, up to ``at`` are ``depth`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at - (1 << k) >= 0
            fits[fits] = level[at[fits] - (1 << k) + 1] >= depth[fits]
            at[fits] -= 1 << k
        return at


def common_prefixes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row how many first keys it shares with the row before; 0 for the first. ``keys`` are those of all rows (keys, 2)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(len(sizes), np.int64)
    active = np.arange(1, len(sizes))
    depth = 0
    while len(active):
        active = active[(sizes[active] > depth) & (sizes[active - 1] > depth)]
        active = active[(keys[starts[active] + depth] == keys[starts[active - 1] + depth]).all(1)]
        depth += 1
        out[active] = depth
    return out


def _path_hashes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of every non-empty prefix of every row (keys, 2): sums of mixed keys, each times a power for its place."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    out = np.empty((len(keys), 2), np.uint64)
    for lane, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, base, np.uint64))
        terms = mixed(keys[:, lane] + mixed(keys[:, 1 - lane] ^ np.uint64(lane + 1))) * powers[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out[:, lane] = mixed(total[1:] - np.repeat(total[starts], sizes) + np.uint64(1) * (place + 1).astype(np.uint64))
    return out


def nodes_of(keys: np.ndarray, chars: np.ndarray, sizes: np.ndarray, times: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """The trie of one slice of sorted distinct rows, a node an entry, in the order of (first row, depth); ``row`` is the row that a node is the whole of, else -1.

    ``parent_first``, ``children``, ``leaves`` and ``saved`` count final nodes only; an open parent's first member isn't known here.
    """
    rows = len(sizes)
    lcp = common_prefixes(keys, sizes)
    table, ids = LeastOf(lcp), LeastOf(least)
    begin = np.where(np.arange(rows) == 0, 0, lcp + 1)  # the slice's first row also brings the root
    many = np.maximum(sizes - begin + 1, 0)
    row = np.repeat(np.arange(rows), many)
    flat = np.cumsum(many) - many
    depth = np.arange(len(row)) - np.repeat(flat, many) + np.repeat(begin, many)

    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    sums = np.concatenate([[0], np.cumsum(times)])
    n = sums[right + 1] - sums[left]
    first = ids.between(left, right)
    starts = np.cumsum(sizes) - sizes
    hashes = _path_hashes(keys, sizes)

    def named(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros((len(row), 2), np.uint64)
        return np.where((depth > 0)[:, None], hashes[np.where(depth > 0, starts[row] + depth - 1, 0)], np.uint64(0))

    above = depth - 1
    origin = table.reach_left(row, np.maximum(above, 0))  # the row that brings the parent
    parent = np.where(depth > 0, flat[origin] + above - begin[origin], -1)
    last_chars = np.where(depth > 0, chars[np.where(depth > 0, starts[row] + depth - 1, 0)], 0) if len(chars) else np.zeros(len(row), np.int64)
    opened = (left == 0) | (right == rows - 1)
    final = ~opened
    inner = depth > 0
    children = np.bincount(parent[inner & final], minlength=len(row)).astype(np.int64)
    every = np.bincount(parent[inner], minlength=len(row))
    leaf = (final & (every == 0)).astype(np.int64)
    weight = np.where(final, (n - 1) * last_chars, 0)
    stop = flat[right] + many[right]  # the subtree ends with the last candidate of the interval's last row that brings one
    here = np.arange(len(row))
    leaf_sums, weight_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (leaf, weight))
    own, up = named(row, depth), named(row, np.maximum(above, 0))
    whole = np.where(depth == sizes[row], row, -1)
    parent_first = np.where(inner & final & ~opened[parent], first[parent], np.iinfo(np.int64).min)
    return {
        "k": own, "p": up, "depth": depth, "chars": last_chars, "n": n, "first": first, "parent_first": parent_first, "children": children,
        "leaves": leaf_sums[stop] - leaf_sums[here], "saved": weight_sums[stop] - weight_sums[here], "row": whole, "open": opened,
    }


def _local_nodes(paths: DataFrame, slice_rows: int) -> DataFrame:
    """Columns of NODES for each slice of the sorted ``paths``; ``p1`` and ``p2`` are null for the root, ``parent_first`` where the parent is open."""
    head = F.concat(*[F.coalesce(F.substring(F.get("seq", i)["key"], 1, PART), F.lit(b"")) for i in range(HEAD)])
    keys = F.array_join(F.transform("seq", lambda x: F.hex(x["key"])), "")
    ordered = paths.withColumn("head", head).repartitionByRange("head").sortWithinPartitions("head", keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=slice_rows):
            seq = batch.column(0)
            sizes = np.asarray(seq.value_lengths(), np.int64)
            turns = seq.flatten()
            raw = b"".join(turns.field("key").to_pylist())
            made = nodes_of(np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2), np.asarray(turns.field("chars"), np.int64), sizes, *(np.asarray(batch.column(i), np.int64) for i in (1, 2)))
            root = made["depth"] == 0
            k, p = made["k"].view(np.int64), made["p"].view(np.int64)
            unknown = made["parent_first"] == np.iinfo(np.int64).min
            ends = batch.column(3).take(pa.array(made["row"], mask=made["row"] < 0))
            plain = [pa.array(made[c].astype(np.int64)) for c in ("depth", "chars", "n", "first")]
            sums = [pa.array(made[c].astype(np.int64)) for c in ("children", "leaves", "saved")]
            names = [c.split()[0] for c in NODES.split(", ")]
            yield pa.record_batch(
                [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(p[:, 0].copy(), mask=root), pa.array(p[:, 1].copy(), mask=root), *plain, pa.array(made["parent_first"], mask=unknown), *sums, ends, pa.array(made["open"])], names
            )

    return ordered.select("seq", "n", "first", "ends").mapInArrow(run, NODES)


def _summed_up(opened: DataFrame, paths: list[str]) -> DataFrame:
    """The open nodes with ``leaves`` and ``saved`` of their whole subtrees: what they have of final nodes below them, and what open nodes add for themselves."""
    spark = opened.sparkSession
    up = F.when(F.col("p1").isNotNull(), F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")))
    key = F.struct("k1", "k2", "depth")
    below = opened.filter("p1 is not null").groupBy(up.alias("key")).agg(F.count("*").alias("more"))
    counted = opened.withColumn("key", key).join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = written(counted, "open", paths)
    held: list[str] = []
    now = written(nodes.select("key", up.alias("up"), (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")), "sums", held)
    while now.filter("up is not null").limit(1).count():
        sent = now.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        fresh: list[str] = []
        more = now.join(sent, "key", "left").select("key", "up", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))])
        new = written(more.join(further, "up", "left").select("key", F.col("next").alias("up"), "leaves", "saved"), "sums", fresh)
        dropped(spark, held)
        now, held = new, fresh
    paths += held
    added = now.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    return nodes.join(added, "key").withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})


#: Up to so many open nodes are broadcast.
BROADCAST_ROWS = 200_000


def trie(members: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of ``members`` (conv_id, seq).

    ``conv_id`` is the node's smallest member. ``slice_rows`` sequences are worked on at once.
    """
    spark = members.sparkSession
    ship_package(spark)
    with temporary(spark) as own:
        path = F.unhex(F.md5(F.concat_ws("", F.transform("seq", lambda x: F.hex(x["key"])))))
        named = written(members.select("conv_id", "seq", path.alias("path")), "members", own)
        grouped = named.groupBy("path").agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
        paths = written(grouped.join(_digests(named, slice_rows), "path").select("seq", "n", "first", "ends"), "paths", own)
        nodes = written(_local_nodes(paths, slice_rows), "nodes", own)
        total = [F.sum(c).cast("long").alias(c) for c in ("n", "children", "leaves", "saved")]
        opened = nodes.filter("open").groupBy("k1", "k2", "depth").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "chars", "ends")], F.min("first").alias("first"), *total)
        whole = written(_summed_up(opened, own), "summed", own)
        of = whole.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("above"))
        if of.count() <= BROADCAST_ROWS:
            of = F.broadcast(of)
        columns = ["first", "depth", "p1", "p2", "parent_first", "n", "children", "leaves", "saved", "ends"]
        both = nodes.filter(~F.col("open")).select(*columns).unionByName(whole.withColumn("parent_first", F.lit(None).cast("long")).select(*columns))
        out = both.join(of, ["p1", "p2", "depth"], "left").select(
            F.col("first").alias("conv_id"), "depth", F.coalesce("parent_first", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lower(F.hex(F.coalesce("ends", F.lit(NONE)))).alias("ends_sha256"),
        )
        return written(out, "trie")
