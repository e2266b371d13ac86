"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are sorted along a Hilbert curve through the dimensions of the largest variance and written as Parquet rows of ``block_rows`` vectors each, with a zone
map: the least and largest value of every dimension and of the label. Blocks are held in stripes, contiguous ranges of the curve. Interval
arithmetic on a zone map bounds the inner products of a query with all rows of its block from both sides; a block is read only where these bounds meet one of the
query's windows of scores and can still beat what the query has found there.

A search (``_searched``) runs twice: over the stripe that a query itself lies in, whose results give every window a first threshold, and then over
all other stripes. Each stripe sends its best rows of a window and no more, and a window over (query, window) merges them.
``mine`` does this for the positives (same label, one window without limits) and then for the negatives of each positive (another label, scores in
a range that follows from the positive's score).

Bounds: a task holds one stripe of about ``stripe_rows`` vectors and ``chunk`` queries. Queries are a stated share of the rows, and they meet all blocks in these
pieces, so in the worst case (vectors without any structure, where no zone map rules a block out) the work is that of all scores of all queries.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part. Rows alike in id, label and vector count once; other rows of
one id are rows of their own. A missing component of a shorter vector is 0, and an empty vector scores 0 with everything. Whole parts of scaled components beyond
2**26 count as 2**26 (so that sums stay within 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.session import ship_package

from .chunks import sliced
from .scratch import temporary, written

LIMIT = 1 << 26
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class MiningParams:
    """A negative's score is between ``low`` and ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block_rows: int = 256
    stripe_rows: int = 1 << 16
    min_stripes: int = 16
    hilbert_dims: int = 32
    chunk: int = 256
    blocks_at_once: int = 8


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled whole parts of all components, the lengths of the vectors, and which of these are without a null or non-finite component."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    finite = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    ends = np.cumsum(lengths)
    good = bad[ends] == bad[ends - lengths]
    return np.clip(np.floor(np.where(finite, values, 0) * scale), -LIMIT, LIMIT).astype(np.int32), lengths, good


def moments(embeddings: DataFrame, p: MiningParams, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and standard deviation of every dimension, and the number of rows; a row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0))
        rows = 0
        for batch in sliced(batches):
            values, lengths, good = _integers(batch.column(0), p.scale)
            if lengths.max(initial=0) > held.shape[1]:
                held = np.pad(held, ((0, 0), (0, int(lengths.max()) - held.shape[1])))
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            some = np.repeat(good, lengths)
            x = values[some].astype(np.float64)
            held[0] += np.bincount(place[some], x, held.shape[1])
            held[1] += np.bincount(place[some], x * x, held.shape[1])
            rows += int(good.sum())
        dims = [-1, *range(held.shape[1])]
        yield pa.record_batch([pa.array(dims, pa.int32()), pa.array([rows, *held[0]], pa.float64()), pa.array([0, *held[1]], pa.float64())], ["dim", "s", "ss"])

    some = embeddings.select(F.col(embedding).alias("e")).filter("e is not null")
    found = some.mapInArrow(run, "dim int, s double, ss double").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("dim").toPandas()
    rows = int(found["s"][0]) if len(found) else 0
    mean = found["s"].to_numpy()[1:] / max(rows, 1)
    return mean, np.sqrt(np.maximum(found["ss"].to_numpy()[1:] / max(rows, 1) - mean * mean, 0)), rows


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve of points with coordinates of ``bits`` bits (points, dims), as byte strings in the curve's order."""
    x = cells.T.astype(np.uint32).copy()
    dims = len(x)
    if not dims:
        return [b""] * len(cells)
    for k in range(bits - 1, 0, -1):  # from the coarsest cube to the finest: turn each so that the curve enters and leaves at its neighbours
        low = np.uint32((1 << k) - 1)
        for i in range(dims):
            upper = (x[i] >> np.uint32(k) & np.uint32(1)).astype(bool)
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    np.bitwise_xor.accumulate(x, 0, out=x)  # Gray code across the dimensions
    turn = np.zeros(x.shape[1], np.uint32)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(k) & np.uint32(1), np.uint32((1 << k) - 1), np.uint32(0))
    x ^= turn
    planes = [x >> np.uint32(k) & np.uint32(1) for k in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8), axis=0)
    return [row.tobytes() for row in np.ascontiguousarray(packed.T)]


def _padded(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix of ``width`` columns."""
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int32)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def keyed(embeddings: DataFrame, label: Column, p: MiningParams, mean: np.ndarray, spread: np.ndarray, vec_id: str, embedding: str) -> DataFrame:
    """``id, label, vector, key``: the rows that take part, once each, with the vector's integers and the place on the curve."""
    width = len(mean)
    chosen = np.sort(np.argsort(-spread, kind="stable")[: p.hilbert_dims])
    cuts = mean[chosen] + np.array([-0.6745, 0, 0.6745])[:, None] * spread[chosen]  # the quarters of a normal distribution

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values, lengths, good = _integers(batch.column(2), p.scale)
            matrix = _padded(values, lengths, width)[good]
            cells = (matrix[:, chosen, None] > cuts.T).sum(2)
            some = batch.filter(pa.array(good))
            vectors = [row.tobytes() for row in matrix.astype("<i4")]
            yield pa.record_batch([some.column(0), some.column(1), pa.array(vectors, pa.binary()), pa.array(hilbert_keys(cells, 2), pa.binary())], ["id", "label", "vector", "key"])

    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(embedding).alias("e"))
    made = rows.filter("id is not null and label is not null and e is not null").mapInArrow(run, "id long, label long, vector binary, key binary")
    return made.dropDuplicates(["id", "label", "vector"])


BLOCKS = "stripe int, place int, n int, ids binary, labels binary, vectors binary, low binary, high binary"


def blocks_of(rows: DataFrame, stripes: int, width: int, p: MiningParams) -> DataFrame:
    """Columns of BLOCKS: the rows in the curve's order, ``block_rows`` at a time; a stripe is a range of the curve."""

    def packed(stripe: int, place: int, table: pa.Table) -> list:
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i4").reshape(len(table), width)
        ids, labels = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
        ends = [f(axis=0).astype("<i4").tobytes() if width else b"" for f in (vectors.min, vectors.max)]
        return [stripe, place, len(table), ids, labels, vectors.tobytes(), *ends]

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, place, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in sliced(batches, rows=p.block_rows):
            while len(batch):
                taken = batch.slice(0, p.block_rows - rows)
                held.append(taken)
                rows, batch = rows + len(taken), batch.slice(len(taken))
                if rows == p.block_rows:
                    yield _one(packed(stripe, place, pa.Table.from_batches(held)))
                    place, held, rows = place + 1, [], 0
        if held:
            yield _one(packed(stripe, place, pa.Table.from_batches(held)))

    def _one(row: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

    return rows.repartitionByRange(stripes, "key", "id").sortWithinPartitions("key", "id", "label", "vector").select("id", "label", "vector").mapInArrow(run, BLOCKS)


def queries_of(blocks: DataFrame, divisor: int, width: int) -> DataFrame:
    """``query, stripe, id, label, vector`` of the rows whose id is divisible by ``divisor``; ``query`` numbers them by their place in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, place, ids, labels, vectors in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                some = np.flatnonzero(ids % divisor == 0)
                rows = np.frombuffer(vectors, "<i4").reshape(len(ids), width)[some]
                names = (stripe << 48) + (place << 16) + some
                yield pa.record_batch([pa.array(names), pa.array(np.full(len(some), stripe, np.int32)), pa.array(ids[some]), pa.array(labels[some]), pa.array([r.tobytes() for r in rows], pa.binary())], ["query", "stripe", "id", "label", "vector"])

    return blocks.select("stripe", "place", "ids", "labels", "vectors").mapInArrow(run, "query long, stripe int, id long, label long, vector binary")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Stripe:
    """The blocks of a stripe with their zone maps."""

    def __init__(self, width: int):
        self.width, self.blocks, self.low, self.high, self.labels = width, [], [], [], []
        self.ready = False

    def add(self, ids: bytes, labels: bytes, vectors: bytes, low: bytes, high: bytes) -> None:
        labels = np.frombuffer(labels, "<i8")
        self.blocks.append((np.frombuffer(ids, "<i8"), labels, vectors))
        self.low.append(np.frombuffer(low, "<i4"))
        self.high.append(np.frombuffer(high, "<i4"))
        self.labels.append((labels.min(), labels.max()))

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each vector with anything in each block's box."""
        if not self.ready:
            self.low, self.high = (np.array(x, np.int64).reshape(len(self.blocks), self.width) for x in (self.low, self.high))
            self.labels, self.ready = np.array(self.labels, np.int64).reshape(-1, 2), True
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return _products(up, self.low) + _products(down, self.high), _products(up, self.high) + _products(down, self.low)

    def search(self, own: np.ndarray, label: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, best: int, at_once: int) -> tuple[np.ndarray, int]:
        """Rows (query, window, score, id) of the ``best`` in each window (queries, windows) by score and then id, and how many (query, block) pairs were read.

        ``low`` is raised to the last of the best as they are found. A query never meets the row at its own place (``own``, -1 where that isn't in the stripe).
        """
        queries, windows = low.shape
        low, found = low.copy(), np.zeros((0, 4), np.int64)
        least, most = self.bounds(vectors)
        one = (self.labels[:, 0] == label[:, None]) & (self.labels[:, 1] == label[:, None])
        fits = (self.labels[:, 0] <= label[:, None]) & (self.labels[:, 1] >= label[:, None]) if same else ~one
        order = np.argsort(-np.where(fits, most, LEAST).max(0, initial=LEAST), kind="stable")
        starts = np.cumsum([0, *(len(b[0]) for b in self.blocks)])
        read, at = 0, 0

        def wanted(b: int) -> np.ndarray:
            return fits[:, b] & ((most[:, b, None] >= low) & (least[:, b, None] <= high)).any(1)

        while at < len(order):
            some, need = [], np.zeros(queries, bool)
            while at < len(order) and len(some) < at_once:
                b, at = int(order[at]), at + 1
                if (asks := wanted(b)).any():
                    some.append(b)
                    need |= asks
                    read += int(asks.sum())
            if not some:
                continue
            asked = np.flatnonzero(need)
            ids, labels = (np.concatenate([self.blocks[b][i] for b in some]) for i in (0, 1))
            rows = np.concatenate([np.frombuffer(self.blocks[b][2], "<i4").reshape(-1, self.width) if self.width else np.zeros((len(self.blocks[b][0]), 0), np.int32) for b in some])
            places = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in some])
            score = _products(vectors[asked], rows)
            may = ((labels == label[asked, None]) == same) & (places != own[asked, None])
            for w in range(windows):
                valid = may & (score >= low[asked, w, None]) & (score <= high[asked, w, None])
                many = np.flatnonzero(valid.sum(1) > best)
                if len(many):  # below the last of the best of these rows nothing counts; ties with it stay
                    kept = np.where(valid[many], score[many], LEAST)
                    valid[many] &= score[many] >= np.partition(kept, kept.shape[1] - best, 1)[:, kept.shape[1] - best, None]
                i, j = np.nonzero(valid)
                if not len(i):
                    continue
                new = np.stack([asked[i], np.full(len(i), w), score[i, j], ids[j]], 1)
                mine = found[:, 1] == w
                found, merged = found[~mine], np.concatenate([found[mine], new])
                merged = merged[np.lexsort((merged[:, 3], -merged[:, 2], merged[:, 0]))]
                first = np.searchsorted(merged[:, 0], merged[:, 0])
                merged = merged[np.arange(len(merged)) - first < best]
                full, times = np.unique(merged[:, 0], return_counts=True)
                last = np.searchsorted(merged[:, 0], full, "right") - 1
                full, last = full[times == best], last[times == best]
                low[full, w] = np.maximum(low[full, w], merged[last, 2])
                found = np.concatenate([found, merged])
        return found, read


HITS = "query long, window int, score long, id long"


def _searched(blocks: DataFrame, queries: DataFrame, stripes: int, width: int, same: bool, best: int, home: bool, p: MiningParams) -> DataFrame:
    """Columns of HITS: for each query and window the best rows of each stripe, of the query's own or (not ``home``) of all others.

    ``queries`` has ``query, stripe, id, label, vector`` and the windows' ends ``low`` and ``high`` (inclusive). A stripe and the queries that meet it come to one task.
    """
    nothing, no_list = F.lit(None).cast("binary"), F.lit(None).cast("array<long>")
    asked = queries.withColumn("to", F.explode(F.array("stripe") if home else F.array_remove(F.sequence(F.lit(0), F.lit(stripes - 1)), F.col("stripe"))))
    asks = asked.select(F.col("to").alias("stripe"), F.lit(1).alias("kind"), F.col("query").alias("place"), "stripe", "label", F.col("vector").alias("data"), nothing.alias("ids"), nothing.alias("labels"), nothing.alias("zone_low"), nothing.alias("zone_high"), "low", "high")
    held = blocks.select("stripe", F.lit(0).alias("kind"), F.col("place").cast("long"), "stripe", F.lit(0).cast("long").alias("label"), F.col("vectors").alias("data"), "ids", "labels", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"), no_list.alias("low"), no_list.alias("high"))
    both = held.toDF(*(names := ["stripe", "kind", "place", "home", "label", "data", "ids", "labels", "zone_low", "zone_high", "low", "high"])).union(asks.toDF(*names))

    def matrix(column: pa.Array, empty: int) -> np.ndarray:
        """The windows' ends (queries, windows); queries with fewer windows than others have empty ones."""
        sizes = np.asarray(column.value_lengths(), np.int64)
        out = np.full((len(sizes), int(sizes.max(initial=0))), empty, np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(column.flatten(), np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, now, starts, count = Stripe(width), None, {}, 0
        for batch in sliced(batches, rows=p.chunk):
            of = np.asarray(batch.column("stripe")).astype(np.int64) * 2 + np.asarray(batch.column("kind"))
            cuts = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                rows = batch.slice(int(part[0]), len(part))
                if of[part[0]] >> 1 != now:
                    now, stripe, starts, count = of[part[0]] >> 1, Stripe(width), {}, 0
                if not of[part[0]] & 1:
                    for place, *block in zip(*(rows.column(c).to_pylist() for c in ("place", "ids", "labels", "data", "zone_low", "zone_high")), strict=True):
                        starts[place] = count
                        count += len(block[0]) // 8
                        stripe.add(*block)
                    continue
                if not stripe.blocks:
                    continue
                query, label = np.asarray(rows.column("place")), np.asarray(rows.column("label"))
                vectors = np.frombuffer(b"".join(rows.column("data").to_pylist()), "<i4").reshape(len(rows), width)
                own = np.array([starts[int(q >> 16) & 0xFFFFFFFF] + int(q & 0xFFFF) if q >> 48 == now else -1 for q in query], np.int64)
                found, _ = stripe.search(own, label, vectors, matrix(rows.column("low"), MOST), matrix(rows.column("high"), LEAST), same, best, p.blocks_at_once)
                yield pa.record_batch([pa.array(query[found[:, 0]]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]), pa.array(found[:, 3])], ["query", "window", "score", "id"])

    return both.repartition(stripes, "stripe").sortWithinPartitions("stripe", "kind", "place").mapInArrow(run, HITS)


def _best(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` hits of each query and window, with their ``rank``."""
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _over_all(blocks: DataFrame, queries: DataFrame, stripes: int, width: int, same: bool, best: int, p: MiningParams, label: str, paths: list[str]) -> DataFrame:
    """The best rows of all stripes for each query and window: first those of its own stripe, whose last one is the least that the other stripes need to beat."""
    near = written(_searched(blocks, queries, stripes, width, same, best, True, p), f"{label}_near", paths)
    full = near.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= best)
    by_query = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "last"))).alias("last"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("last", i), x)))
    seeded = queries.join(by_query, "query", "left").withColumn("low", raised)
    far = _searched(blocks, seeded, stripes, width, same, best, False, p)
    return written(_best(near.union(far), best), label, paths)


def mine(embeddings: DataFrame, label: Column, divisor: int, p: MiningParams = MiningParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors, the rows whose id is divisible by ``divisor``.

    ``label`` is an expression over the table's columns. An anchor's positives are its ``positives`` best other rows of its label; a positive's negatives are the best
    ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Ties go to the smaller id.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    with temporary(spark) as paths:
        mean, spread, n = moments(embeddings, p, embedding)
        width = len(mean)
        rows = written(keyed(embeddings, label, p, mean, spread, vec_id, embedding), "keyed", paths)
        blocks = written(blocks_of(rows, max(p.min_stripes, -(-n // p.stripe_rows)), width, p), "blocks", paths)
        stripes = (blocks.agg(F.max("stripe")).first()[0] or 0) + 1
        anchors = written(queries_of(blocks, divisor, width), "anchors", paths)
        ends = {name: F.array(F.lit(x).cast("long")) for name, x in (("low", LEAST), ("high", MOST))}
        positives = _over_all(blocks, anchors.withColumns(ends), stripes, width, True, p.positives, p, "positives", paths)

        # whole scores only: the lower end is rounded up and the upper one down
        down = "({0} * score - pmod({0} * score, 100)) div 100"
        ranged = positives.select("query", "rank", F.expr("-(" + down.format(-p.low) + ")").alias("from"), F.expr(down.format(p.high)).alias("to"))
        listed = ranged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "from", "to"))).alias("w"))
        asks = anchors.join(listed, "query").select("*", F.col("w.from").alias("low"), F.col("w.to").alias("high")).drop("w")
        negatives = _over_all(blocks, asks, stripes, width, False, p.negatives, p, "negatives", paths)
        placed = negatives.select("query", (F.col("window") + 1).alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        of = positives.select("query", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = placed.join(of, ["query", "place"]).join(anchors.select("query", F.col("id").alias("anchor_id")), "query")
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
