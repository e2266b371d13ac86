"""N-gram Jaccard join with a count-vector R-tree.

A document's set is that of its distinct word shingles. The shingles are hashed into ``groups`` groups, and the counts by group are a
point; the sum of coordinate minima of two points bounds the overlap of the sets. Points are indexed in R-trees whose boxes keep
the maximum of every coordinate and the least set size, so that a box bounds the overlap with all points in it. Every pair that is verified was found by a
search of such a tree; verification takes the whole texts. Results are exact up to collisions of 64-bit hashes.

Spark deals out the forest: there is a tree for every block, that is, a set of documents that share a shingle among the first
``n - ceil(t n) + 1`` in a global order, which two linked sets cannot avoid. (In one tree of the whole corpus the upper boxes overlap in all coordinates, and a
search would meet nearly all points.) The order puts shingles that are frequent by a counting sketch of
all documents (of fixed size) last, so that common passages hardly make blocks. Shingles whose holders have the same least class by hash make one block, so that a
group of near copies, which shares many shingles, is in few.

Steps:

1. equal sets become one class, so copies are never paired;
2. each class searches the trees of its blocks for a point of a class that precedes it, and stops at the first within the bound; the pair with the largest bound of
   all its blocks is verified, and components are formed;
3. blocks that still hold classes of several components are searched again: first for each class's point of another component with the
   largest bound, after which components are formed again; then for all pairs across components that the bound allows.

A tree has at most about ``cell`` classes. In step 2 a larger block becomes several trees that share about ``pivots`` of its classes. In step 3 its
largest component and the rest are cut into parts, and pairs of parts meet in trees of their own; parts of the largest component don't meet each other.
So a group of near copies costs about one verification a member, and no link between different sets is lost where it could join two components.
``link_components`` stops there. ``link_counts`` goes on to the links inside the components: every link joins two classes of one component, so all pairs of
classes of each component are compared on their whole texts, and the links of a row are counted.

No step gathers a block, a shingle or a component in one task: their numbers are aggregated first and joined to the rows, where Spark splits a
skewed partition. Intermediate tables are dropped after their last reader.

Defined results: null and empty texts, and those without words, have an empty set (size 0) and are linked with nothing; rows of equal sets are
linked; a null id is never a component's id unless all its members' ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.session import ship_package

from .chunks import sliced
from .components import connected
from .scratch import temporary, written
from .shingles import buffer_of, mixed, shingle_sets


@dataclass(frozen=True)
class JoinParams:
    """Linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    groups: int = 512
    sketch_bits: int = 18
    cell: int = 512
    pivots: int = 16
    leaf: int = 16
    link_rows: int = 1024
    link_shingles: int = 1 << 20
    share: int = 512
    broadcast_rows: int = 500_000


def _packed(counts: np.ndarray) -> bytes:
    """A count vector as bytes, with one, two or four bytes a coordinate as its largest count takes."""
    most = int(counts.max(initial=0))
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _points(column, groups: int) -> np.ndarray:
    """Packed count vectors as the rows of a matrix."""
    packed = column.to_pylist()
    widths = {len(x) for x in packed}
    if widths == {groups}:
        return np.frombuffer(b"".join(packed), "u1").reshape(len(packed), groups)
    kinds = {groups: "u1", 2 * groups: "<u2", 4 * groups: "<u4"}
    return np.array([np.frombuffer(x, kinds[len(x)]) for x in packed], np.uint32).reshape(len(packed), groups)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima."""
    return np.minimum(a, b).sum(1, dtype=np.int64)


def _reaches(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """100 * overlap >= percent * union, for sizes that add up to ``sizes``."""
    return (100 + percent) * overlap >= percent * sizes


def sketch(docs: DataFrame, p: JoinParams, text: str) -> np.ndarray:
    """How often shingles fall in each slot of a counting sketch, over all documents; slots are the high bits of the hash."""
    slots, shift = 1 << p.sketch_bits, np.uint64(64 - p.sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in sliced(batches, rows=512, megabytes=4):
            sets = shingle_sets(*buffer_of(batch.column(0)), p.words)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=slots)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["slot", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _excess(counts: np.ndarray) -> np.ndarray:
    """By how much a slot's count is out of the ordinary; 0 for ordinary ones."""
    middle = np.median(counts)
    limit = middle + 3 * np.sqrt(middle + 1)
    return np.where(counts > limit, counts - middle, 0).astype(np.float32)


SETS = "doc_id long, text_key long, n long, cls long, counts binary, prefix array<long>"


#: A task remembers so many classes whose vectors it has sent.
SEEN = 1 << 18


def summarise(docs: DataFrame, p: JoinParams, doc_id: str, text: str, paths: list[str]) -> DataFrame:
    """Columns of SETS for every row: set size, class, count vector and prefix; the last two are left out where a task has sent them for the class."""
    excess = docs.sparkSession.sparkContext.broadcast(_excess(sketch(docs, p, text)))  # of fixed size
    shift = np.uint64(64 - p.sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, rows=512, megabytes=4):
            n, cls, counts, prefix = [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for s in shingle_sets(*buffer_of(batch.column(2)), p.words):
                n.append(len(s))
                if not len(s):
                    cls.append(None)
                    counts.append(None)
                    prefix.append(None)
                    continue
                marks = np.array([len(s), np.bitwise_xor.reduce(mixed(s ^ np.uint64(7))), mixed(s).sum(dtype=np.uint64)], np.uint64)
                one = int(mixed(marks.sum(dtype=np.uint64, keepdims=True)).astype(np.int64)[0])
                cls.append(one)
                if one in seen:
                    counts.append(None)
                    prefix.append(None)
                    continue
                seen.add(one)
                counts.append(_packed(np.bincount((s % np.uint64(p.groups)).astype(np.int64), minlength=p.groups)))
                first = len(s) - -(-p.percent * len(s) // 100) + 1
                order = np.lexsort((s, excess.value[(s >> shift).astype(np.int64)]))[:first]
                prefix.append(s[order].astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(counts, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "text_key", "n", "cls", "counts", "prefix"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return written(named.mapInArrow(run, SETS), "sets", paths)


def blocks_of(sets: DataFrame, paths: list[str]) -> DataFrame:
    """``block, cls``: the classes that share a prefix shingle, two or more; shingles with one pivot, the least class by hash, make one block together."""
    tokens = sets.filter("prefix is not null").select("cls", F.explode("prefix").alias("token"))
    pivot = F.xxhash64("cls")
    shared = tokens.groupBy("token").agg(F.min(pivot).alias("block"), F.max(pivot).alias("other")).filter("block <> other").select("token", "block")
    return written(tokens.join(shared, "token").select("block", "cls").distinct(), "blocks", paths)


def vectors_of(sets: DataFrame, blocks: DataFrame, paths: list[str]) -> DataFrame:
    """``cls, n, counts`` of every class in a block, once."""
    wanted = blocks.select("cls").distinct()
    return written(sets.filter("counts is not null").join(wanted, "cls", "left_semi").groupBy("cls", "n").agg(F.min("counts").alias("counts")), "vectors", paths)


def _small(table: DataFrame, p: JoinParams, paths: list[str]) -> DataFrame:
    """The table, written, and broadcast to a join where it has ``broadcast_rows`` rows at most."""
    table = written(table, "small", paths)
    return F.broadcast(table) if table.count() <= p.broadcast_rows else table


class Tree:
    """An R-tree over count vectors, packed by splitting at the median of the widest coordinate; nodes also know their least rank."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, leaf: int):
        self.points, self.sizes, self.ranks, self.leaf = points, sizes, ranks, leaf
        self.root = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray) -> tuple:
        some = self.points[at]
        children = None
        if len(at) > self.leaf:
            wide = int(np.ptp(some, 0).argmax())
            order = at[np.argsort(some[:, wide], kind="stable")]
            children = [self._node(part) for part in np.array_split(order, 4)]
        return some.max(0), int(self.sizes[at].min()), int(self.ranks[at].min()), at, children

    def search(self, percent: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(asking points, point, bounds) of all pairs whose bound reaches the limit; each point asks for all."""
        stack = [(self.root, np.arange(len(self.points)))]
        while stack:
            (high, least, _, at, children), asked = stack.pop()
            bound = _overlap(self.points[asked], high)
            asked = asked[_reaches(bound, self.sizes[asked] + least, percent)]
            if not len(asked):
                continue
            if children:
                stack += [(child, asked) for child in children]
                continue
            for point in at:
                bound = _overlap(self.points[asked], self.points[point])
                reached = _reaches(bound, self.sizes[asked] + self.sizes[point], percent)
                if reached.any():
                    yield asked[reached], int(point), bound[reached]

    def preceding(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """For each point the first leaf's nearest point of a lower rank within the bound, and that bound; -1 where there is none."""
        found, best = np.full(len(self.points), -1), np.full(len(self.points), -1)
        stack = [(self.root, np.arange(len(self.points)))]
        while stack:
            (high, least, first, at, children), asked = stack.pop()
            asked = asked[(found[asked] < 0) & (self.ranks[asked] > first)]
            if not len(asked):
                continue
            asked = asked[_reaches(_overlap(self.points[asked], high), self.sizes[asked] + least, percent)]
            if not len(asked):
                continue
            if children:
                stack += [(child, asked) for child in reversed(children)]
                continue
            for point in at:
                lower = asked[self.ranks[asked] > self.ranks[point]]
                bound = _overlap(self.points[lower], self.points[point])
                better = _reaches(bound, self.sizes[lower] + self.sizes[point], percent) & (bound > best[lower])
                found[lower[better]], best[lower[better]] = point, bound[better]
        return found, best


def _texts(pairs: DataFrame, least: DataFrame, named: DataFrame, p: JoinParams, paths: list[str]) -> DataFrame:
    """``cls, text`` of the classes in the pairs, a row a class; rows of one id are told apart by their texts, and of rows alike in both one is taken.

    The list of wanted rows is broadcast only up to ``broadcast_rows``; a longer one is joined by shuffle.
    """
    classes = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = written(least.join(classes, "cls", "left_semi").select("cls", "one.*"), "chosen", paths)
    rows, repeated = chosen.agg(F.count("*"), F.max("copies")).first()
    if rows <= p.broadcast_rows:
        chosen = F.broadcast(chosen)
    found = named.join(chosen, (named["key"] == chosen["text_key"]) & named["id"].eqNullSafe(chosen["doc_id"])).select("cls", "text")
    if (repeated or 1) > 1:  # tasks keep one text a class before they send any
        found = found.groupBy("cls").agg(F.first("text").alias("text"))
    return written(found, "texts", paths)


def _verified(pairs: DataFrame, texts: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) whose sets, taken from the whole texts, are linked.

    Pairs with one b come together in shares of about ``share`` with one copy of b's text each.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / p.share).cast("int").alias("shares"))
    placed = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), "shares").cast("int").alias("share"))
    own = placed.join(texts, placed["a"] == texts["cls"]).select("b", "share", F.lit(1).alias("part"), "a", "text")
    other = placed.select("b", "share").distinct().join(texts, F.col("b") == texts["cls"]).select("b", "share", F.lit(0).alias("part"), F.col("b").alias("a"), "text")
    dealt = own.union(other).repartition("b", "share").sortWithinPartitions("b", "share", "part", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.uint64)  # the set of the share's class b
        for batch in sliced(batches, rows=512, megabytes=4):
            a, b, part = (batch.column(k).to_numpy() for k in ("a", "b", "part"))
            keep = np.zeros(len(batch), bool)
            for i, x in enumerate(shingle_sets(*buffer_of(batch.column("text")), p.words)):
                if not part[i]:
                    kept = x
                elif len(x) and len(kept):
                    at = np.minimum(np.searchsorted(kept, x), len(kept) - 1)
                    keep[i] = _reaches(int((kept[at] == x).sum()), len(x) + len(kept), p.percent)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of whole cells, from batches in order of the cells; the first three columns name the cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:  # a cell of several batches is held until it is whole
        if not len(batch):
            continue
        keys = [batch.column(k)[0].as_py() for k in range(3)]
        if held and keys != last:
            yield pa.Table.from_batches(held)
            held = []
        ends = [batch.column(k)[len(batch) - 1].as_py() for k in range(3)]
        if ends != keys:
            same = np.ones(len(batch), bool)
            for k in range(3):
                same &= np.asarray(batch.column(k)) == ends[k]
            tail = int(same.argmax())
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
        else:
            held.append(batch)
        last = ends
    if held:
        yield pa.Table.from_batches(held)


def _cells_in(rows: pa.Table) -> list[np.ndarray]:
    """Row numbers of each cell in a table of whole cells."""
    keys = [rows.column(k).to_numpy() for k in range(3)]
    new = np.zeros(max(0, len(rows) - 1), bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.split(np.arange(len(rows)), np.flatnonzero(new) + 1)


def _small_pairs(cells: list[np.ndarray], leaf: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All pairs (row, row) of the cells with one leaf's points at most, and the other cells."""
    pairs, large = [np.zeros((0, 2), np.int64)], []
    by_size: dict[int, list[int]] = {}
    for at in cells:
        if len(at) > leaf:
            large.append(at)
        else:
            by_size.setdefault(len(at), []).append(int(at[0]))
    for size, firsts in by_size.items():
        i, j = np.triu_indices(size, 1)
        first = np.array(firsts)[:, None]
        pairs.append(np.stack([(first + i).ravel(), (first + j).ravel()], 1))
    return np.concatenate(pairs), large


PAIRS = "a long, b long, bound long"


def _searched(cells: DataFrame, vectors: DataFrame, p: JoinParams, kind: str) -> DataFrame:
    """Columns of PAIRS, a > b: what the trees of the cells (block, c1, c2, cls, label, part) find; a tree of one leaf is its list of points.

    ``kind`` is ``preceding``: of each class one pair with a lower class; ``nearest``: of each class the pair with the largest bound among those of other labels; or ``all``:
    every pair of different labels. Where c1 and c2 differ, only classes of different parts are paired.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bound", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(sliced(batches, rows=8192)):
            cls, label, part, n, c1, c2 = (rows.column(k).to_numpy() for k in ("cls", "label", "part", "n", "c1", "c2"))
            points = _points(rows.column("counts"), p.groups)
            found = [np.zeros((0, 3), np.int64)]

            def keep(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> None:
                fits = (cls[x] > cls[y]) & ((part[x] != part[y]) | (c1[x] == c2[x]))  # noqa: B023
                if kind != "preceding":
                    fits &= label[x] != label[y]  # noqa: B023
                found.append(np.stack([x[fits], y[fits], bound[fits]], 1))  # noqa: B023

            small, large = _small_pairs(_cells_in(rows), p.leaf)
            for first in range(0, len(small), 1 << 14):
                x, y = small[first : first + (1 << 14)].T
                x, y = np.where(cls[x] > cls[y], x, y), np.where(cls[x] > cls[y], y, x)
                bound = _overlap(points[x], points[y])
                some = _reaches(bound, n[x] + n[y], p.percent)
                keep(x[some], y[some], bound[some])
            for at in large:
                tree = Tree(points[at], n[at], cls[at], p.leaf)
                if kind == "preceding":
                    y, bound = tree.preceding(p.percent)
                    x = np.flatnonzero(y >= 0)
                    keep(at[x], at[y[x]], bound[x])
                else:
                    for x, y, bound in tree.search(p.percent):
                        keep(at[x], np.full(len(x), at[y]), bound)
            pairs = np.concatenate(found)
            if kind == "nearest":  # of each class and cell; either may be the higher class
                both = np.concatenate([pairs, pairs[:, [1, 0, 2]]])
                both = both[np.lexsort((both[:, 1], -both[:, 2], both[:, 0]))]  # a row stands in one cell
                first = np.ones(len(both), bool)
                first[1:] = both[1:, 0] != both[:-1, 0]
                best = both[first]
                higher = cls[best[:, 0]] > cls[best[:, 1]]
                pairs = np.where(higher[:, None], best, best[:, [1, 0, 2]])
            yield pa.record_batch([pa.array(cls[pairs[:, 0]]), pa.array(cls[pairs[:, 1]]), pa.array(pairs[:, 2])], schema=schema)

    ready = cells.join(vectors, "cls").repartition("block", "c1", "c2").sortWithinPartitions("block", "c1", "c2", "cls")
    return ready.select("block", "c1", "c2", "cls", "label", "part", "n", "counts").mapInArrow(run, PAIRS)


def _preceding(blocks: DataFrame, vectors: DataFrame, p: JoinParams, paths: list[str]) -> DataFrame:
    """``a, b``: of each class the pair with a lower class that has the largest bound of those that its blocks' trees find."""
    totals = blocks.groupBy("block").agg(F.ceil(F.count("*") / p.cell).cast("int").alias("parts"), F.min("cls").alias("least"), F.ceil(F.count("*") / p.pivots).alias("every"))
    placed = blocks.join(_small(totals.filter("parts > 1"), p, paths), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("cls", F.lit("part")), "parts").cast("int"))
    shared = (F.col("cls") == F.col("least")) | (F.pmod(F.xxhash64("cls", F.lit("pivot")), F.col("every")) == 0)
    cells = placed.select("block", "cls", F.explode(F.when(shared, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)).alias("c1"))
    whole = cells.select("block", "c1", F.col("c1").alias("c2"), "cls", F.lit(0).cast("long").alias("label"), F.lit(0).alias("part"))
    found = _searched(whole, vectors, p, "preceding")
    return found.groupBy("a").agg(F.max_by("b", F.struct("bound", "b")).alias("b"))


def _across(blocks: DataFrame, labels: DataFrame, vectors: DataFrame, p: JoinParams, nearest: bool, paths: list[str]) -> DataFrame:
    """``a, b``, a > b: classes in one block but in different components, whose bound allows a link.

    With ``nearest``, of each class in a cell only the pair with the largest bound.
    """
    label = labels.select(F.col("node").alias("cls"), "label")
    marked = blocks.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    each = marked.groupBy("block", "label").agg(F.count("*").alias("n"))
    totals = each.groupBy("block").agg(F.count("*").alias("labels"), F.sum("n").alias("held"), F.max(F.struct("n", "label")).alias("largest")).filter("labels > 1")
    split = F.col("held") > p.cell
    main, rest = F.ceil(F.col("largest.n") / p.cell).cast("int"), F.ceil((F.col("held") - F.col("largest.n")) / p.cell).cast("int")
    dealt = totals.select("block", F.col("largest.label").alias("largest"), F.when(split, main).otherwise(0).alias("main"), F.when(split, rest).otherwise(1).alias("rest"))
    placed = marked.join(_small(dealt, p, paths), "block")
    # parts of the largest component come first; a part of it meets each of the rest, and those meet each other
    in_main = (F.col("main") > 0) & (F.col("label") == F.col("largest"))
    part = F.when(in_main, F.pmod(F.xxhash64("cls", F.lit("part")), F.greatest("main", F.lit(1)))).otherwise(F.col("main") + F.pmod(F.xxhash64("cls", F.lit("part")), "rest")).cast("int")
    others = F.sequence(F.when(in_main, F.col("main")).otherwise(F.lit(0)), F.col("main") + F.col("rest") - 1)
    celled = placed.select("block", "cls", "label", part.alias("part"), F.explode(others).alias("other"))
    cells = celled.select("block", F.least("part", "other").alias("c1"), F.greatest("part", "other").alias("c2"), "cls", "label", "part")
    return _searched(cells, vectors, p, "nearest" if nearest else "all").select("a", "b").distinct()


def _linked_weight(sets: list[np.ndarray], weight: np.ndarray, part: np.ndarray, same_part: bool, percent: int) -> np.ndarray:
    """For each set the summed weight of the other sets that it is linked with; unless ``same_part``, only of those in another part.

    Overlaps are exact: shingles that many sets hold are counted by a matrix product, the others through the list of sets that hold them.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = (held > 1) & (held * 8 >= m) & (m >= 32)
    place = np.cumsum(dense) - 1
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # sums stay exact
    grid, of_dense = np.zeros((m, int(dense.sum())), kind), dense[column]
    grid[owner[of_dense], place[column[of_dense]]] = 1
    thin = ((held > 1) & ~dense)[column]
    row, col = owner[thin], column[thin]
    order = np.argsort(col, kind="stable")
    holder, first = row[order], np.searchsorted(col[order], np.arange(len(held)))
    ends = np.searchsorted(row, np.arange(m + 1))
    cost = np.concatenate([[0], np.cumsum(held[col])])[ends]  # holders met by the rows before each row
    out, low = np.zeros(m, np.int64), 0
    while low < m:
        high = max(low + 1, min(low + 256, int(np.searchsorted(cost, cost[low] + (1 << 22), "right")) - 1))
        common = np.rint(grid[low:high] @ grid.T).astype(np.int64)
        some = slice(ends[low], ends[high])
        many = held[col[some]]
        if len(many):
            met = holder[np.repeat(first[col[some]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            common += np.bincount(np.repeat(row[some] - low, many) * m + met, minlength=(high - low) * m).reshape(high - low, m)
        linked = (common > 0) & _reaches(common, sizes[low:high, None] + sizes, percent)
        if same_part:
            linked[np.arange(high - low), np.arange(low, high)] = False
        else:
            linked &= part[low:high, None] != part
        out[low:high] = linked @ weight
        low = high
    return out


def _links_inside(labels: DataFrame, least: DataFrame, named: DataFrame, p: JoinParams, paths: list[str]) -> DataFrame:
    """``cls, others``: to how many rows of other classes the rows of a class are linked; classes without such links are left out.

    A component over ``link_rows`` classes or ``link_shingles`` shingles is dealt out in pairs of parts. Cells send one number a class.
    """
    label = labels.select(F.col("node").alias("cls"), "label")
    classes = written(least.join(label, "cls").select("cls", "label", "n", "rows", "one"), "classes", paths)
    totals = classes.groupBy("label").agg(F.count("*").alias("held"), F.sum("n").alias("shingles")).filter("held > 1")
    parts = totals.select("label", F.greatest(F.ceil(F.col("held") / p.link_rows), F.ceil(F.col("shingles") / p.link_shingles)).cast("int").alias("parts"))
    placed = classes.join(parts, "label").withColumn("mine", F.pmod(F.xxhash64("cls", F.lit("part")), F.col("parts")).cast("int"))
    texts = _texts(placed.select(F.col("cls").alias("a"), F.col("cls").alias("b")), least, named, p, paths)
    # k parts become k (k + 1) / 2 cells
    celled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = celled.select("label", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "cls", "mine", F.col("rows").alias("weight"))
    ready = cells.join(texts, "cls").select("label", "c1", "c2", "cls", "mine", "weight", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(sliced(batches)):
            cls, mine, weight = (rows.column(k).to_numpy() for k in ("cls", "mine", "weight"))
            c1, c2 = rows.column("c1").to_numpy(), rows.column("c2").to_numpy()
            sets = [x for chunk in rows.column("text").chunks for x in shingle_sets(*buffer_of(chunk), p.words)]
            others = np.zeros(len(rows), np.int64)
            for at in _cells_in(rows):
                if len(at) > 1:
                    others[at] = _linked_weight(sets[at[0] : at[-1] + 1], weight[at], mine[at], bool(c1[at[0]] == c2[at[0]]), p.percent)
            some = others > 0
            yield pa.record_batch([pa.array(cls[some]), pa.array(others[some])], ["cls", "others"])

    dealt = ready.repartition("label", "c1", "c2").sortWithinPartitions("label", "c1", "c2")
    return written(dealt.mapInArrow(run, "cls long, others long").groupBy("cls").agg(F.sum("others").alias("others")), "others", paths)


def classes_of(sets: DataFrame) -> DataFrame:
    """``cls, first_id, one, n, rows`` of every class: its least id, the row that stands for it (id, text, how many rows are alike in both), its set's size, and its rows."""
    alike = sets.filter("cls is not null").groupBy("cls", "doc_id", "text_key").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    return alike.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key", "copies")).alias("one"), F.first("n").alias("n"), F.sum("copies").alias("rows"))


def _joined(docs: DataFrame, p: JoinParams, doc_id: str, text: str, paths: list[str], counted: bool) -> DataFrame:
    """The rows of ``link_components`` or, if ``counted``, of ``link_counts``; they read tables of ``paths``."""
    ship_package(docs.sparkSession)
    sets = summarise(docs, p, doc_id, text, paths)
    least = classes_of(sets)
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))

    with temporary(docs.sparkSession) as own:
        blocks = blocks_of(sets, own)
        vectors = vectors_of(sets, blocks, own)

        def verified(pairs: DataFrame) -> DataFrame:
            with temporary(docs.sparkSession) as texts:
                return written(_verified(pairs, _texts(pairs, least, named, p, texts), p), "links", own)

        tried = written(_preceding(blocks, vectors, p, own), "pairs", own)
        links = verified(tried)
        labels = connected(links, paths)
        for nearest in (True, False):
            pairs = written(_across(blocks, labels, vectors, p, nearest, own).join(tried, ["a", "b"], "left_anti"), "pairs", own)
            tried = tried.union(pairs)
            more = verified(pairs)
            if more.limit(1).count():
                links = links.union(more)
                labels = connected(links, paths)

    label = labels.select(F.col("node").alias("cls"), "label")
    grouped = least.select("cls", "first_id").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component"))
    component_of = written(grouped.join(smallest, "label").select("cls", "component"), "components", paths)
    component = F.when(F.col("cls").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = sets.join(component_of, "cls", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("cls").alias("class_id"))
    if not counted:
        return rows
    others = _links_inside(labels, least, named, p, paths)
    links_of = least.select("cls", "rows").join(others, "cls", "left").select(F.col("cls").alias("class_id"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return rows.join(links_of, "class_id", "left").select(*rows.columns, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def link_components(docs: DataFrame, p: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, class_id`` for every row; the component's id is its least doc_id.

    ``text_key`` is Spark's xxhash64 of the text.
    """
    with temporary(docs.sparkSession) as paths:
        return written(_joined(docs, p, doc_id, text, paths, False), "joined")


def link_counts(docs: DataFrame, p: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``link_components`` and ``n_links``: with how many other rows a row is linked, those of its own class among them."""
    with temporary(docs.sparkSession) as paths:
        return written(_joined(docs, p, doc_id, text, paths, True), "joined")


def keep_first(docs: DataFrame, p: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they are: that of the least doc_id (null last), then the least text_key.

    Rows with an empty set all stay. Of rows alike in id and text, any one stays.
    """
    judged = link_components(docs, p, doc_id, text)
    full = judged.filter("class_id is not null")
    ids = full.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("one")).select("one.doc_id", "one.text_key")
    keep = ids.unionByName(judged.filter("class_id is null").select("doc_id", "text_key").distinct())
    # the row goes as one column, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("body"))
    keep, repeated = (x.select(F.col("doc_id").alias("keep_id"), F.col("text_key").alias("keep_key")) for x in (keep, full.groupBy("doc_id", "text_key").count().filter("count > 1")))
    alike = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    kept = rows.join(keep, alike, "left_semi")
    if repeated.limit(1).count():
        kept = kept.join(repeated, alike, "left_anti").unionByName(kept.join(repeated, alike, "left_semi").dropDuplicates(["id", "body"]))
    return kept.select("row.*")
