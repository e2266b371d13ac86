"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens (matches of the vocabulary's pattern) are linked lists of tokens, many of them side by side with a mark between that no merge takes. Candidate
merges wait in buckets, one a merge rank, that hold the left positions; three levels of 64-bit words say which buckets are in use, so the next rank is
found by three find-first-set steps however much text there is. The bucket of that rank is emptied from the left; a merge changes at most two
neighbouring pairs, which are queued anew, and one of a lower rank comes before the rest of the bucket. Entries that no longer stand for the pair at
their position are skipped when they come up. n bytes take O(n log n) steps.

Pre-tokens don't depend on each other, so a worker keeps the ids of short ones it has seen (at most ``cache_size``).
Defined results: a null or empty text gives no ids, and the digests of the empty string; ids that no token has decode to null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from beaconlake.session import ship_package

from .chunks import CACHED_CHARS, PATTERN, ChunkIds, sliced

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """A priority queue of (rank, position): lowest rank first, then lowest position."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.leaves = [0] * (ranks // 64 + 1)
        self.middle = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        bucket.append(position)
        if len(bucket) == 1:
            self.leaves[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def fill(self, ranks: np.ndarray) -> None:
        """Push every position with its rank; those below 0 are left out. The queue must be empty."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        values, first = np.unique(ranks[order], return_index=True)
        places, cuts = order.tolist(), [*first.tolist(), len(order)]
        for rank, i, j in zip(values.tolist(), cuts, cuts[1:], strict=False):
            self.push(rank, places[i])
            self.buckets[rank] += places[i + 1 : j]

    def first(self) -> int:
        """The lowest rank; the queue must not be empty."""
        m = (self.top & -self.top).bit_length() - 1
        word = self.middle[m]
        leaf = (m << 6) + (word & -word).bit_length() - 1
        word = self.leaves[leaf]
        return (leaf << 6) + (word & -word).bit_length() - 1

    def taken(self, rank: int) -> list[int]:
        """All positions of a rank in order; the rank's bucket is empty then."""
        bucket, self.buckets[rank] = self.buckets[rank], []
        leaf = rank >> 6
        self.leaves[leaf] &= ~(1 << (rank & 63))
        if not self.leaves[leaf]:
            self.middle[leaf >> 6] &= ~(1 << (leaf & 63))
            if not self.middle[leaf >> 6]:
                self.top &= ~(1 << (leaf >> 6))
        bucket.sort()
        return bucket

    def pop(self) -> tuple[int, int]:
        """The first entry; the queue must not be empty."""
        rank = self.first()
        position, *rest = self.taken(rank)
        for other in rest:
            self.push(rank, other)
        return rank, position


class RankBpe:
    """Encoder and decoder for a file of ranks (base64 token and rank a line) and its pattern."""

    GROUP_BYTES = 1 << 18

    def __init__(self, ranks_path: str, pattern: str, cache_size: int = 1 << 19):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.queue = RankQueue(size)
        self.findall = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.chunks = ChunkIds(self._fresh, () if pattern == PATTERN else None, cache_size)
        tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())  # null where no token has the rank
        self.byte_tokens = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to put a token together from two: what a merge of them gives
        self.pairs = {
            self.ranks[token[:i]] * (size + 1) + self.ranks[token[i:]]: rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }
        self.byte_pairs = np.full((257, 257), -1, np.int64)  # of two bytes; 256 is the mark
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.ranks.get(bytes([a, b]), -1)
        self.decimals = pa.array([f"{i} " for i in range(size)], pa.large_string())

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit integers."""
        mark, width, of, queue = len(self.tokens), len(self.tokens) + 1, self.pairs.get, self.queue
        data = np.full(sum(map(len, pieces)) + len(pieces) + 1, mark, np.int64)
        ends = np.cumsum([len(x) + 1 for x in pieces])  # where the mark behind each pre-token stands
        inside = np.ones(len(data), bool)
        inside[[0, *ends.tolist()]] = False
        letters = np.full(len(data), 256)
        letters[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        data[inside] = self.byte_tokens[letters[inside]]
        both = np.append(self.byte_pairs[letters[:-1], letters[1:]], -1)
        queue.fill(both)
        token, pair = data.tolist(), both.tolist()  # pair: rank of this token and the next; -1 for none
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        buckets, push = queue.buckets, queue.push
        while queue.top:
            rank = queue.first()
            bucket = queue.taken(rank)
            for n, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                after[i] = stop = after[gone]
                before[stop] = i
                token[i], token[gone], pair[gone] = rank, -1, -1
                j = before[i]
                right, left = of(rank * width + token[stop], -1), of(token[j] * width + rank, -1)
                pair[i], pair[j] = right, left
                if right >= 0:
                    if buckets[right]:
                        buckets[right].append(i)
                    else:
                        push(right, i)
                if left >= 0:
                    if buckets[left]:
                        buckets[left].append(j)
                    else:
                        push(left, j)
                if -1 < right < rank or -1 < left < rank:
                    for k in bucket[n + 1 :]:
                        push(rank, k)
                    break
        ids = np.array(token, np.int64)
        stays = ids >= 0
        counts = np.cumsum(stays & (ids != mark))[ends].tolist()
        flat = ids[stays & (ids != mark)].astype("<u4").tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *counts], counts, strict=False)]

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        known = self.words
        if len(known) > self.cache_size:
            known.clear()
        split = [self.findall(c) for c in chunks]
        new = [w for w in {w for words in split for w in words} if w not in known]
        found, group, size = {}, [], 0
        for word in new:
            piece = word.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                found[word] = whole.to_bytes(4, "little")
                continue
            group.append((word, piece))
            size += len(piece)
            if size >= self.GROUP_BYTES:
                found.update(zip((w for w, _ in group), self.merge([x for _, x in group]), strict=True))
                group, size = [], 0
        if group:
            found.update(zip((w for w, _ in group), self.merge([x for _, x in group]), strict=True))
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHED_CHARS)
        return [b"".join([found[w] if w in found else known[w] for w in words]) for words in split]

    def encode(self, text: str) -> list[int]:
        return self.chunks.ids(pa.array([text]))[0].tolist()

    def ids_text(self, text: str) -> str:
        """The ids in decimal, one space between."""
        return " ".join(map(str, self.encode(text)))

    def decode(self, ids_text: str) -> bytes:
        """Bytes of decimal ids with one space between; each must have a token."""
        return b"".join(self.tokens.take(pa.array(list(map(int, ids_text.split())), pa.int64())).to_pylist())

    def joined(self, values: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """For each text the values of its ids, put together; ``values`` are those of all ids and never null at these."""
        taken = values.take(pa.array(ids))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b"")
        cuts = places[np.concatenate([[0], ends])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_loaded: dict[tuple[str, str], RankBpe] = {}


def loaded(ranks_path: str, pattern: str) -> RankBpe:
    """This worker's encoder for a vocabulary."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = RankBpe(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(ranks_path, pattern)
        for batch in sliced(batches):
            ids, ends = codec.chunks.ids(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column(0), lists], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of every row of ids; a null list counts as empty, and a list with a null or an id without a token gives null."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(ranks_path, pattern)
        for batch in sliced(batches):
            lists = batch.column(1).fill_null([])
            ids = lists.flatten()
            fits = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(codec.tokens))), False)
            tokens = codec.tokens.take(pc.if_else(fits, ids, None))
            sizes = lists.value_lengths().to_numpy()
            of = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), tokens)
            yield pa.record_batch([batch.column(0), pc.binary_join(of, pa.scalar(b"", pa.large_binary())).cast(pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text is encoded, and its ids are decoded, in one pass."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(ranks_path, pattern)
        for batch in sliced(batches):
            ids, ends = codec.chunks.ids(batch.column(1))
            counts = np.diff(ends, prepend=0)
            ids_hash = [hashlib.sha256(x[:-1]).hexdigest() for x in codec.joined(codec.decimals, ids, ends)]
            decoded_hash = [hashlib.sha256(x).hexdigest() for x in codec.joined(codec.tokens, ids, ends)]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)
