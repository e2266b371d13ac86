"""Token-id output as directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the low chunk of every id and a bitmap that says which ids go on; level 1
holds the next chunk of those, and so on. A rank directory (ones before every 512th bit) gives an id's place on
the next level, so any token is read with one step a level and nothing else is decoded; a range of tokens is a slice on every level.

``write_tokens`` encodes the texts with a public tokenizer and writes segments of about ``segment_tokens`` ids in ascending
(doc_id, text) order as a Parquet table of binary segments; ``read_tokens`` gives every document's ids back from the
table alone, with the number of ids before it. Documents are dealt by range, so no task holds more than its share; segment numbers are
(part, seq), and only one count a part is summed up to place the parts.

Defined results: a null or empty text has only the end id; a null doc_id sorts first; repeated rows are written as often as they occur.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beaconlake.session import ship_package

from .chunks import ChunkIds, sliced
from .scratch import written

BLOCK = 512
MAGIC = b"DAC1"
SEGMENTS = "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """Ids below 2**32 as bytes: magic, number of levels, and for each level its length, chunks, bitmap and rank directory."""
    ids = np.asarray(ids, np.uint32)
    levels = []
    while True:
        rest = ids >> 8
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(ids), BLOCK), dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<Q", len(ids)) + (ids & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not goes_on.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        ids = rest[goes_on]


class Codes:
    """Random access to the ids in the bytes of ``encode_codes``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(data, "<u4", -(-n // BLOCK) + 1, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i: the directory's count and the bits of one block."""
        first = i // BLOCK * BLOCK
        return int(ranks[i // BLOCK]) + int(np.unpackbits(bits[first // 8 : -(-i // 8)], bitorder="little")[: i - first].sum())

    def __getitem__(self, i: int) -> int:
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1: those that go on stand side by side on the next level."""
        out, where = np.zeros(stop - start, np.uint32), None
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out, where = part, np.arange(len(part))
            else:
                out[where] |= part
            first = start // 8
            on = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - first * 8 : stop - first * 8].astype(bool)
            if not on.any():
                break
            start = self._rank(bits, ranks, start)
            where = where[on]
            stop = start + len(where)
        return out


class ChunkEncoder(ChunkIds):
    """The tokenizers library over chunks; over whole texts where the file doesn't say the pattern that chunks are cut by."""

    def __init__(self, tokenizer_path: str, cache_size: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        says = json.loads(self.tokenizer.to_str())
        before = says["pre_tokenizer"] or {}
        by_pattern = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and says["model"]["type"] == "BPE"
        plain = not (says["normalizer"] or says["truncation"] or says["padding"])
        super().__init__(self._chunks, tuple(t["content"] for t in says["added_tokens"]) if by_pattern and plain else None, cache_size)
        # what the tokenizer writes for a space begins exactly the tokens that begin with one
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.whole is not None:
            space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
            self.spaced[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks of a space and a word are encoded in rows: a token that begins with a space begins a chunk."""
        if self.whole is None:
            return self._one_by_one(chunks)
        out: dict[str, bytes] = {}
        words = [c for c in chunks if c[:1] == " " and c.isprintable() and c.count(" ") == 1]
        for at in range(0, len(words), 512):
            row = words[at : at + 512]
            joined = "".join(row)
            if any(w in joined for w in self.whole):
                continue
            data = self._one_by_one([joined])[0]
            cuts = (4 * np.flatnonzero(self.spaced[np.frombuffer(data, "<u4")])).tolist()
            if len(cuts) == len(row):
                out.update(zip(row, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        rest = [c for c in chunks if c not in out]
        out.update(zip(rest, self._one_by_one(rest), strict=True))
        return list(map(out.__getitem__, chunks))


NO_IDS = np.zeros(0, "<u4")
_loaded: dict[str, ChunkEncoder] = {}


def loaded(tokenizer_path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file."""
    if tokenizer_path not in _loaded:
        _loaded[tokenizer_path] = ChunkEncoder(tokenizer_path)
    return _loaded[tokenizer_path]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, segment_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, write the segments, and return the table of them (columns of SEGMENTS)."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(tokenizer_path), TaskContext.get().partitionId()
        seq = first = 0
        names: list[pa.Array] = []
        held, sizes = [NO_IDS], [np.zeros(0, np.int64)]

        def flush() -> pa.RecordBatch:
            nonlocal seq, first
            ids = np.concatenate(held)
            row = {"part": [part], "seq": [seq], "first_token": [first], "n_tokens": [len(ids)], "doc_ids": [pa.concat_arrays(names).to_pylist()], "doc_tokens": [np.concatenate(sizes)], "codes": [encode_codes(ids)]}
            seq, first = seq + 1, first + len(ids)
            names.clear()
            del held[1:], sizes[1:]
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in sliced(batches):
            ids, ends = encoder.ids(batch.column(1))
            ends = ends + np.arange(1, len(batch) + 1)  # each text's end id included
            with_end = np.full(len(ids) + len(batch), end_id, "<u4")
            own = np.ones(len(with_end), bool)
            own[ends - 1] = False
            with_end[own] = ids
            size, at = sum(map(len, held)), 0
            while at < len(batch):  # as many texts as it takes to fill the segment
                before = int(ends[at - 1]) if at else 0
                stop = min(len(batch), int(np.searchsorted(ends, before + segment_tokens - size)) + 1)
                names.append(batch.column(0).slice(at, stop - at))
                held.append(with_end[before : ends[stop - 1]])
                sizes.append(np.diff(ends[at:stop], prepend=before))
                size, at = size + len(held[-1]), stop
                if size >= segment_tokens:
                    yield flush()
                    size = 0
        if names:
            yield flush()

    named = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    # the text's hash deals out the rows of an id that is repeated very often
    ordered = named.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(segments, SEGMENTS), "token-codes")


def read_tokens(segments: DataFrame, per_document, schema: str) -> DataFrame:
    """Apply ``per_document(ids) -> tuple`` to every document's ids (numpy uint32, end id included), read from the segments.

    Returns ``doc_id, start, n_tokens`` and the columns of ``schema``; ``start`` is the number of ids of all documents before it.
    """
    ship_package(segments.sparkSession)
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("part_start"))  # one row a part of the table
    placed = segments.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("first_token")).alias("start"), "doc_ids", "doc_tokens", "codes")
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows=1):
            row = batch.to_pylist()[0]
            codes = Codes(row["codes"])
            ids = codes.slice(0, len(codes))  # every document of the segment is wanted
            ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
            own = [per_document(part) for part in np.split(ids, ends[:-1])]
            columns = [row["doc_ids"], row["start"] + ends - row["doc_tokens"], row["doc_tokens"], *map(list, zip(*own, strict=True))]
            yield pa.RecordBatch.from_pydict(dict(zip(["doc_id", "start", "n_tokens", *names], columns, strict=True)))

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def ids_crc32(ids: np.ndarray) -> tuple[int]:
    """Unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
