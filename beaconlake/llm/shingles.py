"""Word shingles of whole texts as 64-bit hashes, in numpy over a buffer of texts."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a buffer of texts, and the number of words of each text; words end where texts do."""
    inside = ~_BREAK[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    if not len(start):
        return np.zeros(0, np.uint64), counts
    length = stop - start
    powers = np.multiply.accumulate(np.full(int(length.max()), _STEP))
    kept = np.flatnonzero(inside)
    base = np.repeat(np.cumsum(length) - length, length)
    terms = _BYTE[data[kept]]
    terms *= powers[np.arange(len(kept)) - base]
    return mixed(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; with fewer words the whole sequence is one; none without words."""
    words, counts = word_hashes(data, offsets)
    grams = words.copy()
    for k in range(1, n):
        grams = grams[: len(grams) - 1 if len(grams) else 0] * _NEXT + words[k:] if len(grams) else grams
    grams = mixed(grams)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            some = np.sort(grams[at : at + count - n + 1])
            keep = np.ones(len(some), bool)
            keep[1:] = some[1:] != some[:-1]
            out.append(some[keep])
        elif count:
            short = count
            for w in words[at : at + count].tolist():
                short = (short * int(_NEXT) + w) & 0xFFFFFFFFFFFFFFFF
            out.append(mixed(np.array([short], np.uint64) ^ _STEP))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of texts; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
